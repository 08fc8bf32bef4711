"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames. These helpers exist for tests, the benchmark and the
command-line entry points.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on.  AQE stays on so that the
# planner can coalesce small shuffles, split skewed join partitions and pick
# broadcast joins from runtime sizes.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "alphaloom", extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("ALPHALOOM_DRIVER_MEMORY", "16g")))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a folder every executor can reach and is
    left untouched.  Only in a local session where it is unset (tests) do we
    create a fresh scratch folder, removed when the process ends; on a cluster an unset
    folder is an error, since executors could not see a local one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="alphaloom-ckpt-", dir="/tmp")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for materialised intermediate tables inside the shared folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for one write: no later call writes it again, so frames that
    read it stay valid."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def clear_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session's folder (frames that read
    them are invalid afterwards).  Long-lived sessions call it between jobs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, ""))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None,
                compression: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back.

    This cuts the lineage like a reliable checkpoint (a lost executor never
    replays the upstream work), computes the input once (an eager
    ``checkpoint`` on an unpersisted plan runs it twice), stores it columnar
    and compressed, and gives the planner real file sizes for its join
    choices.  Each call writes a fresh folder, so frames built earlier keep
    reading their own copy.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by or []).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a cluster run.

    ``input_bytes`` is the compressed size of the largest scanned table set
    of the job, ``total_cores`` the executor cores of the cluster.  Shuffle
    partitions are chosen so that a partition holds about
    ``target_partition_bytes`` of the largest input (at least two waves of
    tasks); AQE then coalesces small partitions and splits skewed ones
    around the same advisory size.  Example: 100 TB on 1000 executors x 8
    cores gives about 400,000 shuffle partitions of 256 MB, 16 waves."""
    partitions = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        **{k: v for k, v in BASE_CONF.items() if k.startswith("spark.sql.")},
    }
