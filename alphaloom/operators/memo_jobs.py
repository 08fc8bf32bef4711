"""Memo batches that survive a kill (M2): a durable result table, resumed by anti-join.

Each call of the model is a row of its own task, and a task's result reaches the table when the
task commits (the committer that moves a task's files at once, not at the
job's end).  A run that is killed therefore loses no finished call: the next run
reads the table, leaves out every row that has a result for the same prompt, and
calls the model for the rest.

At most ``max_in_flight`` calls run at a time: the rows to do are dealt to that many lanes and
written with their turn in their lane, and each turn is one small job with a task per lane.
Inside a task a failing call is repeated after a growing pause.
"""

from __future__ import annotations

import datetime as _dt
import random
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .context import ERROR_PREFIX, MEMO_COLUMNS, memo_prompt

RESULT_SCHEMA = ("job_key string, prompt_sha string, memo string, ok boolean, attempts int, finished timestamp, run string")
TURN_MASK = (1 << 33) - 1       # monotonically_increasing_id: place inside the partition


def call_with_backoff(infer: Callable[[str], str], prompt: str, attempts: int, first_pause: float, longest_pause: float,
                      sleep: Callable[[float], None] = time.sleep, seed: str = "") -> tuple[str, bool, int]:
    """(text, succeeded, calls made): a failing call is repeated up to ``attempts`` times in all, after
    pauses that double from ``first_pause`` to ``longest_pause`` and vary by half (so that
    lanes that fail together don't come back together)."""
    rng = random.Random(seed)
    for n in range(1, attempts + 1):
        try:
            return str(infer(prompt)), True, n
        except Exception as e:  # noqa: BLE001 - the last error is the row's result
            if n == attempts:
                return f"{ERROR_PREFIX}{e}", False, n
            sleep(min(longest_pause, first_pause * 2 ** (n - 1)) * (0.75 + rng.random() / 2))
    raise ValueError("attempts must be at least 1")


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per (job_key, prompt_sha): the success if there is one, else the latest failure."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], RESULT_SCHEMA)
    rows = spark.read.schema(RESULT_SCHEMA).parquet(path)
    best = F.max_by(F.struct("memo", "ok", "attempts", "finished", "run"), F.struct("ok", "finished", "run"))
    return rows.groupBy("job_key", "prompt_sha").agg(best.alias("r")).select("job_key", "prompt_sha", "r.*")


def _asked(jobs: DataFrame, key: str, prompt: str) -> DataFrame:
    """Distinct (job_key, prompt_sha, prompt); a row without key or prompt is never asked."""
    rows = jobs.select(F.col(f"`{key}`").cast("string").alias("job_key"), F.col(f"`{prompt}`").alias("prompt"))
    return rows.where("job_key IS NOT NULL AND prompt IS NOT NULL").withColumn("prompt_sha", F.sha2("prompt", 256)).distinct()


def run_calls(jobs: DataFrame, infer: Callable[[str], str], path: str, key: str = "ticker", prompt: str = "prompt",
              max_in_flight: int = 8, attempts: int = 4, first_pause: float = 2.0, longest_pause: float = 60.0,
              retry_failed: bool = True, sleep: Callable[[float], None] = time.sleep) -> int:
    """Call ``infer`` for every (key, prompt) of ``jobs`` that has no result under ``path`` yet
    and add the results there; returns how many were asked.

    Rows that repeat key and prompt are asked once; a prompt that changed is asked anew; a failure is
    kept as a result and, with ``retry_failed``, asked again by the next run.  A call whose task is lost
    before it commits is repeated.  Starts jobs at once."""
    spark = jobs.sparkSession
    done = stored_results(spark, path)
    done = done.where("ok") if retry_failed else done
    todo = _asked(jobs, key, prompt).join(done.select("job_key", "prompt_sha"), ["job_key", "prompt_sha"], "left_anti")
    dealt = todo.repartition(max_in_flight).withColumns({
        "lane": F.spark_partition_id(), "turn": F.monotonically_increasing_id().bitwiseAND(F.lit(TURN_MASK))})
    dealt = materialize(dealt, "memo-turns")
    turns, asked = dealt.agg(F.coalesce(F.max("turn") + 1, F.lit(0)), F.count(F.lit(1))).first()
    run = uuid.uuid4().hex

    def call(batches):
        for pdf in batches:
            for one in pdf.itertuples():
                text, ok, n = call_with_backoff(infer, one.prompt, attempts, first_pause, longest_pause, sleep, one.job_key)
                now = pd.Timestamp(_dt.datetime.now(_dt.timezone.utc)).tz_localize(None)
                yield pd.DataFrame([[one.job_key, one.prompt_sha, text, ok, n, now, run]],
                                   columns=["job_key", "prompt_sha", "memo", "ok", "attempts", "finished", "run"])
    for turn in range(turns):
        now = dealt.where(F.col("turn") == turn).repartitionById(max_in_flight, F.col("lane"))
        now.mapInPandas(call, RESULT_SCHEMA).write.mode("append") \
            .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return asked


def finished_memos(jobs: DataFrame, path: str, key: str = "ticker", prompt: str = "prompt") -> DataFrame:
    """``jobs`` with the stored ``investment_memo``, ``generation_timestamp``, ``ok`` and ``attempts``
    of each row's key and prompt; null where there is no result yet."""
    found = stored_results(jobs.sparkSession, path).select(
        F.col("job_key").alias("_job_key"), F.col("prompt_sha").alias("_prompt_sha"), F.col("memo").alias("investment_memo"),
        F.col("finished").alias("generation_timestamp"), "ok", "attempts")
    same = (F.col(f"`{key}`").cast("string") == F.col("_job_key")) & (F.sha2(F.col(f"`{prompt}`"), 256) == F.col("_prompt_sha"))
    return jobs.join(found, same, "left").drop("_job_key", "_prompt_sha")


def resumable_memo_batch(companies: DataFrame, infer: Callable[[str], str], path: str, top_n: int = 10, **options) -> DataFrame:
    """M2 as a job that can be resumed: the top-N companies by alpha, their prompts, and the memos from the
    table at ``path``, after calling ``infer`` for those that were missing (options: see ``run_calls``)."""
    top = (companies.orderBy(F.col("overall_alpha_score").desc(), F.col("ticker")).limit(top_n)
           .select(*MEMO_COLUMNS, memo_prompt(companies).alias("prompt")))
    top = materialize(top, "memo-jobs")
    run_calls(top, infer, path, **options)
    return finished_memos(top, path).drop("prompt")
