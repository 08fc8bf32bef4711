"""The pipeline's stages against brute-force versions, each on its own input."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from alphaloom.llm import quality
from alphaloom.llm.common import table
from alphaloom.llm.tokens import vocabulary_path
from tests.conftest import SF_SMALL

from .helpers import SCHEMA, WORD, awkward, py_components, py_simhash
from .test_tokens import brute_mix, check_packing

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup",
                                         "mixing to target weights", "packing"]


def test_stages_one_after_the_other(spark, tmp_path):
    stages = dict(cp.STAGES)
    docs = table(spark, SF_SMALL, "documents")

    def step(name, df):
        stages[name](spark, df, SF_SMALL).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")
    good = step("quality classifier", docs)
    scores = quality.score_documents(docs, table(spark, SF_SMALL, "labels")).where("predicted = 1")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF_SMALL, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(labels[d] == 1 for d in labels if d in kept) >= 0.97 * sum(v == 1 for v in labels.values())

    once = step("exact dedup", good)
    last = defaultdict(int)
    for r in good.collect():
        last[r.text] = max(last[r.text], r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(last.values())

    single = step("simhash near-dedup", once)
    fps = {r.doc_id: py_simhash(r.text) for r in once.collect()}
    roots = py_components(fps.values())
    least = {}
    for d, f in fps.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())

    mixed = step("mixing to target weights", single)
    rows = [tuple(r) for r in single.collect()]
    sizes, targets = brute_mix(rows)
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    taken, per_doc = Counter(), Counter()
    for r in mixed.collect():
        n = len(WORD.findall(r.text))
        taken[r.source] += n
        per_doc[r.doc_id] += n
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    assert all(n <= 3 * size[d] for d, n in per_doc.items())

    packed = step("packing", mixed)
    check_packing([tuple(r) for r in mixed.collect()], packed.collect())
    for name in list(stages)[:-1]:
        assert spark.read.parquet(f"{tmp_path}/{name}").columns == DOC_COLUMNS
    assert vocabulary_path("word_bpe_49k.json")


def test_stages_take_awkward_and_empty_tables(spark):
    for name, stage in cp.STAGES:
        rows = stage(spark, awkward(spark), SF_SMALL).collect()
        assert rows, name
        assert stage(spark, spark.createDataFrame([], SCHEMA), SF_SMALL).collect() == [], name


def test_quality_stage_keeps_columns_of_any_name_and_equals_the_scores(spark):
    docs = table(spark, SF_SMALL, "documents").unionByName(awkward(spark).withColumn("n_chars", F.lit(1).cast("bigint")))
    docs = docs.selectExpr("*", "n_chars AS features", "lang AS Features_", "source AS x", "doc_id AS label", "text AS score", "1 AS part")
    labels = table(spark, SF_SMALL, "labels")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.select("doc_id").collect())
    want = quality.score_documents(docs, labels).where("predicted = 1")
    assert got == Counter(r.doc_id for r in want.collect()) and got
    assert all((r.features, r.Features_, r.x, r.label, r.score) == (r.n_chars, r.lang, r.source, r.doc_id, r.text)
               for r in kept.collect())


def test_run_returns_packed_pieces(spark):
    out = cp.run(spark, SF_SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns)
    assert out.count() > 0
