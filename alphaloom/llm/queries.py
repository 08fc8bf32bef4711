"""The registered queries of this subpackage: thin projections of operators
over the given tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, edit_counts, exact_mph, fill_middle, graph_ann, mixing, packing, quality, secrets, simhash, slot_shards, \
    token_binary, toxicity
from .common import table
from .tokens import vocabulary_path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.round_trip(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits of its own."""
    return edit_counts.edited_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"),
                                     edit_counts.own_edits())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_mph.exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))
    return found.drop("spans").withColumnRenamed("spans_text", "spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), with_ids=False)


def op11_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_shards.place(table(spark, sf_dir, "documents"), shards=16)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.cut_digests(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls,
         sha256('7:' || doc_id) AS h FROM documents),
x AS (
  SELECT doc_id, t, ls, len(ls) AS n, ('0x' || h[1:8])::BIGINT % (len(ls) + 1) AS c1,
         ('0x' || h[9:16])::BIGINT % (len(ls) + 1) AS c2, ('0x' || h[17:24])::BIGINT % 100 AS h3,
         ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d),
y AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain'
              WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(ls[1:least(c1, c2)], '') AS p,
         array_to_string(ls[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(ls[greatest(c1, c2) + 1:n], '') AS s FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM y
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"),
                                       vocabulary_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_binary": op2_token_binary,
    "op3_edit_counts": op3_edit_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_graph_ann": op6_graph_ann,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_packing": op10_packing,
    "op11_slot_shards": op11_slot_shards,
    "op12_fill_middle": op12_fill_middle,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op12_fill_middle": OP12_SQL}


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(ORACLE_SQL)
