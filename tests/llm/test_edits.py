import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alphaloom.llm import edit_counts as ec
from alphaloom.llm.secrets import tiktoken_encoding
from alphaloom.llm.tokens import vocabulary_path
from tests.conftest import SF_SMALL

from .helpers import SCHEMA, awkward, awkward_rows, clashing

PATH = vocabulary_path("byte_bpe_50k.tiktoken")
ENCODER = ec.Encoder(PATH)


def full_count(text):
    return len(tiktoken_encoding(PATH).encode_ordinary(text))


def spliced(text, pos, drop, insert):
    pos = min(max(pos, 0), len(text))
    return text[:pos] + insert + text[pos + max(drop, 0):]


SCRIPTS = [st.text(alphabet="ab'st 1.\n\té日\x1c\u3000-", max_size=60), st.text(alphabet="日本語文。、", max_size=80),
           st.text(alphabet="a", max_size=80), st.text(alphabet="ab ", max_size=80), st.text(alphabet=" \n\t'sx", max_size=60),
           st.text(alphabet="0123456789.,", max_size=60), st.text(alphabet="😀é🇩🇪x", max_size=40)]


@settings(max_examples=600, deadline=None)
@given(st.sampled_from([(1, 2), (2, 16), (5, 3)]), st.lists(st.one_of(SCRIPTS), max_size=6),
       st.lists(st.tuples(st.integers(-2, 300), st.integers(-1, 80), st.one_of(SCRIPTS)), max_size=8))
def test_edited_counts_equal_full_encoding(sizes, parts, edits):
    before = ec.LEAF_TOKENS, ec.ANCHOR
    ec.LEAF_TOKENS, ec.ANCHOR = sizes
    try:
        text = "".join(parts)
        tree = ec.SegmentTree(ENCODER.leaves(text))
        same(tree, text)
        for pos, drop, insert in edits:
            tree.edit(pos, drop, insert, ENCODER)
            text = spliced(text, pos, drop, insert)
            same(tree, text)
    finally:
        ec.LEAF_TOKENS, ec.ANCHOR = before


def same(tree, text):
    leaves = tree.leaves()
    assert "".join(t for t, _ in leaves) == text and tree.chars == len(text) and tree.root.size == len(leaves)
    assert tree.tokens == full_count(text) == sum(n for _, n in leaves)
    assert [full_count(t) for t, _ in leaves] == [n for _, n in leaves]


def check(rows, got):
    want = sorted(((r.doc_id, full_count(r.text or ""), full_count(edited(r))) for r in rows), key=repr)
    assert want == sorted(((r.doc_id, r.n_before, r.n_after) for r in got), key=repr)


def edited(row):
    text = row.text or ""
    for e in row.edits:
        text = spliced(text, e.pos, e.drop, e.insert)
    return text


def test_query_counts_match_brute_force(spark):
    docs = clashing(awkward(spark))
    got = ec.edited_counts(docs, PATH, ec.own_edits()).collect()
    assert len(got) == len(awkward_rows())
    check(docs.withColumn("edits", ec.own_edits()).collect(), got)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = ec.edited_counts(docs, PATH, ec.own_edits()).collect()
    check(docs.withColumn("edits", ec.own_edits()).collect(), got)
    assert ec.edited_counts(spark.createDataFrame([], SCHEMA), PATH, ec.own_edits()).collect() == []


def long_texts():
    rng = random.Random(0)

    def drawn(alphabet, n):
        return "".join(rng.choices(alphabet, k=n))
    return {"words": " ".join(drawn("abcdef", 6) for _ in range(40000)), "no spaces": drawn("abcdefgh", 250_000),
            "letters and digits": drawn("abcdef0123456789", 200_000), "Chinese": drawn("日本語文章学校東京大", 80_000),
            "sentences": "。".join(drawn("日本語文章学校東京大", 30) for _ in range(2600)), "lines": drawn("ab\n", 200_000)}


def test_only_touched_regions_are_encoded_again():
    rng = random.Random(3)
    for name, text in long_texts().items():
        tree = ec.SegmentTree(ENCODER.leaves(text))
        assert tree.tokens > 90_000, name
        assert max(n for _, n in tree.leaves()) <= 2 * ec.LEAF_TOKENS, name
        for turn in range(60):
            pos, drop = rng.randrange(len(text)), rng.choice([0, 0, 1, 7])
            insert = rng.choice(["x", "", " ", "changed", "新", "\n", "'s", " 12"])
            again = tree.edit(pos, drop, insert, ENCODER)
            text = spliced(text, pos, drop, insert)
            assert again < 0.01 * tree.tokens, (name, turn, again)
        same(tree, text)


def test_trees_grow_with_large_inserts_and_shrink_with_large_deletions():
    for name, large in long_texts().items():
        tree = ec.SegmentTree(ENCODER.leaves(""))
        tree.edit(0, 0, large, ENCODER)
        assert tree.root.size > 500, name
        assert tree.edit(len(large) // 2, 1, "x", ENCODER) < 0.01 * tree.tokens, name
        tree.edit(10, len(large) - 20, "", ENCODER)
        assert tree.root.size == 1, name
        same(tree, spliced(spliced(large, len(large) // 2, 1, "x"), 10, len(large) - 20, ""))


def test_trees_stay_balanced_when_one_place_grows():
    tree, text = ec.SegmentTree(ENCODER.leaves("")), ""
    for turn in range(1500):
        insert = f" word{turn} and more of it, also here and there and everywhere"
        tree.edit(len(text), 0, insert, ENCODER)
        text += insert
    assert tree.root.depth <= 2 * tree.root.size.bit_length() + 8
    same(tree, text)


def test_a_run_of_one_character_may_shift_to_its_end():
    text = "b" + "a" * 5000 + " end of the run " * 200
    tree = ec.SegmentTree(ENCODER.leaves(text))
    for pos, insert in ((9, "a"), (2000, "b"), (3000, "aa")):
        tree.edit(pos, 0, insert, ENCODER)
        text = spliced(text, pos, 0, insert)
        same(tree, text)


def test_null_edits_and_edits_across_the_whole_text(spark):
    rows = [(1, "some words here", [(None, None, None), (0, 1000, "new")]), (2, None, None), (3, "kept", [None]), (None, "a b", [(99, 1, " c")])]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, edits {ec.EDITS_TYPE}")
    trees = ec.build_trees(df, PATH, F.col("edits"))
    got = {r.doc_id: r for r in ec.apply_edits(trees, PATH).collect()}
    assert "".join(got[1].leaves) == "new" and got[1].n_after == full_count("new") and got[1].n_edits == 2
    assert (got[2].n_before, got[2].n_after, got[2].n_edits) == (0, 0, 0)
    assert got[3].n_after == full_count("kept") and "".join(got[None].leaves) == "a b c"
