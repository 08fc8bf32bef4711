"""Small inputs and brute-force versions for the training-data operators."""

import hashlib
import random
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma,", "delta.", "été", "日本", "x", "naïve", "A-B", "end\nof"]
    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    long = prose(9000)
    base = prose(60)
    near = base.replace("alpha", "alpha", 1) + " alpha"
    rows = [(1, base, "en", "s1"), (2, base, "en", "s2"), (3, near, "de", "s1"), (4, None, "en", "s1"),
            (5, "", None, None), (6, long, "fr", "s3"), (7, long, "fr", "s3"), (7, long, "fr", "s3"),
            (8, "one", "en", "s2"), (9, "two words", "en", "\U0001F600"), (10, "  lead\t\ttrail \n", "en", "s1"),
            (None, base, "en", "s1"), (None, None, None, None), (11, "\x0b\x0c", "en", "s2")]
    rows += [(100 + i, prose(rng.randrange(1, 80)), "en", f"s{rng.randrange(5)}") for i in range(80)]
    rows += [(200 + i, base, "en", "s0") for i in range(12)]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def clashing(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ["digest", "winner", "fp", "root", "x", "label", "size", "part", "row", "n", "ids", "score", "kept", "taken"]
    return df.withColumns({c: F.lit("clash") for c in names})


def py_sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def py_simhash(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w)
             for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def py_components(fps):
    """Root of each fingerprint over links of 3 bits or fewer."""
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f
    items = sorted(parent)
    for i, a in enumerate(items):
        for b in items[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {f: find(f) for f in items}


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
