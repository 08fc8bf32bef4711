import hashlib
import random
import re
import string

from alphaloom.llm import secrets
from alphaloom.llm.secrets import tiktoken_encoding
from alphaloom.llm.tokens import vocabulary_path
from tests.conftest import SF_CHECK

from .helpers import SCHEMA, awkward, awkward_rows, clashing

PATH = vocabulary_path("byte_bpe_50k.tiktoken")


def brute_base(text):
    """The base spans straight from the contract's patterns, without shortcuts."""
    found = []
    assign = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
              r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)")
    for order, pattern, least, group in ((0, assign, 8, 2), (1, "AKIA[A-Z0-9]+", 16, 0), (2, "[0-9a-f]+", 32, 0)):
        found += [(m.start(), order, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


def check(docs_rows, got):
    want = []
    for d, t, *_ in docs_rows:
        base = brute_base(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        want.append((d, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=repr)
    for r in got:
        kept = [s for s in r.spans_text.split(",") if s and not s.startswith("random:")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256
        assert [(s.start, s.kind) for s in r.spans] == sorted(((s.start, s.kind) for s in r.spans),
                                                             key=lambda x: (x[0], secrets.KINDS.index(x[1])))


def tricky():
    rng = random.Random(4)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    return [(1, f"é Password: 'abc' TOKEN=\"{key}\" x", "en", "s", 1), (2, "api_key = short apikey: longenough1", None, None, None),
            (3, "ſecret=abcdefghij toKen=abcdefghij", None, None, None), (4, "AKIA AKIASHORT AKIA" + "Q" * 16, None, None, None),
            (5, "0123456789abcdef" * 2 + "G" + "a" * 31, None, None, None), (6, None, None, None, None), (None, key, None, None, None),
            (7, "password=" * 50, None, None, None), (8, key * 300, None, None, None), (8, key * 300, None, None, None)]


def test_base_spans_match_brute_force(spark):
    rows = tricky() + awkward_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    check(rows, secrets.scan(clashing(df), PATH).collect())
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], secrets.scan(docs, PATH).collect())
    assert secrets.scan(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_token_efficiency_tells_random_strings_from_names():
    enc = tiktoken_encoding(PATH)
    rng = random.Random(1)
    alphabet = string.ascii_letters + string.digits
    keys = ["".join(rng.choices(alphabet, k=32)) for _ in range(300)]
    found = sum(bool(secrets.random_spans(f"the key {k} here", enc)) for k in keys)
    assert found >= 294
    plain = ["internationalization_of_2024_settings", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000",
             "12345678901234567890123", "https://example.com/some/long/path/to/resource", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
             "getUserAccountSettingsForOrganization", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709"]
    assert [p for p in plain if secrets.random_spans(p, enc)] == []
    text = f"x {keys[0]}, y"
    (a, _, b), = secrets.random_spans(text, enc)
    assert text[a:b] == keys[0]


def test_keys_after_readable_text_and_letters_only_keys_are_found():
    enc = tiktoken_encoding(PATH)
    rng = random.Random(2)
    mixed = string.ascii_letters + string.digits
    cases = [(mixed, 24, 0.99), (mixed, 16, 0.97), (mixed + "+/", 40, 0.95), (mixed + "-_", 40, 0.95),
             (string.ascii_uppercase, 32, 0.95), (string.ascii_letters, 24, 0.97), (string.ascii_lowercase, 32, 0.7)]
    for before in ("", "https_proxy_authorization=", "/home/user/projects/config/production/credentials/"):
        for alphabet, n, least in cases:
            covered = 0
            for _ in range(200):
                key = "".join(rng.choices(alphabet, k=n))
                at = 2 + len(before)
                spans = secrets.random_spans(f"x {before}{key}, y", enc)
                covered += any(a <= at + 2 and b >= at + n - 2 for a, _, b in spans)
            assert covered >= least * 200, (before, alphabet, n, covered)
    key = "".join(rng.choices(mixed, k=32))
    text = f"GET /api/internal/accounts/settings/{key}/documents/overview HTTP"
    (a, _, b), = secrets.random_spans(text, enc)
    assert text[a:b] == key
    plain = ["https://github.com/apache/spark/blob/master/sql/core/src/main/scala/org/apache/spark/sql/execution/ParquetFileFormat",
             "/objects/123e4567-e89b-12d3-a456-426614174000/versions/overview", "to-be-or-not-to-be-that-is-the-question",
             "MAX_CONNECTIONS_PER_HOST_2", "Donaudampfschifffahrtsgesellschaft", "====================", "20240102T101112Z",
             "/usr/lib/x86_64-linux-gnu/libpthread", "utm_source=newsletter/utm_medium=email/utm_campaign=2024_q1"]
    assert [p for p in plain if secrets.random_spans(p, enc)] == []


IDENTIFIERS = """2024-01-02T10-11-12Z 2024-01-02T10-11-12-000Z 2024_01_02_10_11_12_backup backup-2024-01-02T10-11-12Z
/var/log/app/2024-01-02T10-11-12Z ISBN978-3-16-148410-0 ISBN-13-978-0-306-40615-7 ISSN-2049-3630-0001 DE89370400440532013000
GB29NWBK60161331926819 v1-26-0-rc3-20240102 spark-4-1-2-bin-hadoop3 python3-13-7-linux-x86_64 x86_64-unknown-linux-gnu
+1-202-555-0143-ext-22 ORD-2024-000123-0042 INV-2024-00012345-DE IMG_20240102_101112_001 CVE-2024-12345-CVE-2024-54321
00-1A-2B-3C-4D-5E-6F-70 4111-1111-1111-1111 PMID-12345678-PMC-7654321 2024-W01-2/2024-W02-3 part-00000-of-00128
page_12_line_34_col_56_row_78 com/example/project/module2/Class3 arXiv-2401-01234v2-2401-05678v1""".split()


def test_identifiers_are_not_reported():
    enc = tiktoken_encoding(PATH)
    assert [i for i in IDENTIFIERS if secrets.random_spans(f"see {i}, ok", enc)] == []


def test_clean_documents_have_no_random_spans(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    enc = tiktoken_encoding(PATH)
    clean = [r for r in docs if r.text and not brute_base(r.text)]
    assert len(clean) > 500
    assert [(r.doc_id, secrets.random_spans(r.text, enc)) for r in clean if secrets.random_spans(r.text, enc)] == []


def brute_random(word, enc):
    """Whether a word of letters and digits is random, from the written rule."""
    mixed = re.search("[0-9]", word) and re.search("[A-Za-z]", word)
    turns = len(re.findall("[a-z][A-Z]", word)) >= 3
    if len(word) < 16 or (len(word) < 20 and not (mixed or turns)) or word.isdigit():
        return False
    if len(word) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-f]+|[0-9A-F]+", word):
        return False
    if not (mixed or turns or word.isalpha()):
        return False
    return len(word) / len(enc.encode_ordinary(word)) <= 1.8


def test_random_spans_of_single_words_match_brute_force():
    enc = tiktoken_encoding(PATH)
    rng = random.Random(8)
    alphabets = [string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"]
    found = 0
    for _ in range(400):
        words = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 70))) for _ in range(8)]
        text, at, want = " ".join(words), 0, set()
        for w in words:
            if brute_random(w, enc):
                want.add((at, 3, at + len(w)))
            at += len(w) + 1
        got = set(secrets.random_spans(text, enc))
        assert want <= got
        # what else is found are stretches inside words whose whole mean is above the threshold
        for a, _, b in got - want:
            assert not any(x <= a and b <= y for x, _, y in want)
            assert (b - a) / len(enc.encode_ordinary(text[a:b])) < 2.2
        found += len(want)
    assert found > 500


def test_very_long_runs_are_tokenised_whole():
    enc = tiktoken_encoding(PATH)
    key = "".join(random.Random(5).choices(string.ascii_letters + string.digits, k=50_000))
    assert sum(secrets.token_lengths(key, enc)) == len(key)
    assert len(secrets.token_lengths(key, enc)) == len(enc.encode_ordinary(key))
    assert secrets.random_spans(f"x {key} y", enc) == [(2, 3, 50_002)]


def test_redact_hides_every_span(spark):
    rows = tricky()
    got = secrets.redact(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert sum(r.text is None for r in got) == sum(r[1] is None for r in rows)
    assert not [r for r in got if re.search(r"[A-Za-z0-9]{40}", r.text or "")]
