"""Secret scan by token efficiency, over a base of fixed patterns.

A byte-pair vocabulary writes ordinary words and names in few tokens and random
strings in many.  Runs of key-like characters whose characters per token fall
below a threshold are spans of kind ``random``, unless they are known digests
(hex of a hash's length), UUIDs, plain numbers, or numbered names (timestamps, versions,
book numbers: parts that are numbers or short words).  Readable text joined to a key
raises the mean of the whole run, so where that passes the threshold the parts
between = / + - _ are tested alone, and so are stretches of the token sequence with
low means; what is found side by side is one span.  Separated words without digits
or changing case are short tokens too, so letters alone count only as one part.
The base kinds (assign, access, hex) are always reported.  Offsets are code
points, ends exclusive.  The scan is one map over the rows, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_cache

# The base patterns, and the key words one of which an assignment holds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

MIN_VALUE, MIN_ACCESS = 8, 16
MIN_RUN = 20                    # characters of a run, part or stretch that is tested
MIN_MIXED = 16                  # and of one that mixes character classes
MIN_PART = 5                    # characters of the longest part of a stretch
DROP, EDGE = 6, 8               # a stretch ends where its surplus falls by DROP; up to EDGE characters to a part's end join it
MAX_CHARS_PER_TOKEN = 1.8
SHORT_PART = 8                  # longest part of a numbered name that may mix letters and digits

_assign = re.compile(ASSIGN, re.I | re.A)
_access = re.compile(ACCESS)
_hex = re.compile(HEX)
_run = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_MIXED)
_part = re.compile(r"[A-Za-z0-9]+")
_numbered = re.compile(r"[0-9]+|[A-Za-z]*[0-9]*[A-Za-z]?|[0-9]+[TtVv][0-9]+[Zz]?")
_named = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9]{%d,}|%s)(?![A-Za-z0-9])" % (
    MIN_RUN, "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_LENGTHS)))
_known = re.compile(r"[0-9]+|[0-9a-f]+|[0-9A-F]+|(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})")


def tiktoken_encoding(path: str):
    """The worker's tiktoken encoding of a rank file."""
    cache = worker_cache()
    if ("tiktoken", path) not in cache:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache["tiktoken", path] = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN,
                                                    mergeable_ranks=ranks, special_tokens={})
    return cache["tiktoken", path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in KEY_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(spans)


def excluded(run: str) -> bool:
    """Known digests and identifiers, plain numbers, and runs without a mix of
    character classes (letters and digits, or letters of changing case)."""
    if _known.fullmatch(run) and (run.isdigit() or "-" in run or len(run) in DIGEST_LENGTHS):
        return True
    letters = [c for c in run if c.isalpha()]
    digits = any(c.isdigit() for c in run)
    turns = sum(a.islower() and b.isupper() for a, b in zip(letters, letters[1:]))
    return not letters or not (digits or turns >= 3)


def token_lengths(run: str, encoding) -> list[int]:
    return [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(run)]


def numbered_name(run: str, encoding) -> bool:
    """Timestamps, versions, book and phone numbers, addresses of cards and the like: several
    parts, each a number, a short word with a number, or letters that are readable."""
    parts = _part.findall(run)
    return len(parts) > 1 and all(
        p.isdigit() or (len(p) <= SHORT_PART and _numbered.fullmatch(p) is not None)
        or (p.isalpha() and len(p) / len(token_lengths(p, encoding)) > MAX_CHARS_PER_TOKEN) for p in parts)


def is_random(run: str, encoding) -> bool:
    """A whole run or part by its mean; letters alone count as one part only."""
    if len(run) < MIN_RUN and (len(run) < MIN_MIXED or not run.isalnum()):
        return False
    if excluded(run) and not (run.isalpha() and len(run) >= MIN_RUN):
        return False
    return len(run) / len(token_lengths(run, encoding)) <= MAX_CHARS_PER_TOKEN and not numbered_name(run, encoding)


def stretches(run: str, encoding) -> list[tuple[int, int]]:
    """(start, end) of stretches of the token sequence with a low mean.  A token's
    surplus is the threshold less its letters and digits; separators count nothing."""
    out, ends, surplus, at = [], [], [], 0
    for n in token_lengths(run, encoding):
        own = sum(map(str.isalnum, run[at:at + n]))
        at += n
        ends.append(at)
        surplus.append(MAX_CHARS_PER_TOKEN - own if own else 0.0)
    i = 0
    while i < len(ends):
        if surplus[i] <= 0:
            i += 1
            continue
        first, total, best, top = i, 0.0, i, 0.0
        while i < len(ends):
            total += surplus[i]
            if total > top:
                best, top = i, total
            if total <= 0 or total < top - DROP:
                break
            i += 1
        i = best + 1
        out.append((ends[first - 1] if first else 0, ends[best]))
    return [(a, b) for a, b in out if b - a >= MIN_MIXED and not excluded(run[a:b])
            and max(map(len, _part.findall(run[a:b]))) >= MIN_PART]


def parts_found(run: str, encoding) -> list[tuple[int, int]]:
    """Random parts and stretches of a run, joined where only separators lie between."""
    parts = [m.span() for m in _part.finditer(run)]
    found = [(a, b) for a, b in parts if is_random(run[a:b], encoding)]
    for a, b in stretches(run, encoding):
        first, last = next(p for p in parts if p[1] > a), next(p for p in reversed(parts) if p[0] < b)
        a = first[0] if a - first[0] <= EDGE else a
        b = last[1] if last[1] - b <= EDGE else b
        found.append((a, b))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and (a <= joined[-1][1] or not _part.search(run, joined[-1][1], a)):
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return [(a, b) for a, b in joined if not numbered_name(run[a:b], encoding)]


def random_spans(text: str, encoding) -> list[tuple[int, int, int]]:
    spans = []
    for m in _run.finditer(text):
        run = m[0].strip("=-_/+")
        at = m.start() + m[0].index(run)
        if is_random(run, encoding):
            spans.append((at, 3, at + len(run)))
            continue
        start = 0
        for known in [*(k.span() for k in _named.finditer(run)), (len(run), len(run))]:
            if known[0] - start >= MIN_MIXED:
                spans += [(at + start + a, 3, at + start + b) for a, b in parts_found(run[start:known[0]], encoding)]
            start = known[1]
    return spans


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document row: doc_id, spans (array of kind, start, stop), n_assign,
    n_access, n_hex, base_sha256, and the spans written out as ``spans_text``.

    Null and empty texts have no spans and the digest of the empty string; very long texts
    and runs are scanned whole.  Rows that repeat an id get a row each; other columns are
    ignored; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken_encoding(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                base = base_spans(text)
                every = sorted(base + random_spans(text, encoding))
                counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                rows.append({"doc_id": doc_id, "spans": [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in every],
                             "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
                             "base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans_text": written(every)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans_text", pa.string())])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<kind string, start bigint, stop bigint>>, n_assign bigint, "
                                "n_access bigint, n_hex bigint, base_sha256 string, spans_text string")


def redact(docs: DataFrame, vocabulary: str, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span's characters replaced by ``mask`` (overlapping
    spans by one mask), all columns and rows kept; a null text stays null, an empty table empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken_encoding(vocabulary)
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                out, done = [], 0
                for a, _, b in sorted(base_spans(text or "") + random_spans(text or "", encoding)):
                    if a >= done:
                        out += [text[done:a], mask]
                    done = max(done, b)
                texts.append(None if text is None else "".join(out) + text[done:])
            arrays = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.record_batch(arrays, names=batch.schema.names)
    return docs.mapInArrow(run, docs.schema)
