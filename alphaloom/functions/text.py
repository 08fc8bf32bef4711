"""Text expressions: post cleaning, tokens, word-list scores, memo cleaning.

Everything here is a built-in Column expression (JVM side, inside whole-stage
codegen).  Regular expressions spell out Unicode classes so that Java's
regex engine (Spark) and RE2 (the DuckDB oracle) agree with Python's
Unicode ``\\w`` / ``\\s`` semantics.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
WORD = r"[\p{L}\p{N}_]"
SPACE_CHARS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}"
# What a single plain space has to replace: runs of two or more, and any other space alone.
LONG_SPACE_RUN = f"[{SPACE_CHARS}]{{2,}}|(?! )[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
TOKEN = f"{WORD}+"

# Cleaning patterns, applied in this order.
URL_PATTERN = f"http{NON_SPACE}+|www\\.{NON_SPACE}+"
CASHTAG_PATTERN = f"\\${WORD}+"
MENTION_PATTERN = f"@{WORD}+"

# Mis-decoded quote sequences and their replacements, in order.
MOJIBAKE = [("â€œ", '"'), ("â€\u009d", '"'), ("â€™", "'")]

# Character references: numbers of any length, named with a semicolon, and the
# names that HTML also allows without one (both sets as the standard library
# lists them), of which the longest that a reference starts with counts.
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
ENTITY_PATTERN = f"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{_BARE_NAMES}))"
NO_CHARACTER = 0x110000         # stands for every number beyond the last character
# Numbers 128-159 stand for the characters of that byte in Windows-1252.
_WINDOWS_1252 = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))

# Word lists.
FEAR_WORDS = ["crash", "fear", "panic", "worried", "scared", "scary",
              "dump", "tank", "plunge", "collapse", "bleeding", "nervous"]
FINANCE_KEYWORDS = ["delivery", "deliveries", "estimate", "estimates",
                    "earnings", "guidance", "margin", "margins",
                    "revenue", "profit", "profits", "loss", "losses",
                    "layoff", "layoffs", "acquisition", "equity",
                    "rsu", "rsus", "valuation", "price", "target",
                    "dividend", "cashflow", "debt"]

# Compound-score normalisation constant (s / sqrt(s^2 + alpha)).
COMPOUND_ALPHA = 15.0

# Own values for the optional negation rule: a valence is scaled by the
# factor when one of the three preceding tokens is a negation word (factor
# from the published description of lexicon-based compound scoring).
NEGATION_WORDS = ["not", "no", "never", "none", "nothing", "nor", "neither", "without",
                  "cannot", "nobody", "nowhere"]
NEGATION_FACTOR = -0.74
NEGATION_WINDOW = 3


def negation_multipliers(tok: Column) -> Column:
    """Per token: ``NEGATION_FACTOR`` when a negation word is among the
    previous ``NEGATION_WINDOW`` tokens, else 1.0 (array in, array out)."""
    def mult(_t, i):
        start = F.greatest(i - (NEGATION_WINDOW - 1), F.lit(1))
        before = F.slice(tok, start, i - start + 1)
        hit = F.exists(before, lambda w: w.isin(*NEGATION_WORDS))
        return F.when(hit, F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0))
    return F.transform(tok, mult)


def _only_if(t: Column, needles: list[str], step) -> Column:
    """Apply ``step`` only to texts containing one of ``needles``: a cheap
    substring test skips whole passes over the (usually large) majority of
    texts that the step could not change.  The text is bound once, as the variable
    of a one-element transform, so chained steps do not repeat each other."""
    def chosen(x: Column) -> Column:
        cond = None
        for n in needles:
            hit = F.instr(x, n) > 0
            cond = hit if cond is None else cond | hit
        return F.when(cond, step(x)).otherwise(x)
    return F.get(F.transform(F.array(t), chosen), F.lit(0))


def _numbered(code: Column) -> Column:
    """The character of a numeric reference, by the HTML rules for numbers that
    are no characters."""
    own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    dropped = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
               | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return (F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
             .when(code.between(128, 159), F.substr(F.lit(_WINDOWS_1252), (code - 127).cast("int"), F.lit(1)))
             .when(dropped, F.lit("")).otherwise(own))


def decode_entities(c: Column) -> Column:
    """Numeric and named character references, each decoded once, with built-in
    expressions: the text is split at the references and joined again with what
    they stand for.  A number may have any length; a name that is unknown stands for the
    longest name without semicolon that it starts with, or stays as it is."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def number(e: Column) -> Column:
        digits, is_hex = F.regexp_replace(e, "^&#[xX]?0*|;$", ""), e.rlike("^&#[xX]")
        value = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        return (F.when(digits == "", F.lit(0).cast("bigint"))
                .when(F.length(digits) > F.when(is_hex, 6).otherwise(7), F.lit(NO_CHARACTER).cast("bigint")).otherwise(value))

    def name(e: Column) -> Column:
        bare = F.regexp_extract(e, f"^&({_BARE_NAMES})", 1)
        prefixed = F.when(bare != "", F.concat(F.try_element_at(names, bare), F.substr(e, F.length(bare) + 2)))
        return F.coalesce(F.try_element_at(names, F.substring(e, 2, 64)), prefixed, e)

    def one(e: Column) -> Column:
        return F.when(F.startswith(e, F.lit("&#")), _numbered(number(e))).otherwise(name(e))

    def decode(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(ENTITY_PATTERN), 0)
        meant = F.concat(F.transform(found, one), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(t, ENTITY_PATTERN, -1), meant, lambda a, b: F.concat(a, b)), "")
    return _only_if(c, ["&"], decode)


def _fix_quotes(t: Column) -> Column:
    for bad, good in MOJIBAKE:
        t = F.replace(t, F.lit(bad), F.lit(good))
    return t


def clean_post(c: Column) -> Column:
    """Entities -> quote fixes -> drop URLs, $tags, @mentions -> collapse
    whitespace -> trim -> lower.  NULL becomes the empty string.  Each
    literal or pattern step runs only on texts containing its trigger
    characters (a pattern cannot match without them)."""
    t = decode_entities(c)
    t = _only_if(t, ["â"], _fix_quotes)
    t = _only_if(t, ["http", "www."], lambda x: F.regexp_replace(x, URL_PATTERN, ""))
    t = _only_if(t, ["$"], lambda x: F.regexp_replace(x, CASHTAG_PATTERN, ""))
    t = _only_if(t, ["@"], lambda x: F.regexp_replace(x, MENTION_PATTERN, ""))
    t = F.regexp_replace(t, LONG_SPACE_RUN, " ")
    return F.coalesce(F.lower(F.trim(t)), F.lit(""))


def tokens(c: Column) -> Column:
    """Maximal runs of Unicode word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def _in_list(words: list[str]):
    # ``isin`` with more than ten literals becomes a hash-set lookup (InSet).
    return lambda t: t.isin(*words)


def fear_score(tok: Column) -> Column:
    """Share of tokens that are fear words; no token -> 0.0."""
    n = F.coalesce(F.size(tok), F.lit(0))
    hits = F.size(F.filter(tok, _in_list(FEAR_WORDS)))
    return F.when(n > 0, hits.cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def keyword_score(tok: Column) -> Column:
    """Number of finance-keyword tokens; no token -> 0."""
    return F.coalesce(F.size(F.filter(tok, _in_list(FINANCE_KEYWORDS))), F.lit(0))


def compound(score: Column, alpha: float = COMPOUND_ALPHA) -> Column:
    """T4 normalisation to [-1, 1]."""
    v = score / F.sqrt(score * score + F.lit(alpha))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))


def clean_memo(c: Column) -> Column:
    """Strip **bold** and *italic* markers and '#', keep Latin-1 only."""
    t = F.regexp_replace(c, r"\*\*([^\n]*?)\*\*", "$1")
    t = F.regexp_replace(t, r"\*([^\n]*?)\*", "$1")
    t = F.replace(t, F.lit("#"), F.lit(""))
    return F.regexp_replace(t, r"[^\x{00}-\x{FF}]", "")
