"""Column expressions over text: token estimates, normalisers, identifiers, hashing, redaction."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F

# Words that are never identifiers.
KEYWORDS = ("return", "await", "throw", "true", "false", "null", "none", "self", "this", "let", "const", "var",
            "if", "else", "for", "while", "switch", "case", "try", "catch", "finally", "new")

# Separators before a negated tail, in the order they are tried.
NEGATIONS = (", not ", " but not ", " rather than ")


def estimate_tokens(text: Column, unit: str = "chars", divisor: int = 3, floor: bool = False, least: int = 0) -> Column:
    """Token estimate from characters or bytes, rounded up (or down) and at least ``least``."""
    size = F.length(text) if unit == "chars" else F.octet_length(text)
    value = F.floor(size / divisor) if floor else F.ceil(size / divisor)
    return F.greatest(value, F.lit(least).cast("bigint"))


def normalise_query(text: Column) -> Column:
    """Lower case; every run of other characters becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalise_camel(text: Column) -> Column:
    """Like ``normalise_query`` after splitting camelCase words."""
    return normalise_query(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))


def words(text: Column) -> Column:
    """Tokens of a normalised text; empty text has none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def clip_negation(text: Column) -> Column:
    """Head before the first separator type that occurs; an empty head keeps the text."""
    out = F.trim(text)
    for sep in reversed(NEGATIONS):
        head = F.trim(F.substring_index(text, sep, 1))
        out = F.when(F.contains(text, F.lit(sep)) & (head != ""), head).otherwise(out)
    return out


def identifiers(text: Column) -> Column:
    """Distinct lower-case identifiers of two or more characters without keywords and numbers."""
    parts = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(*KEYWORDS) & ~w.rlike("^[0-9]+$")))


def assignment_sides(text: Column) -> tuple[Column, Column]:
    """Identifiers before and after the first equals sign."""
    at = F.instr(text, "=")
    return (identifiers(F.substring_index(text, "=", 1)),
            identifiers(F.when(at > 0, text.substr(at + 1, F.length(text))).otherwise("")))


def stack_symbols(frames: Column) -> Column:
    """Sorted distinct symbol names in an array of stack frames."""
    flat = F.flatten(F.transform(frames, lambda f: F.split(F.regexp_replace(f, r"\(|\)|::", " "), r"\s+")))
    bare = F.transform(flat, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.contains("/") & ~w.contains("\\")
                    & ~w.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(kept))


def normalise_error(message: Column) -> Column:
    """Replace paths, addresses and numbers so that equal failures share one text."""
    parts = F.filter(F.split(F.trim(message), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.when(
        w.rlike(r"^(/|\\|0x)") | w.rlike("^[0-9:]+$"), F.lit("<_>")).otherwise(w)), " ")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def nesting_depth(text: Column) -> Column:
    """Deepest level counted over ``{`` and ``:`` against ``}`` and line ends."""
    marks = F.split(F.regexp_replace(text, r"[^{:}\n]", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, ch: Column) -> Column:
        d = F.when(ch.isin("{", ":"), acc["d"] + 1).when(ch.isin("}", "\n"), F.greatest(acc["d"] - 1, F.lit(0))).otherwise(acc["d"])
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    return F.aggregate(marks, start, step, lambda a: a["m"])


# Key fragments of secrets, of payload text and of locations.
SECRET_KEYS = ("api_key", "authorization", "auth_header", "bridge_token")
TEXT_KEYS = ("prompt", "content", "output")
PATH_KEYS = ("path", "file")


def _mentions(key: str, fragments: tuple[str, ...]) -> bool:
    return any(f in key.lower() for f in fragments)


def _shorten(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[:limit] + "..."


def _redact(node, level: str):
    if isinstance(node, list):
        return [_redact(item, level) for item in node]
    if isinstance(node, str):
        return _shorten(node, 32) if level == "strict" and len(node) > 120 else node
    if not isinstance(node, dict):
        return node
    kept = {k: v for k, v in node.items() if not _mentions(k, SECRET_KEYS)}
    if level != "debug":
        limit = 120 if level == "balanced" else None
        kept = {k: (_shorten(v, limit) if _mentions(k, TEXT_KEYS) else v) for k, v in kept.items()
                if not _mentions(k, TEXT_KEYS) or (limit and isinstance(v, str))}
    return {k: _redact_entry(k, v, level) for k, v in kept.items()}


def _redact_entry(key: str, value, level: str):
    if level != "debug" and _mentions(key, TEXT_KEYS):
        return value
    if _mentions(key, PATH_KEYS) and isinstance(value, str):
        return value if level == "debug" else "path:" + hashlib.sha256(value.encode()).hexdigest()[:16]
    return _redact(value, level)


def redact_json(level: str = "balanced"):
    """Vectorised function that redacts arbitrarily nested JSON metadata."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(_redact(json.loads(text), level), sort_keys=True)
            except ValueError:
                return "{}"
        return raw.map(one)

    return run
