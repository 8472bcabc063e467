"""Secret scan with multipart credential linking.

Strong patterns (assignments of long values, access keys, long hex strings) are reported wherever they stand. Weak
candidates are everyday text on their own: short passwords, user names, addresses, random-looking words. They are
reported only where the parts that complete them to a credential stand nearby.

1. *Scan.* Each text is scanned where it is read; one row per document with its parts (kind, role, interval, scope) is
   written. Scopes are the blocks between blank lines. A weak candidate that overlaps a strong span or a match of a weak
   kind listed earlier is no part.
2. *Link.* Parts of documents that have candidates and other parts become rows. Intervals join inside (document, scope):
   some part of a role lies within ``reach`` code points of an interval exactly if the furthest end before it, or the
   first start after it, does. Two running aggregates per role answer that, so no pairs are made. A secret needs an
   identifier, an identifier a secret, an endpoint needs both; candidates may complete each other.
3. *Report.* Spans of a document are gathered again. A task never holds more than the parts of one document at a time.

Intervals count code points, the end is exclusive. Defined results: null and empty texts have no parts; every row counts
for itself, also with null or repeated ids; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import stored

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
USER = re.compile(r"""(?ai)(?:username|user_?id|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""")
ENDPOINT = re.compile(r"""(?ai)(?:https?|ftp|ssh|postgresql|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"""
                      r"""|(?:hostname|host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""")
BLOB = re.compile(r"[A-Za-z0-9+/_-]{20,}")
BLANK = re.compile(r"\n(?:[\x20\x09\x0B-\x0D]*\n)+")

STRONG = ("assign", "access", "hex")
WEAK = ("short", "key_id", "user", "endpoint", "blob")
ROLES = {"assign": "secret", "hex": "secret", "short": "secret", "blob": "secret",
         "access": "identifier", "key_id": "identifier", "user": "identifier", "endpoint": "endpoint"}
REACH = 200

PART = "struct<kind: string, start: long, end: long, scope: long>"


def _mixed(word: str) -> bool:
    return any("a" <= c <= "z" for c in word) and any("A" <= c <= "Z" for c in word) and any("0" <= c <= "9" for c in word)


def matches(text: str) -> dict[str, list[tuple[int, int]]]:
    """Intervals per kind, before overlaps are resolved."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in STRONG + WEAK}
    for m in ASSIGN.finditer(text):
        size = m.end(2) - m.start(2)
        if size >= 6:
            found["assign" if size >= 12 else "short"].append(m.span())
    for m in ACCESS.finditer(text):
        size = m.end() - m.start()
        if size >= 12:
            found["access" if size >= 18 else "key_id"].append(m.span())
    # A greedy run of 16 or more characters is a match of the shorter pattern that passes.
    found["hex"] = [m.span() for m in LONG_HEX.finditer(text)]
    found["user"] = [m.span() for m in USER.finditer(text)]
    found["endpoint"] = [m.span() for m in ENDPOINT.finditer(text)]
    found["blob"] = [m.span() for m in BLOB.finditer(text) if _mixed(m.group())]
    return found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def parts(text: str) -> list[tuple[str, int, int, int]]:
    """Strong spans, and weak candidates that overlap nothing listed before them, with their scopes."""
    found = matches(text)
    bounds = [m.start() for m in BLANK.finditer(text)]
    out = [(k, s, e) for k in STRONG for s, e in found[k]]
    taken = _union([(s, e) for _, s, e in out])
    for kind in WEAK:
        starts = [s for s, _ in taken]
        for s, e in found[kind]:
            before = bisect_left(starts, e) - 1
            if before < 0 or taken[before][1] <= s:
                out.append((kind, s, e))
        if found[kind]:
            taken = _union(taken + found[kind])
    return [(k, s, e, bisect_right(bounds, s)) for k, s, e in out]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "scope"), p)) for p in parts(t)] if t else [] for t in batch["text"]]
        yield pd.DataFrame({"key": batch["key"], "parts": found})


def _order(kind: Column) -> Column:
    return F.array_position(F.lit([*STRONG, *WEAK]), kind)


def _of(kinds: Sequence[str]) -> Callable[[Column], Column]:
    return lambda p: p["kind"].isin(*kinds)


def _some(kinds: Sequence[str]) -> Column:
    return F.exists("parts", _of(kinds))


def linked(rows: DataFrame, reach: int) -> DataFrame:
    """(r, links): weak candidates with complementary parts within reach, for rows (r, parts)."""
    identifiers, secrets = ([k for k in ROLES if ROLES[k] == role] for role in ("identifier", "secret"))
    worth = rows.filter(_some(WEAK) & _some(identifiers) & _some(secrets))
    part = worth.select("r", F.explode("parts").alias("p")).select("r", "p.*")
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("kind"))
    by = W.partitionBy("r", "scope").orderBy("start", "end", _order(F.col("kind")))
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(1, W.unboundedFollowing)
    part = part.withColumn("role", role)
    for r in ("identifier", "secret"):
        own = F.col("role") == r
        part = part.withColumn(r, F.coalesce(F.col("start") - F.max(F.when(own, F.col("end"))).over(before) <= reach, F.lit(False))
                               | F.coalesce(F.min(F.when(own, F.col("start"))).over(after) - F.col("end") <= reach, F.lit(False)))
    needs = (F.when(F.col("role") == "secret", F.col("identifier")).when(F.col("role") == "identifier", F.col("secret"))
             .otherwise(F.col("identifier") & F.col("secret")))
    hits = part.filter(F.col("kind").isin(*WEAK) & needs)
    return hits.groupBy("r").agg(F.collect_list(F.struct("kind", "start", "end", "scope")).alias("links"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: key, ``strong`` and ``links``, arrays of (kind, start, end, scope); see the module's text."""
    scanned = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = scanned.schema["key"].dataType.simpleString()
    rows = stored(scanned.mapInPandas(_scan, f"key {kind}, parts array<{PART}>").withColumn("r", F.monotonically_increasing_id()), "parts")
    out = rows.join(linked(rows, reach), "r", "left")
    return out.select("key", F.filter("parts", _of(STRONG)).alias("strong"),
                      F.coalesce("links", F.array().cast(f"array<{PART}>")).alias("links"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda p: F.struct(p["start"], _order(p["kind"]), p["end"], p["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of strong spans, their digest, and all spans, per row of ``documents``."""
    count = {k: F.size(F.filter("strong", _of([k]))).cast("long") for k in STRONG}
    return find(docs).select(F.col("key").alias("doc_id"), *[count[k].alias(f"n_{k}") for k in STRONG],
                             F.sha2(listed(F.col("strong")).cast("binary"), 256).alias("base_sha256"),
                             listed(F.concat("strong", "links")).alias("spans"))
