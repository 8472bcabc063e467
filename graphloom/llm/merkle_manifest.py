"""Merkle manifest of a dataset, built by incremental witnesses.

Every row becomes a leaf. The leaves of a source, ascending by key, are appended to a tree whose nodes hash up to three
consecutive children; the roots of the sources, in their order, are appended to a tree above. A witness is what proves
that a leaf is below the root: on each level the digests of its siblings and its place among them.

* Leaves are hashed where the table is read; no text is shuffled. Positions come from a range sort of the leaves and
  prefix sums over its partitions, so a source that holds most rows is spread like any other.
* A block is an aligned subtree of ``FANOUT ** DEPTH`` positions. One pass appends the leaves of a block one by one:
  three nodes that stand open on a level close into their parent, and the witnesses below all three are extended by
  their siblings. Blocks are independent and never larger than that, whatever the source.
* Block roots are further appends of the next round, until each source has one root; so are the sources' roots. Each
  round is a table of its own, and witnesses are extended downwards by joins on (source, block).

Defined results: null fields are hashed as ``-``; rows whose source is null are a source of their own, the first;
null keys come first. Rows equal in source, key and leaf stand next to each other and each has its own witness. An
empty table gives an empty manifest. Only named columns are read, so further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from .common import stored

FANOUT = 3
DEPTH = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each ``-`` or its byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]).cast("binary"), 256)


class Frontier:
    """Open subtrees of a tree under construction, with partial witnesses of all leaves appended so far.

    ``shape[i]`` has a byte per closed level, four times the place in the run plus the run's length; ``siblings[i]``
    the digests of the run's others, left to right.
    """

    def __init__(self) -> None:
        self.open: list[list[tuple[str, int, int]]] = [[]]
        self.shape: list[bytearray] = []
        self.siblings: list[bytearray] = []

    def append(self, leaf: str) -> None:
        at = len(self.shape)
        self.shape.append(bytearray())
        self.siblings.append(bytearray())
        self._push(0, (leaf, at, at + 1))

    def _push(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FANOUT:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        raw = [bytes.fromhex(d) for d, _, _ in run]
        for j, (_, low, high) in enumerate(run):
            others, mark = b"".join(raw[:j] + raw[j + 1:]), 4 * j + len(run)
            for i in range(low, high):
                self.shape[i].append(mark)
                self.siblings[i] += others
        self._push(level + 1, (digest([d for d, _, _ in run]), run[0][1], run[-1][2]))

    def finish(self, depth: int | None) -> str:
        """Close what is open: up to level ``depth`` inside a larger tree, else until one node remains. Returns it."""
        level = 0
        while True:
            above = any(self.open[level + 1:])
            if level == depth or (depth is None and not above and len(self.open[level]) == 1):
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
            level += 1


def fold(leaf: str, shape: bytes, siblings: bytes) -> str:
    """Root that a leaf and its witness lead to."""
    at, now = 0, leaf
    for mark in shape:
        place, size = divmod(mark, 4)
        run = [siblings[at + 32 * j:at + 32 * (j + 1)].hex() for j in range(size - 1)]
        at += 32 * (size - 1)
        run.insert(place, now)
        now = digest(run)
    return now


def placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place within ``g`` by ``order``, and ``n``, the size of ``g``. Equal rows are ranked arbitrarily.

    ``df`` must be a stored table: the number that spreads equal rows over partitions must not change when a task is
    repeated.
    """
    keys = ["g", *order, "_s"]
    ranged = df.withColumn("_s", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.select(*df.columns, F.monotonically_increasing_id().alias("_m"), F.spark_partition_id().alias("_p")), "ranged")
    runs = ranged.groupBy("g", "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))
    ahead = W.partitionBy("g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("g", "_p", (F.coalesce(F.sum("_c").over(ahead), F.lit(0)) - F.col("_first")).alias("_add"),
                       F.sum("_c").over(W.partitionBy("g")).alias("n"))
    return ranged.join(runs, ["g", "_p"]).select(*df.columns, (F.col("_m") + F.col("_add")).alias("pos"), "n")


def append_blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """Add ``b``, the block of each node, its witness ``shape`` and ``siblings`` inside the block, and the block's ``top``."""
    cut = nodes.withColumn("b", F.expr(f"pos div {FANOUT ** depth}"))
    schema = T.StructType([*cut.schema.fields, T.StructField("shape", T.BinaryType()), T.StructField("siblings", T.BinaryType()),
                           T.StructField("top", T.StringType())])

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = Frontier()
        for d in rows["d"]:
            tree.append(d)
        top = tree.finish(depth if rows["n"].iloc[0] > FANOUT ** depth else None)
        return rows.assign(shape=[bytes(s) for s in tree.shape], siblings=[bytes(s) for s in tree.siblings], top=top)

    return cut.groupBy("g", "b").applyInPandas(block, schema)


def grown(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of all rounds, and (g, d) with the root of each group. ``nodes``: g, pos, n, d and further columns."""
    rounds = []
    while True:
        rounds.append(stored(append_blocks(nodes, depth), "witnesses"))
        nodes = rounds[-1].groupBy("g", "b").agg(F.max("top").alias("d"), F.max("n").alias("n"))
        nodes = nodes.select("g", F.col("b").alias("pos"), F.expr(f"(n - 1) div {FANOUT ** depth} + 1").alias("n"), "d")
        if not nodes.filter("n > 1").head(1):
            return rounds, nodes.select("g", "d")


def extended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's rows with whole witnesses. ``above``: per g, what extends the witness of its root, and columns to add."""
    extra = [c for c in above.columns if c not in ("g", "shape", "siblings")]
    upper, on = above, ["g"]
    for i, now in reversed(list(enumerate(rounds))):
        up = upper.withColumnsRenamed({"shape": "_shape", "siblings": "_siblings"})
        kept = ["g", "pos"] if i else [c for c in now.columns if c not in ("b", "top", "shape", "siblings")]
        upper = now.join(up, on).select(*kept, F.concat("shape", "_shape").alias("shape"),
                                        F.concat("siblings", "_siblings").alias("siblings"), *extra)
        if i:
            upper, on = upper.withColumnRenamed("pos", "b"), ["g", "b"]
    return upper


def witnesses(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Witness of each leaf. ``leaves``: source, key, leaf and further columns; adds subroot, root, shape and siblings."""
    base = stored(leaves.withColumn("g", F.when(F.isnull("source"), "").otherwise(F.concat(F.lit("="), "source"))), "leaves")
    own = placed(base, ["key", "leaf"]).withColumn("d", F.col("leaf"))
    rounds, roots = grown(own, depth)
    tops = stored(roots.select(F.lit("").alias("g"), F.col("g").alias("member"), "d"), "subroots")
    upper_rounds, root = grown(placed(tops, ["member"]), depth)
    nothing = root.select("g", F.lit(b"").alias("shape"), F.lit(b"").alias("siblings"), F.col("d").alias("root"))
    above = extended(upper_rounds, nothing)
    above = above.select(F.col("member").alias("g"), "shape", "siblings", F.col("d").alias("subroot"), "root")
    return extended(rounds, above).drop("g", "pos", "n", "d")


@F.pandas_udf(T.StringType())
def folded(leaf: pd.Series, shape: pd.Series, siblings: pd.Series) -> pd.Series:
    return pd.Series([fold(*row) for row in zip(leaf, shape, siblings)], dtype=object)


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, depth: int = DEPTH) -> DataFrame:
    """Per row: key, source, leaf, subroot, root, and the witness (``shape``, ``siblings``); see the module's text."""
    return witnesses(docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                                 leaf_digest([F.col(c) for c in fields]).alias("leaf")), depth)


def audit(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Manifest of ``documents``, and what its witnesses say after line feeds were deleted from rows with an even CRC.

    A row with a null id counts as untouched.
    """
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    leaves = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("source"), leaf_digest(fields).alias("leaf"),
                         F.when(text != F.col("text"), leaf_digest([*fields[:-1], text])).alias("bent"))
    out = witnesses(leaves, depth).withColumn("folded_root", folded(F.coalesce("bent", "leaf"), "shape", "siblings"))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                      F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
