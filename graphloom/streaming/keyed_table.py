"""A table that merges by key, kept as runs: micro-batches append, reads merge, full runs are merged in the background.

What a micro-batch writes follows the micro-batch, not the table. Every batch becomes a run; ``FAN_IN`` runs of one
level become one run of the next, so a row is written once per level, of which there are log(batches) to the base of
``FAN_IN``. The function that merges rows must give the same result however they are grouped and must be harmless on
what it has already merged: last change wins, sums of counters, newest of each key.

Rows carry the bucket of their key and runs are written as folders per bucket, so a read for a few keys opens only their
buckets. A run's folder names its level and the batches it covers. It counts once its success marker is there; runs
that a higher one covers are ignored, and deleted one batch later. A replayed batch finds its own run and leaves it, or
overwrites one without a marker, and a batch that a merged run covers is not written again: restarts change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import discard
from .jobs import drain

FAN_IN = 8
BUCKETS = 16

Merge = Callable[[DataFrame], DataFrame]


class Run(NamedTuple):
    level: int
    first: int
    last: int

    @property
    def folder(self) -> str:
        return f"run-{self.level}-{self.first}-{self.last}"

    def covers(self, other: Run) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


class KeyedTable:
    """``merge`` reduces all rows of a key to what is kept of it. ``forget`` drops rows nobody needs any more; it is
    applied only where all older runs take part, so that what it drops cannot come back (removals, old counters)."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], merge: Merge, forget: Merge | None = None,
                 fan_in: int = FAN_IN, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.merge, self.forget = spark, root, keys, merge, forget
        self.fan_in, self.buckets = fan_in, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def all_runs(self) -> list[Run]:
        """Committed runs, covered ones included."""
        place = self._path("")
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(place):
            return []
        names = [f.getPath().getName() for f in store.listStatus(place)]
        return sorted((Run(*map(int, n.split("-")[1:])) for n in names if n.startswith("run-") and store.exists(self._path(f"{n}/_SUCCESS"))),
                      key=lambda r: (r.first, -r.level))

    def runs(self) -> list[Run]:
        """Runs that make up the table, oldest first."""
        every = self.all_runs()
        return [r for r in every if not any(o.covers(r) for o in every)]

    def _rows(self, runs: list[Run]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema).withColumn("bucket", self._bucket())
        for r in runs:
            out = out.unionByName(self.spark.read.schema(out.schema).parquet(f"{self.root}/{r.folder}"))
        return out

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The merged table, or only rows of the given keys, from their buckets."""
        rows = self._rows(self.runs())
        if keys is not None:
            wanted = keys.select(*self.keys).distinct()
            # At most as many numbers as there are buckets.
            rows = rows.filter(F.col("bucket").isin([r[0] for r in wanted.select(self._bucket()).distinct().collect()]))
            rows = rows.join(wanted, self.keys, "left_semi")
        return self.merge(rows.drop("bucket")).select(*self.schema.names)

    def _write(self, rows: DataFrame, run: Run) -> None:
        out = rows.select(*self.schema.names).withColumn("bucket", self._bucket())
        out.repartition("bucket", F.pmod(F.xxhash64(*self.keys, F.lit(7)), F.lit(self.buckets))).write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{self.root}/{run.folder}")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add the rows of a micro-batch as a run of their own, then merge runs where enough have gathered."""
        every = self.all_runs()
        for r in every:
            if any(o.covers(r) for o in every):
                discard(self.spark, f"{self.root}/{r.folder}")
        if not any(r.first <= batch_id <= r.last for r in every):
            self._write(self.merge(batch.select(*self.schema.names)), Run(0, batch_id, batch_id))
        self.compact()

    def compact(self) -> None:
        level = 0
        while True:
            runs = self.runs()
            group = [r for r in runs if r.level == level]
            if len(group) >= self.fan_in:
                rows = self.merge(self._rows(group).drop("bucket"))
                if self.forget and group[0] == runs[0]:
                    rows = self.forget(rows)
                self._write(rows, Run(level + 1, group[0].first, group[-1].last))
            elif level >= max((r.level for r in runs), default=0):
                return
            level += 1

    def run(self, stream: DataFrame, checkpoint: str, prepare: Merge | None = None) -> DataFrame:
        """Take in what the stream has and return the merged table."""
        def step(batch: DataFrame, batch_id: int) -> None:
            self.append(prepare(batch) if prepare else batch, batch_id)

        drain(stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        return self.read()
