"""Substring dedup by MinHash banding over paragraphs.

A paragraph is a line. Paragraphs of at least ``least`` words are sets of five-word shingles; their MinHash
values are banded so that a pair of similarity 0.8 shares a band with a probability above 99 %
(``band_recall`` tells, ``tune_bands`` picks). Paragraphs that collide are checked by exact Jaccard
similarity and clustered by connected components.

A passage can also stand anywhere else: inside a paragraph, across short lines, from mid-sentence on. A text is
therefore one stream of words. Of its windows of ``group`` words those with the locally smallest hash are
anchors; any ``SURE`` equal words hold an anchor that both places choose. Around anchors that occur more than
once, every window is looked up, so a stretch of words whose windows occur elsewhere is known to the word.
Stretches that an edit parts make up one passage if, edit included, its shingles still reach the similarity.

Neighbouring paragraphs and stretches that occur elsewhere make up a passage. Passages of at least ``passage``
words are removed except for what occurs there first, in the order of id and place; shorter ones, such as a
common heading or a stock phrase, stay.

What is shuffled are hashes and places; texts move only for one representative of each paragraph that
collides with a different one, and for texts with a repeated anchor.

Defined results: null, empty and blank texts have no paragraphs; a paragraph with fewer words than a shingle
never qualifies; repeats inside one document count like those between documents; rows that repeat an id are
separate texts; a null id is a value of its own and comes first; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import keyed, possible, stored
from .ngram_join import LOWER, WORDS, linked_sets, mix, parity_sketch, shared_signatures, shingles, wide_sketch, window_hashes

SURE = 20  # words: equal stretches at least as long share an anchor
REACH = 32  # words around a repeated anchor that are looked up; more than SURE, to pass an edit
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def band_recall(similarity: float, bands: int, rows: int) -> float:
    """Chance that a pair of the given similarity shares at least one band."""
    return 1 - (1 - similarity ** rows) ** bands


def tune_bands(similarity: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes that reaches the recall."""
    fit = [(r, b) for r in range(1, most + 1) for b in range(1, most // r + 1) if band_recall(similarity, b, r) >= recall]
    r, b = max(fit, key=lambda x: (x[0], -x[1]))
    return b, r


def band_values(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band values (sets x bands) of the sets that lie one after the other in ``values``; repeats do no harm."""
    # The values are hashes already, so an odd factor is enough to give another order.
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    least = np.stack([np.minimum.reduceat(values * f, starts) for f in factors], 1).reshape(len(starts), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(starts), bands))
    for k in range(rows):
        out = mix(out * np.uint64(31) + least[:, :, k])
    return out


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


def anchors(x: np.ndarray, width: int) -> np.ndarray:
    """Places of the values that are the smallest of some ``width`` consecutive ones, ties included."""
    if len(x) < width:
        return np.empty(0, np.int64)
    none = np.zeros(width - 1, x.dtype)
    return np.flatnonzero(x == _sliding(np.concatenate([none, _sliding(x, width, np.minimum), none]), width, np.maximum))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.int64, len(words)).view(np.uint64)


def units_of(raw: bytes, least: int, group: int, size: int, bands: int, rows: int) -> tuple[list[tuple], list]:
    """Paragraphs of at least ``least`` words: (start, end, first word, words, node), with the band values of each;
    anchors: (0, 0, first word, ``group``, node), with none."""
    out, values, at, before, every, texts = [], [], 0, 0, [], []
    for line in raw.translate(LOWER).split(b"\n"):
        words = line.split()
        if words:
            every += words
            if len(words) >= least:
                out.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip()), before, len(words)))
            before += len(words)
        at += len(line) + 1
    if not every:
        return [], []
    h = word_hashes(every)
    if out:
        windows = window_hashes(h, size)
        for _, _, first, n in out:
            texts.append(windows[first:first + n - size + 1] if n >= size else window_hashes(h[first:first + n], size))
        starts = np.cumsum([0, *map(len, texts[:-1])])
        values = [v.view(np.int64) for v in band_values(np.concatenate(texts), starts, bands, rows)]
        out = [(*u, xxhash.xxh3_64_intdigest(np.unique(s).tobytes()) - (1 << 63)) for u, s in zip(out, texts)]
    if len(h) >= SURE:
        found = window_hashes(h, group)
        places = anchors(found, SURE - group + 1)
        out += [(0, 0, i, group, v) for i, v in zip(places.tolist(), found[places].view(np.int64).tolist())]
        values += [None] * len(places)
    return out, values


def stretch_windows(raw: bytes, places: list[int], group: int) -> list[tuple]:
    """(start, end, first word, words, node) of every window of ``group`` words near the given ones."""
    spans = [m.span() for m in WORD.finditer(raw)]
    found = window_hashes(word_hashes(raw.translate(LOWER).split()), group).view(np.int64)
    near = np.zeros(len(found), bool)
    for i in places:
        near[max(0, i - REACH):i + REACH + 1] = True
    return [(spans[i][0], spans[i + group - 1][1], i, group, int(found[i])) for i in np.flatnonzero(near).tolist()]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


UNIT = "start int, end int, at int, words int, node long"


def text_units(docs: DataFrame, text: str, least: int, group: int, size: int, bands: int, rows: int) -> DataFrame:
    """(_k, start, end, at, words, node, bands): paragraphs of enough words with their band values, anchors with
    none; ``node`` tells equal ones, ``at`` counts the words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                batch = whole.slice(at, 300)
                owner, out, values = [], [], []
                for i, raw in enumerate(_column(batch, text).cast(pa.binary()).to_pylist()):
                    found, bands_of = units_of(raw or b"", least, group, size, bands, rows)
                    owner += [i] * len(found)
                    out += found
                    values += bands_of
                if out:
                    yield _unit_batch(batch, owner, out, [pa.array(values, pa.list_(pa.int64()))], ["bands"])

    kind = docs.schema["_k"].dataType.simpleString()
    return docs.select("_k", text).mapInArrow(run, f"_k {kind}, {UNIT}, bands array<long>")


def _unit_batch(batch: pa.RecordBatch, owner: list[int], out: list[tuple], more: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*out))
    return pa.RecordBatch.from_arrays(
        [_column(batch, "_k").take(pa.array(owner)), *[pa.array(c, pa.int32()) for c in cols[:4]], pa.array(cols[4], pa.int64()), *more],
        names=["_k", "start", "end", "at", "words", "node", *names])


def repeated_windows(docs: DataFrame, marks: DataFrame, text: str, group: int) -> DataFrame:
    """(_k, start, end, at, words, node) of the windows around the anchors ``marks`` that occur more than once."""
    shared = stored(marks.groupBy("node").count().filter("count > 1").select("node"), "shared")
    hits = possible(marks.select("_k", "at", "node"), "node", shared, 1 << 26).join(shared, "node")
    own = stored(hits.groupBy("_k").agg(F.collect_set("at").alias("_at")), "anchors")
    rows = possible(docs.select("_k", text), "_k", own).join(own, "_k").dropDuplicates(["_k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                owner, out = [], []
                for i, (raw, places) in enumerate(zip(_column(batch, text).cast(pa.binary()).to_pylist(), _column(batch, "_at").to_pylist())):
                    found = stretch_windows(raw, places, group)
                    owner += [i] * len(found)
                    out += found
                if out:
                    yield _unit_batch(batch, owner, out, [], [])

    kind = docs.schema["_k"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"_k {kind}, {UNIT}"), "windows")


def _paragraph_sets(docs: DataFrame, places: DataFrame, text: str, size: int) -> DataFrame:
    """(node, n, sketch, wide, elements) of the paragraphs at the given places (_k, start, end, node)."""
    own = places.groupBy("_k").agg(F.collect_list(F.struct("start", "end", "node")).alias("_own"))
    rows = possible(docs.select("_k", text), "_k", places).join(own, "_k").dropDuplicates(["_k"])
    rows = rows.select(text, *[F.col(f"_own.{c}").alias(f"_{c}") for c in ("start", "end", "node")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                raws = _column(batch, text).cast(pa.binary()).to_pylist()
                lists = [_column(batch, f"_{c}").to_pylist() for c in ("start", "end", "node")]
                found = [(node, shingles(raw[a:b], size)) for k, raw in enumerate(raws) for a, b, node in zip(*(c[k] for c in lists))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()),
                     pa.array([parity_sketch(s) for _, s in found], pa.list_(pa.int64())),
                     pa.array([wide_sketch(s) for _, s in found], pa.list_(pa.int64())),
                     pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], names=["node", "n", "sketch", "wide", "elements"])

    return rows.mapInArrow(run, "node long, n long, sketch array<long>, wide array<long>, elements array<long>")


def repeated_units(docs: DataFrame, text: str = "text", least: int = 20, group: int = 8, size: int = 5, percent: int = 80,
                   recall: float = 0.99, hashes: int = 24) -> DataFrame:
    """(_k, start, end, at, words, first, source, there, until) of every paragraph and window that occurs more than once.

    ``source`` and ``there`` tell the text and word where it occurs first, ``until`` the end of that if it is the
    same text, else -1.
    """
    bands, rows = tune_bands(percent / 100, recall, hashes)
    units = stored(text_units(docs, text, least, group, size, bands, rows), "units")
    long = units.filter("bands IS NOT NULL")
    members = shared_signatures(long.select("node", F.explode("bands").alias("sig")))
    place = F.struct("_k", "start", "end", "at")
    places = long.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min(place).alias("p")).select("node", "p.*")
    sets = stored(_paragraph_sets(docs, stored(places, "places"), text, size), "elements")
    label = linked_sets(members, sets.select("node", "n", "sketch", "wide"), lambda some: sets.join(some, "node").select("node", "elements"), percent)
    counted = long.groupBy("node").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # A node without a link is its own cluster; only nodes that occur again or are linked are of interest.
    classes = counted.join(label, "node", "left").filter("n > 1 OR root IS NOT NULL").withColumn("cluster", F.coalesce("root", "node"))
    classes = stored(classes.select("node", "cluster", "first"), "classes")
    firsts = classes.groupBy("cluster").agg(F.min("first").alias("first"))
    classes = classes.drop("first").join(firsts, "cluster").select("node", "first")
    columns = ("_k", "start", "end", "at", "words", "node")
    found = possible(long.select(*columns), "node", classes, 1 << 26).join(classes, "node")
    windows = repeated_windows(docs, units.filter("bands IS NULL"), text, group)
    again = stored(windows.groupBy("node").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("node", "first"), "again")
    found = found.unionByName(possible(windows, "node", again, 1 << 26).join(again, "node"))
    return found.select("_k", "start", "end", "at", "words", place.eqNullSafe(F.col("first")).alias("first"), F.xxhash64("first._k").alias("source"),
                        F.col("first.at").alias("there"), F.when(F.col("_k").eqNullSafe(F.col("first._k")), F.col("first.end")).otherwise(-1).alias("until"))


COLUMNS = ("start", "end", "at", "words", "first", "source", "there", "until")


class _Stretch:
    """Repeated words without a gap, or with gaps that are edits."""

    def __init__(self, unit: tuple, size: int):
        self.head = self.tail = unit
        self.at, self.stop, self.size = unit[2], unit[2] + unit[3], size
        self.units, self.edits, self.words, self.kept = [unit], [], 0, 0

    def add(self, unit: tuple) -> None:
        self.units.append(unit)
        if unit[2] + unit[3] > self.stop:
            self.stop, self.tail = unit[2] + unit[3], unit

    def close(self) -> "_Stretch":
        self.words = self.stop - self.at
        self.kept = max(0, self.words - self.size + 1)  # shingles
        return self

    def reaches(self, right: "_Stretch", percent: int) -> bool:
        """Whether both and the words between still have the similarity to a text that differs only there."""
        same, every = self.kept + right.kept, right.stop - self.at - self.size + 1
        return same * 100 >= (2 * every - same) * percent

    def join(self, right: "_Stretch") -> None:
        a, b = self.tail, right.head
        apart = abs((b[2] - b[6]) - (a[2] - a[6]))
        if a[5] == b[5] and not a[4] and not b[4] and b[6] > a[6] and apart <= right.at - self.stop + a[3]:
            self.edits.append((a[1], b[0]))
        self.units += right.units
        self.edits += right.edits
        self.words += right.words
        self.kept += right.kept
        self.stop, self.tail = right.stop, right.tail


def _stretches(units: list[tuple], size: int, percent: int) -> list[_Stretch]:
    out: list[_Stretch] = []
    for u in sorted(units, key=lambda u: (u[2], -u[3])):
        if out and u[2] <= out[-1].stop:
            out[-1].add(u)
        else:
            out.append(_Stretch(u, size))
    out = [s.close() for s in out]
    while True:
        joined = out[:1]
        for s in out[1:]:
            if joined[-1].reaches(s, percent):
                joined[-1].join(s)
            else:
                joined.append(s)
        if len(joined) == len(out):
            return out
        out = joined


def _passages(batch: pa.RecordBatch, passage: int, size: int, percent: int) -> list[tuple]:
    """Per document: repeated passages, those of which something is removed, removed spans."""
    lists = [_column(batch, f"_{c}").to_pylist() for c in COLUMNS]
    out = []
    for own in zip(*lists):
        if own[0] is None:
            out.append((0, 0, [], []))
            continue
        kept = [s for s in _stretches(list(zip(*own)), size, percent) if s.words >= passage]
        gone, n_gone = [], 0
        for s in kept:
            # What occurs first stays whole, also where a repeat of it overlaps it.
            cut = [(max(u[0], u[7]), u[1]) for u in s.units if not u[4] and u[7] < u[1]]
            n_gone += bool(cut)
            gone += cut + s.edits
        spans: list[list[int]] = []
        for a, b in sorted(gone):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        out.append((len(kept), n_gone, [a for a, _ in spans], [b for _, b in spans]))
    return out


def removable(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int = 30, **options) -> DataFrame:
    """(key, n_paragraphs, n_repeated, n_removed, removed_bytes, starts, ends) of every document.

    ``starts`` and ``ends`` are byte places in the UTF-8 text; ``n_repeated`` counts the repeated
    passages, ``n_removed`` those that occurred before, at least in part.
    """
    rows = keyed(docs.select(key, text), key, text)
    found = repeated_units(rows, text, **options)
    lists = found.groupBy("_k").agg(F.collect_list(F.struct(*COLUMNS)).alias("_own")).select("_k", *[F.col(f"_own.{c}").alias(f"_{c}") for c in COLUMNS])
    size, percent = options.get("size", 5), options.get("percent", 80)
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    small = rows.select(key, "_k", lines.alias("n_paragraphs")).join(lists, "_k", "left").drop("_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = _passages(batch, passage, size, percent)
            cols = list(zip(*done)) or [()] * 4
            removed = [sum(b) - sum(a) for a, b in zip(cols[2], cols[3])]
            yield pa.RecordBatch.from_arrays(
                [_column(batch, key), _column(batch, "n_paragraphs"), *[pa.array(c, pa.int64()) for c in (*cols[:2], removed)],
                 *[pa.array(c, pa.list_(pa.int32())) for c in cols[2:]]],
                names=[key, "n_paragraphs", "n_repeated", "n_removed", "removed_bytes", "starts", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return small.mapInArrow(
        run, f"{key} {kind}, n_paragraphs long, n_repeated long, n_removed long, removed_bytes long, starts array<int>, ends array<int>")


def cut(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    """A text without the given spans; a line of which nothing is left goes with its line break."""
    if not starts:
        return raw
    edges = [0, *[x for pair in zip(starts, ends) for x in pair], len(raw)]
    left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return b"\n".join(x for x in left.split(b"\n") if x.strip())
