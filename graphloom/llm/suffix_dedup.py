"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

A window is the first ``window`` bytes of a suffix; windows are equal exactly when their suffixes fall into
one group after a radix sort to that depth. The sort runs most significant digit first, and a pass only
touches the suffixes that an earlier pass left in a group of two or more:

1. The first digit is the ``gram``-byte string with the smallest hash inside the window. Equal windows pick
   equal digits at equal offsets, and consecutive suffixes mostly share one, so a run of suffixes is one row
   (about 1.3 rows per 100 bytes) instead of one row per byte. Runs whose digit is unique leave here.
2. The second digit is everything that the run's windows cover. If two runs agree on it, all their windows
   repeat; if all runs of a digit agree, the group is finished.
3. Only the digits with different runs, at the edges of repeated passages, are refined to single suffixes:
   the last digit is the window itself, and equal groups are exactly the repeated windows.

Digits are 64-bit hashes; a group is always told apart by two of them together.

Each byte covered by a repeated window is removed. Windows are judged on the input and never cross texts.
Texts are read three times, and shuffled only for the documents whose bytes a later pass really needs.

Defined results: null is the empty text; texts shorter than a window stay whole; rows that repeat an id are
separate texts that repeat each other; a null id is a value of its own; other columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, drop_stored, keyed as with_key, mark_possible, numbered, possible, stored

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PIECE = 1 << 20  # bytes worked on at a time


def _join(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
    """Hash of two neighbouring stretches from their hashes."""
    h = (x * M1) ^ ((y + np.uint64(level + 1)) * M2)
    h ^= h >> np.uint64(31)
    h *= M1
    h ^= h >> np.uint64(29)
    return h


def window_hashes(data: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each width the hash of every stretch of that many bytes, by doubling."""
    level, size, found = 0, 1, {}
    h = _join(data.astype(np.uint64), data.astype(np.uint64), 63)
    while True:
        for w in widths:
            if size <= w < 2 * size and w <= len(data):
                n = len(data) - w + 1
                found[w] = h[:n] if w == size else _join(h[:n], h[w - size:w - size + n], 40)
        if 2 * size > max(widths) or len(h) <= size:
            break
        h = _join(h[:-size], h[size:], level)
        level, size = level + 1, size * 2
    return [found.get(w, np.empty(0, np.uint64)) for w in widths]


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive hashes, the first of equal ones."""
    n = len(h) - width + 1
    bits = np.uint64(22)
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return (np.minimum(key[:n], key[width - size:width - size + n]) & np.uint64((1 << 22) - 1)).astype(np.int64)


def runs(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same digit place: (first, last, place, digit, cover) of one stretch of bytes."""
    if len(data) < window:
        return (np.empty(0, np.int64),) * 5
    hg, hw = window_hashes(data, (gram, window))
    place = leftmost_minimum(hg, window - gram + 1)
    edge = np.flatnonzero(place[1:] != place[:-1])
    first, last = np.r_[0, edge + 1], np.r_[edge, len(place) - 1]
    at = place[first]
    shape = ((at - first) * 4096 + (last - first)).astype(np.uint64)
    cover = _join(_join(hw[first], hw[last], 41), shape, 42)
    return first, last, at, hg[at].view(np.int64), cover.view(np.int64)


def _pieces(raw: bytes, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of a text whose windows together are those of the text, each window in one stretch."""
    data = np.frombuffer(raw, np.uint8)
    for start in range(0, max(1, len(data) - window + 1), PIECE):
        yield start, data[start:start + PIECE + window - 1]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_runs(keyed: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """(_k, first, last, place, digit, cover): every window of every text, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                raws = [x or b"" for x in _column(batch, text).cast(pa.binary()).to_pylist()]
                owner, out = [], []
                for a, b in chunks([len(x) for x in raws], PIECE):
                    for i, start, part in _cut(raws, a, b, window, gram):
                        owner.append(np.full(len(part[0]), i))
                        out.append((part[0] + start, part[1] + start, part[2] + start, part[3], part[4]))
                if not out:
                    continue
                cols = [np.concatenate(c) for c in zip(*out)]
                rows = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [_column(batch, "_k").take(pa.array(rows)), *[pa.array(c.astype(np.int32)) for c in cols[:3]], pa.array(cols[3]), pa.array(cols[4])],
                    names=["_k", "first", "last", "place", "digit", "cover"])

    kind = keyed.schema["_k"].dataType.simpleString()
    return keyed.select("_k", text).mapInArrow(run, f"_k {kind}, first int, last int, place int, digit long, cover long")


def _cut(raws: list[bytes], a: int, b: int, window: int, gram: int) -> Iterator[tuple[int, int, tuple]]:
    """Runs of the texts a..b-1: short ones are worked on end to end in one go, then cut apart again."""
    if b == a + 1:
        for start, data in _pieces(raws[a], window):
            yield a, start, runs(data, window, gram)
        return
    long = [i for i in range(a, b) if len(raws[i]) >= window]
    if not long:
        return
    starts = np.cumsum([0, *(len(raws[i]) for i in long)])
    data = np.frombuffer(b"".join(raws[i] for i in long), np.uint8)
    hg, hw = window_hashes(data, (gram, window))
    place = leftmost_minimum(hg, window - gram + 1)
    doc = np.searchsorted(starts, np.arange(len(place)), "right") - 1
    inside = np.arange(len(place)) + window <= starts[doc + 1]
    change = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    edge = np.flatnonzero(change)
    first, last = np.r_[0, edge + 1], np.r_[edge, len(place) - 1]
    good = inside[first]
    first, last = first[good], last[good]
    at, doc = place[first], doc[first]
    shape = ((at - first) * 4096 + (last - first)).astype(np.uint64)
    cover = _join(_join(hw[first], hw[last], 41), shape, 42).view(np.int64)
    bounds = np.searchsorted(doc, np.arange(len(long) + 1))
    for k, i in enumerate(long):
        s = slice(bounds[k], bounds[k + 1])
        if s.stop > s.start:
            yield i, -int(starts[k]), (first[s], last[s], at[s], hg[at[s]].view(np.int64), cover[s])


def repeated_runs(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passes one and two: (runs that repeat as a whole, runs that a further pass has to look into).

    The second holds one run for each different cover of a digit and, with ``n``, how often it occurs.
    """
    digits = table.groupBy("digit").agg(F.count("*").alias("n"), F.min("cover").alias("lo"), F.max("cover").alias("hi")).filter("n > 1")
    digits = stored(digits.select("digit", (F.col("lo") == F.col("hi")).alias("same")), "digits")
    alive = stored(possible(table, "digit", digits, 1 << 26).join(digits, "digit"), "alive")
    drop_stored(table)
    mixed = alive.filter("NOT same").groupBy("digit", "cover").agg(
        F.count("*").alias("n"), F.min(F.struct("_k", "first", "last", "place")).alias("r"))
    mixed = stored(mixed.select("digit", "cover", "n", "r.*"), "mixed")
    whole = alive.filter("same").select("_k", "first", "last").unionByName(
        alive.filter("NOT same").join(mixed.filter("n > 1").select("digit", "cover"), ["digit", "cover"]).select("_k", "first", "last"))
    return whole, mixed


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document with its own rows as arrays; the document's length bounds them."""
    return rows.groupBy("_k").agg(F.collect_list(F.struct(*columns)).alias("_own")).select(
        "_k", *[F.col(f"_own.{c}").alias(f"_{c}") for c in columns])


def edge_windows(keyed: DataFrame, mixed: DataFrame, text: str, window: int) -> DataFrame:
    """Pass three: (_k, first, last) of windows that repeat although their runs are not equal as a whole."""
    columns = ("first", "last", "place", "digit", "n")
    texts = possible(keyed.select("_k", text), "_k", mixed).join(_listed(mixed, *columns), "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 50):
                batch = whole.slice(at, 50)
                raws = _column(batch, text).cast(pa.binary()).to_pylist()
                lists = [_column(batch, f"_{c}").to_pylist() for c in columns]
                out = []
                for row, raw in enumerate(raws):
                    data = np.frombuffer(raw or b"", np.uint8)
                    for first, last, place, digit, n in zip(*(c[row] for c in lists)):
                        (h,) = window_hashes(data[first:last + window], (window,))
                        pos = np.arange(first, last + 1)
                        at_place = _join(h, (place - pos).astype(np.uint64), 43)
                        out.append((np.full(len(pos), row), pos, np.full(len(pos), digit), at_place.view(np.int64), np.full(len(pos), n == 1)))
                if out:
                    row, pos, digit, h, single = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [_column(batch, "_k").take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(digit), pa.array(h), pa.array(single)],
                        names=["_k", "pos", "digit", "last_digit", "single"])

    kind = keyed.schema["_k"].dataType.simpleString()
    rows = stored(texts.dropDuplicates(["_k"]).mapInArrow(run, f"_k {kind}, pos int, digit long, last_digit long, single boolean"), "suffixes")
    again = stored(rows.groupBy("digit", "last_digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit", "last_digit"), "again")
    # Windows of runs that occur more than once are removed already; here they only count as partners.
    found = possible(rows.filter("single"), "last_digit", again, 1 << 26).join(again, ["digit", "last_digit"])
    return found.select("_k", F.col("pos").alias("first"), F.col("pos").alias("last"))


def repeated_spans(keyed: DataFrame, text: str = "text", window: int = 200, gram: int = 48) -> DataFrame:
    """(_k, _starts, _ends): the maximal byte spans covered by repeated windows, for documents that have any."""
    table = stored(text_runs(keyed, text, window, gram), "runs")
    whole, mixed = repeated_runs(table)
    hits = stored(whole.unionByName(edge_windows(keyed, mixed, text, window)), "hits")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lasts = _column(batch, "_first"), _column(batch, "_last")
            both = [merged(firsts[i].values.to_numpy(), lasts[i].values.to_numpy() + window) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "_k"), *[pa.array([x[j] for x in both], pa.list_(pa.int32())) for j in (0, 1)]], names=["_k", "_starts", "_ends"])

    kind = keyed.schema["_k"].dataType.simpleString()
    return stored(_listed(hits, "first", "last").mapInArrow(merge, f"_k {kind}, _starts array<int>, _ends array<int>"), "spans")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; touching ones become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new].astype(np.int32), reach[np.r_[new[1:], True]].astype(np.int32)


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200) -> DataFrame:
    """``docs`` with ``_k``, ``_starts`` and ``_ends`` (null: nothing repeats); only documents with spans are shuffled."""
    keyed = with_key(docs, key, text)
    spans = repeated_spans(keyed, text, window)
    marked = mark_possible(keyed, "_k", spans, "_maybe")
    none = F.lit(None).cast("array<int>")
    rest = marked.filter("NOT _maybe").drop("_maybe").withColumns({"_starts": none, "_ends": none})
    return marked.filter("_maybe").drop("_maybe").join(spans, "_k", "left").select(*rest.columns).unionByName(rest)


def _kept(raw: bytes, starts: pa.Scalar, ends: pa.Scalar) -> bytes:
    if not starts.is_valid:
        return raw
    edges = [0, *np.stack([starts.values.to_numpy(), ends.values.to_numpy()], 1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removal_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = _column(batch, "_starts"), _column(batch, "_ends")
            rows = []
            for i, raw in enumerate(_column(batch, text).cast(pa.binary()).to_pylist()):
                raw = raw or b""
                left = _kept(raw, starts[i], ends[i])
                rows.append((len(raw), len(raw) - len(left), len(starts[i]) if starts[i].is_valid else 0, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [_column(batch, key), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select(key, text), key, text, window).select(key, text, "_starts", "_ends").mapInArrow(
        run, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200,
                   length: str | None = None) -> DataFrame:
    """The documents with repeated bytes cut out; a character that loses some of its bytes goes as a whole.

    ``length`` names a column that holds the text's number of characters and is brought up to date. A
    document of which nothing is left stays with an empty text; a null text stays null.
    """
    rows, (key, text, *rest) = numbered(docs, key, text, *([length] if length else []))
    columns, length = rows.columns, rest[0] if rest else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = _column(batch, "_starts"), _column(batch, "_ends")
            raws = _column(batch, text).cast(pa.binary()).to_pylist()
            texts = [None if x is None else _kept(x, starts[i], ends[i]).decode("utf-8", "ignore") for i, x in enumerate(raws)]
            out = batch.select(columns).set_column(columns.index(text), text, pa.array(texts, pa.string()))
            if length:
                sizes = [n if t is None or not starts[i].is_valid else len(t)
                         for i, (t, n) in enumerate(zip(texts, _column(batch, length).to_pylist()))]
                at = columns.index(length)
                out = out.set_column(at, length, pa.array(sizes, batch.schema.field(length).type))
            yield out

    return with_spans(rows, key, text, window).drop("_k").mapInArrow(run, rows.schema).toDF(*docs.columns)
