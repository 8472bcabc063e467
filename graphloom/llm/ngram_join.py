"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is the set of its word shingles. Two sets with a Jaccard similarity of at least ``percent`` %
differ in at most H elements, H following from the smaller size. Sets fall into size bands; every band has
its own scheme that hashes the universe of shingles into segments with allocations a_i of 1 (equal
segments) or 2 (segments that differ by at most one element, found through the one-deletion
neighbourhood), the allocations adding up to more than H. Were every segment to differ by at least its
allocation, the sets would differ in more than H elements, so linked sets share a signature: no link is
lost. Spare segments allow a set to leave out those in which it is empty, up to their number; a set with
more empty segments keeps them all. Which segments get 1 and which 2 is a matter of cost, rows written
against chance collisions, and is decided per band from the number of documents. A set takes part in its
own band and, if it can be the larger partner, in the band below.

Signatures with at least two different sets give candidates. They are not expanded to all pairs: in
rounds each set meets one pivot, an exact check decides, and components contract what is linked. Only
sets of different components that still share a signature are then compared, behind a size bound and a
parity sketch that bounds the difference from below, and checked exactly. A sketch of fixed size says nothing
about large sets, so sets of more than ``SMALL`` elements have a second one that grows with them. A signature
shared by many sets, such as that of a stock phrase, still means all their pairs: these are dealt over tiles, and in a
tile sketches are compared as whole arrays.

Equal sets are one node from the start. 64-bit hashes stand for shingles.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text with
fewer words than a shingle is one shingle; a null id never names a component unless no other id is in it;
rows that repeat an id are told apart by their sets; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_stored, numbered, possible, stored, without
from .components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SMALL = 800  # elements: up to here the short sketch tells unlike sets apart
HOT = 64  # sets: signatures of more are compared in tiles
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """Hash of each word seen; emptied when it grows large, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value


WORDS = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C1
    x = (x ^ (x >> np.uint64(29))) * C2
    return x ^ (x >> np.uint64(32))


def shingles(raw: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word windows; fewer words count as one window."""
    words = (raw or b"").translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(np.fromiter(map(WORDS.__getitem__, words), np.int64, n).view(np.uint64), size))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words from the words' hashes; fewer words are one window."""
    n, width = len(h), min(size, len(h))
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * C3 + h[k:n - width + 1 + k])
    return out


@lru_cache(maxsize=None)
def bands(percent: int, largest: int) -> tuple[int, ...]:
    """Smallest size of each band; a set's smallest partner is in its own band or the one below."""
    lows = [1]
    while lows[-1] <= largest:
        low = lows[-1]
        step = -(-low * 100 // percent)
        lows.append(max(low + 1, -(-step * 100 // percent)))
    return tuple(lows)


@lru_cache(maxsize=None)
def allocation(percent: int, low: int, high: int, n_docs: int) -> tuple[int, int, int]:
    """(segments with allocation 1, with allocation 2, spare allocation) for sets of ``low`` to ``high`` elements.

    Cost per set: signature rows, plus the sets expected to share an empty segment by chance, for which both
    must have more empty segments than there is spare allocation.
    """
    need = high * (100 - percent) // percent + 1
    best = None
    for twos in sorted({0, *(need * k // 8 for k in range(1, 4)), (need + 1) // 2}):
        exact, spare, mean = max(0, need - 2 * twos), 0, 0.0
        while exact:  # spare segments may be empty themselves
            parts = exact + spare + twos
            mean = (exact + spare) * np.exp(-low / parts)
            enough = int(np.ceil(mean + 3.5 * np.sqrt(mean)))
            if enough <= spare or spare > need:
                break
            spare = max(enough, spare + 1)
        ones = exact + spare
        parts = ones + twos
        term = within = np.exp(-mean)
        for k in range(1, spare + 1):
            term *= mean / k
            within += term
        chance = n_docs * max(0.0, 1 - within) ** 2 * mean * np.exp(-low / parts) if ones else 0.0
        cost = ones - mean + twos + twos * high / parts + chance
        if best is None or cost < best[0]:
            best = (cost, ones, twos, spare)
    return best[1:]


def signatures(s: np.ndarray, percent: int, n_docs: int) -> np.ndarray:
    """Signatures of a set: in the scheme of its band, and of the band below if partners can be there."""
    n = len(s)
    lows = bands(percent, 1 << 26)
    own = int(np.searchsorted(lows, n, "right")) - 1
    out = []
    for band in (own, own - 1):
        high = lows[band + 1] - 1
        if band < 0 or (band < own and percent * n > 100 * high):
            continue
        ones, twos, spare = allocation(percent, lows[band], high, n_docs)
        parts = ones + twos  # the first ``twos`` segments have allocation 2
        seg = ((s >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, value = seg[order], mix(s[order])
        total = np.zeros(parts, np.uint64)
        at = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        total[seg[at]] = np.add.reduceat(value, at)
        salt = mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)) * C3
        full = np.zeros(parts, bool)
        full[seg] = True
        used = full if np.count_nonzero(~full[twos:]) <= spare else np.ones(parts, bool)
        used[:twos] = True
        out.append(mix(total[used] + salt[used]))
        if twos:
            near = seg < twos
            out.append(mix(total[seg[near]] - value[near] + salt[seg[near]]))
    return np.unique(np.concatenate(out))


def parity_sketch(s: np.ndarray, longs: int = 8) -> np.ndarray:
    """Parity of the elements per slot: two sketches differ in at most as many bits as the sets in elements."""
    bits = np.bincount((s >> np.uint64(44)).astype(np.int64) % (64 * longs), minlength=64 * longs).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def wide_sketch(s: np.ndarray) -> np.ndarray | None:
    """Parity sketch of a large set, 16 longs or as often twice that as the set is twice as large, so that no sketch is
    full; none for a small one. Folding the halves of a sketch onto each other gives the one of half the length."""
    return parity_sketch(s, 8 << ((len(s) - 1) // SMALL).bit_length()) if len(s) > SMALL else None


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sets(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            yield batch, [shingles(raw, size) for raw in _column(batch, text).cast(pa.binary()).to_pylist()]


def _identity(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *(x.view(np.int64) for x in arrays)])))


def shingle_sets(docs: DataFrame, key: str, text: str, size: int, percent: int | None = None, n_docs: int = 0) -> DataFrame:
    """(key, n, node, node2, sketch, wide): set size, 128-bit identity and parity sketches of every document; given
    ``percent``, with its signatures."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, text, size):
            cols = [_column(batch, key), pa.array([len(s) for s in sets], pa.int64()), *_identity(sets), _packed([parity_sketch(s) for s in sets]),
                    pa.array([wide_sketch(s) for s in sets], pa.list_(pa.int64()))]
            if percent:
                cols.append(_packed([signatures(s, percent, n_docs) if len(s) else s for s in sets]))
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n", "node", "node2", "sketch", "wide", "sigs"][:len(cols)])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n long, node long, node2 long, sketch array<long>, wide array<long>" + ", sigs array<long>" * bool(percent))


def signature_rows(docs: DataFrame, text: str, size: int, percent: int, n_docs: int) -> DataFrame:
    """(node, sig): the signatures of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, text, size):
            sets = [s for s in sets if len(s)]
            if sets:
                sigs = [signatures(s, percent, n_docs) for s in sets]
                owner = _identity(sets)[0].take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sigs])))
                yield pa.RecordBatch.from_arrays([owner, pa.array(np.concatenate(sigs).view(np.int64))], names=["node", "sig"])

    return docs.select(text).mapInArrow(run, "node long, sig long")


def _element_sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(node, elements) of the given documents; one whose set is not the node's (an id taken twice) is left out.
    Without a node it is that of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, text, size):
            own = _identity(sets)[0]
            node = pa.compute.coalesce(_column(batch, "node"), own)
            same = pa.compute.equal(own, node)
            yield pa.RecordBatch.from_arrays([node, _packed(sets)], names=["node", "elements"]).filter(same)

    return docs.select("node", text).mapInArrow(run, "node long, elements array<long>")


def verified(pairs: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The (a, b) pairs of nodes that really reach the similarity; ``elements`` gets the sets of some nodes."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(elements(nodes), "elements")
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ea", "eb")).alias("i"), F.size("ea").alias("na"), F.size("eb").alias("nb"))
    found = stored(rows.filter(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b"), "links")
    drop_stored(sets)
    return found


def _may_link(percent: int) -> Column:
    """Whether sets a and b can be linked by their sizes and sketches."""
    differ = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(8)), F.lit(0))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    # |A xor B| <= (|A| + |B|) (1 - s) / (1 + s) for every linked pair
    return (small * 100 >= large * percent) & (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def _wide_may_link(percent: int) -> Column:
    """The same by the sketches of large sets, the longer of two folded to the length of the other."""
    a, b = F.col("wide_a"), F.col("wide_b")
    n = F.least(F.size(a), F.size(b))

    def xor(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > n, xor(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n))).otherwise(x)

    differ = F.aggregate(xor(folded(a), folded(b)), F.lit(0), lambda total, x: total + F.bit_count(x))
    return a.isNull() | b.isNull() | (F.greatest(F.size(a), F.size(b)) > 2 * n) | (
        differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


class _Sketches(NamedTuple):
    """Sets of a tile; sketches have a row per long. ``longs`` and ``place`` tell a set's place among its wide ones."""

    node: np.ndarray
    n: np.ndarray
    comp: np.ndarray
    short: np.ndarray
    longs: np.ndarray
    place: np.ndarray
    wide: dict[int, np.ndarray]


def _sketches(rows: pa.Table) -> _Sketches:
    node, n, comp = (rows[c].to_numpy() for c in ("node", "n", "comp"))
    short = pa.compute.list_flatten(rows["sketch"]).to_numpy().view(np.uint64).reshape(len(n), -1)
    longs = pa.compute.coalesce(pa.compute.list_value_length(rows["wide"]), pa.scalar(0, pa.int32())).to_numpy()
    values, starts = pa.compute.list_flatten(rows["wide"]).to_numpy().view(np.uint64), np.cumsum(longs) - longs
    place, wide = np.zeros(len(n), np.int64), {}
    for k in np.unique(longs[longs > 0]).tolist():
        own = np.flatnonzero(longs == k)
        place[own] = np.arange(len(own))
        wide[k] = np.ascontiguousarray(values[starts[own][:, None] + np.arange(k)].T)
    return _Sketches(node, n, comp, np.ascontiguousarray(short.T), longs, place, wide)


def _folded(sketches: np.ndarray, longs: int) -> np.ndarray:
    while len(sketches) > longs:
        sketches = sketches[:len(sketches) // 2] ^ sketches[len(sketches) // 2:]
    return sketches


def _tile_pairs(percent: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The pairs (a, b) of sets from the two sides of a tile (sig, x, y) that may link by their sizes and sketches."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        one, a, b = key[1].equals(key[2]), _sketches(left), _sketches(right.sort_by("n"))
        low, high = np.searchsorted(b.n, -(-a.n * percent // 100)), np.searchsorted(b.n, a.n * 100 // percent, "right")
        found = [np.empty((0, 2), np.int64)]
        for i, (node, n, lo, hi) in enumerate(zip(a.node, a.n, low, high)):

            def fits(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
                differ = np.bitwise_count(x ^ y).sum(0, dtype=np.int64)
                return differ * (100 + percent) <= (sizes + n) * (100 - percent)

            keep = fits(b.short[:, lo:hi], a.short[:, i:i + 1], b.n[lo:hi]) & (b.comp[lo:hi] != a.comp[i])
            at = lo + np.flatnonzero(keep & (b.node[lo:hi] > node) if one else keep)
            if a.longs[i] and len(at):
                own = a.wide[a.longs[i]][:, a.place[i]:a.place[i] + 1]
                parts = [at[b.longs[at] == 0]]
                for longs, sketches in b.wide.items():
                    part, least = at[b.longs[at] == longs], min(longs, len(own))
                    parts.append(part[fits(_folded(sketches[:, b.place[part]], least), _folded(own, least), b.n[part])])
                at = np.concatenate(parts)
            found.append(np.stack([np.minimum(b.node[at], node), np.maximum(b.node[at], node)], 1))
        pairs = np.concatenate(found)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _roots(parents: DataFrame, jumps: int = 3) -> DataFrame:
    """(comp, root) after ``jumps`` doublings of the pointers (comp, root), which form a forest."""
    for _ in range(jumps):
        up = parents.select(F.col("comp").alias("root"), F.col("root").alias("_up"))
        parents = parents.join(up, "root", "left").select("comp", F.coalesce("_up", "root").alias("root"))
    return parents


def linked_sets(members: DataFrame, info: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int, rounds: int = 8,
                block: int = 2048) -> DataFrame:
    """(node, root) of all sets with a link, from the shared signatures ``members`` (sig, node) and the size and
    sketches of each set in ``info`` (node, n, sketch, wide).

    A signature's pivot is its set of the component with the smallest hash in this round, so components linked to
    their pivots' components form a forest, and a few pointer jumps contract them; components proper are worked out
    once, at the end. Pivots change from round to round until a round links hardly anything new, at most ``rounds``
    times; however many rounds there are, the comparison after them is complete.
    """
    links, tested, first = None, None, 0
    label = info.select("node", F.col("node").alias("comp"))
    full = stored(members.join(info.drop("wide"), "node"), "described")
    wide = stored(info.filter("wide IS NOT NULL").select("node", "wide"), "wide")
    columns = ("node", "n", "sketch")

    def labelled() -> DataFrame:
        return full.join(label, "node")

    for turn in range(rounds):
        now, rank = labelled(), F.xxhash64("comp", F.lit(turn))
        pivots = now.groupBy("sig").agg(F.min_by(F.struct(*columns, "comp"), F.struct(rank, "comp", F.xxhash64("node", F.lit(turn)))).alias("p"),
                                        F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        pivots = pivots.select("sig", F.col("p.comp").alias("comp_a"), *[F.col(f"p.{c}").alias(f"{c}_a") for c in columns])
        pairs = now.withColumnRenamed("comp", "comp_b").join(pivots, "sig").filter("comp_b <> comp_a").withColumnsRenamed({c: f"{c}_b" for c in columns})
        pairs = pairs.filter(_may_link(percent)).select("node_a", "n_a", "comp_a", "node_b", "n_b", "comp_b").distinct()
        for side in ("a", "b"):
            pairs = pairs.join(wide.toDF(f"node_{side}", f"wide_{side}"), f"node_{side}", "left")
        pairs = pairs.filter(_wide_may_link(percent)).groupBy(F.col("node_b").alias("b"), "comp_b").agg(
            F.min_by(F.struct("node_a", "comp_a"), F.xxhash64("node_a", F.lit(turn))).alias("p"))
        pairs = stored(pairs.select("p.node_a", "b", "p.comp_a", "comp_b").withColumnRenamed("node_a", "a"), "pairs")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        found = verified(pairs.select("a", "b"), elements, percent)
        links = found if links is None else links.unionByName(found)
        n_found = found.count()
        first = first or n_found
        if n_found:
            hooks = pairs.join(found, ["a", "b"]).groupBy(F.col("comp_b").alias("comp")).agg(
                F.min_by("comp_a", F.struct(F.xxhash64("comp_a", F.lit(turn)), "comp_a")).alias("root"))
            label = stored(label.join(_roots(hooks), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
        if 20 * n_found <= first:
            break
    # What still lies in different components is compared in full, but only pairs that may link become rows.
    now = full.select("sig", "node").join(label, "node")
    open_sigs = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    now = now.join(open_sigs.select("sig", "size", F.ceil(F.col("size") / block).alias("tiles")), "sig").join(info, "node")
    now, columns = stored(now, "open"), (*columns, "wide", "comp")
    left, right = (now.filter(F.col("size") <= HOT).select("sig", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in ("a", "b"))
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b"))
    rest = left.join(right, "sig").filter(apart & _may_link(percent) & _wide_may_link(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    tile, last = F.pmod(F.xxhash64("node"), "tiles"), F.col("tiles") - 1
    hot = now.filter(F.col("size") > HOT).withColumn("x", tile).withColumn("y", tile)
    left = hot.withColumn("y", F.explode(F.sequence("x", last))).select("sig", "x", "y", *columns)
    right = hot.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), "y"))).select("sig", "x", "y", *columns)
    tiles = left.groupBy("sig", "x", "y").cogroup(right.groupBy("sig", "x", "y")).applyInArrow(_tile_pairs(percent), "a long, b long")
    rest = rest.unionByName(tiles).distinct()
    old = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(old, ["a", "b"], "left_anti"), "pairs")
    for done in (full, wide, now):
        drop_stored(done)
    return components(links if rest.isEmpty() else links.unionByName(verified(rest, elements, percent)))


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, node) of all signatures that different sets share.

    The first pass keeps the smallest and largest 32-bit hash of a set per signature; sets that share many
    signatures would have to agree in all those hashes to be missed.
    """
    short = F.hash("node", "sig")
    shared = rows.groupBy("sig").agg(F.min(short).alias("lo"), F.max(short).alias("hi")).filter("lo <> hi").select("sig")
    shared = stored(shared, "shared")
    return stored(possible(rows, "sig", shared, 1 << 26).join(shared, "sig").distinct(), "members")


def _classes(docs: DataFrame, key: str, text: str, size: int, percent: int, keep_signatures: bool) -> tuple[DataFrame, DataFrame]:
    """(key, n, node, ...) of every document, and (node, rep, root) of every set: its smallest key and its component.

    Signatures are by far the largest intermediate result, the more so the lower the threshold. Two passes
    need them: they are kept on disk until then, or without ``keep_signatures`` computed again.
    """
    n_docs = docs.count()
    base = stored(shingle_sets(docs, key, text, size, percent if keep_signatures else None, n_docs), "sets")
    members = shared_signatures(base.filter("n > 0").select("node", F.explode("sigs").alias("sig")) if keep_signatures
                                else signature_rows(docs, text, size, percent, n_docs))
    if keep_signatures:
        whole, base = base, stored(base.drop("sigs"), "sets")
        drop_stored(whole)
    full = base.filter("n > 0")
    nodes = full.groupBy("node").agg(F.min(key).alias("rep"))
    info = full.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))

    def elements(some: DataFrame) -> DataFrame:
        """Sets of some nodes, each from one document; only texts that may be wanted are shuffled."""
        wanted = stored(some.join(nodes, "node"), "wanted").withColumnRenamed("rep", key)
        texts = possible(docs.select(key, text), key, wanted).join(wanted, key)
        found = _element_sets(texts, text, size)
        nameless = wanted.filter(F.col(key).isNull()).select("node")
        if not nameless.isEmpty():
            others = docs.filter(F.col(key).isNull()).select(F.lit(None).cast("long").alias("node"), text)
            found = found.unionByName(possible(_element_sets(others, text, size), "node", nameless).join(nameless, "node", "left_semi"))
        return found.dropDuplicates(["node"])

    label = linked_sets(members, info, elements, percent)
    return base, nodes.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90,
                       keep_signatures: bool = True) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key that a document reaches by links, its own included."""
    base, named = _classes(docs, key, text, size, percent, keep_signatures)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = named.join(least, "root").select("node", "component_id")
    return base.join(classes, "node", "left").select(
        key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90,
                      keep_signatures: bool = True) -> DataFrame:
    """One document of each component, that with the smallest id (a null id only if there is no other); documents
    without shingles stay. Columns are as they are.

    Rows that repeat an id are told apart by their sets; of rows with the same id and set the one that comes
    first as JSON stays.
    """
    base, named = _classes(docs, key, text, size, percent, keep_signatures)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("first"))
    keepers = named.join(first, "root").filter(F.col("first.node") == F.col("node")).select("node", "rep")
    rows = base.select(F.col(key).alias("id"), "n", "node").join(keepers.withColumn("named", F.lit(True)), "node", "left")
    stays = (F.col("n") == 0) | F.coalesce(F.col("named") & F.col("id").eqNullSafe(F.col("rep")), F.lit(False))
    state = rows.groupBy("id").agg(F.count("*").alias("n_rows"), F.count_if(~stays).alias("n_gone"), F.count_if(stays & (F.col("n") > 0)).alias("n_kept"))
    state = stored(state.filter("n_gone > 0 OR n_kept > 1"), "near_copies")
    # An id with one row tells all; rows that share one, or have none, are told apart by their sets.
    doubt = state.filter("n_rows > 1 OR id IS NULL").select("id")
    docs_, (k, t) = numbered(docs, key, text)
    docs_ = docs_.withColumn("id", F.col(k))
    clear = without(docs_, "id", state.select("id"))
    if not doubt.isEmpty():
        columns = [c for c in docs_.columns if c != "id"]
        nameless = not doubt.filter("id IS NULL").isEmpty()
        shared = possible(docs_, "id", doubt).join(doubt, "id", "left_semi")
        if nameless:
            clear = clear.filter("id IS NOT NULL")
            shared = shared.unionByName(docs_.filter("id IS NULL"))
        whole = F.struct(*columns)
        shared = _with_node(shared.select("id", F.col(t).alias("text"), whole.alias("row")), size)
        none = shared.filter("node IS NULL").select("row.*")
        match = shared["id"].eqNullSafe(keepers["rep"]) & (shared["node"] == keepers["node"])
        kept = shared.join(keepers, match, "left_semi").groupBy("id", "node").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
        clear = clear.select(*columns).unionByName(none).unionByName(kept)
    return clear.drop("id").toDF(*docs.columns)


def _with_node(rows: DataFrame, size: int) -> DataFrame:
    """(id, row, node) from (id, text, row); the node is null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, "text", size):
            node = pa.compute.if_else(pa.array([len(s) > 0 for s in sets], pa.bool_()), _identity(sets)[0], pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([_column(batch, "id"), _column(batch, "row"), node], names=["id", "row", "node"])

    kind, row = (rows.schema[c].dataType.simpleString() for c in ("id", "row"))
    return rows.mapInArrow(run, f"id {kind}, row {row}, node long")
