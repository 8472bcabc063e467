"""Toxicity scores by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself, its beginnings and its ending, so unseen forms of a known
stem are known too. Filters of several widths slide over the words of a whole text, each keeps its largest
response, and a logistic layer turns these into a score between 0 and 1. Thresholds per language, calibrated
on labelled rows that did not train the filters, give ``flagged`` beside the language-free ``predicted``.

Every labelled row outside the held-out fold is used: fold 1 sets the thresholds, the other rows fit. They are dealt by a hash
over shares of about ``rows`` rows and ``chars`` characters; texts of other rows are never moved. A task fits one share, starting from the common model, and what
its steps changed is averaged over the shares that changed it; several shares do this in rounds. Counts of buckets and the
scores behind the thresholds are aggregated inside Spark; only the model and one threshold per language reach the driver.
Only texts are inputs: neither labels nor language, source or id reach a score.

Each worker multiplies a word with all filters once and keeps the products of the words it has seen, up to a
fixed number, so that a text costs a look-up and an addition per word and filter.

Defined results: null and empty texts are scored as a text of padding alone; a null id is not held out;
without labelled rows of both kinds every score is the share of toxic rows among them (0 without any);
rows that repeat an id are scored one by one; labels that repeat or contradict each other all count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.scale import ordered_scan
from .common import possible, stored

BUCKETS, WIDTH, FILTERS, SPANS = 1 << 15, 12, 8, (1, 2, 3)
WORD = re.compile(r"\w+")
PAD = ""


def word_parts(word: str) -> tuple[int, int, int, int]:
    """Buckets of the word, its first four and five characters and its last four."""
    return (zlib.crc32(word.encode()) % BUCKETS, zlib.crc32(word[:4].encode(), 1) % BUCKETS,
            zlib.crc32(word[:5].encode(), 2) % BUCKETS, zlib.crc32(word[-4:].encode(), 3) % BUCKETS)


def words_of(text: str | None) -> list[str]:
    """Words of a text between padding, so that every filter finds a place."""
    return [PAD, *WORD.findall((text or "").lower()), PAD, PAD]


@dataclass
class Classifier:
    embedding: np.ndarray  # buckets x width
    filters: list[np.ndarray]  # for each span: span x width x filters
    bias: np.ndarray  # all filters
    out: np.ndarray
    shift: float
    constant: float | None = None
    name: int = 0

    def taps(self) -> np.ndarray:
        """Every bucket's share in every filter at every offset."""
        return self.embedding @ np.concatenate([f for w in self.filters for f in w], 1)

    def pooled(self, products: np.ndarray) -> np.ndarray:
        """Largest response of each filter to a text, from its words' products with the taps."""
        tops, at = [], 0
        for span in SPANS:
            n = len(products) - span + 1
            z = products[:n, at:at + FILTERS]
            for j in range(1, span):
                z = z + products[j:n + j, at + j * FILTERS:at + (j + 1) * FILTERS]
            tops.append(z.max(0))
            at += span * FILTERS
        return np.maximum(np.concatenate(tops) + self.bias, 0)

    def score(self, products: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(products) @ self.out + self.shift, -30, 30))))


BLOCKS = 128  # pieces of the parameters, averaged apart


def started(seen: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> Classifier:
    """Model before any step, from the number of texts of each kind (clean, toxic) that hold a bucket.

    The first embedding dimension starts as each bucket's log odds of being in a toxic text.
    """
    seen, total = seen + 0.5, totals[:, None] + 1.0
    odds = np.log(seen[1] / total[1]) - np.log(seen[0] / total[0])
    odds[seen.sum(0) < 4] = 0
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    e[:, 0] = np.clip(odds, -3, 3) / 4
    filters = [rng.normal(0, 0.2, (s, WIDTH, FILTERS)) for s in SPANS]
    for f in filters:
        f[:, 0, ::2] = 1.0 / len(f)
    out = rng.normal(0, 0.1, FILTERS * len(SPANS))
    out[::2] = 0.3
    return Classifier(e, filters, np.zeros(FILTERS * len(SPANS)), out, 0.0)


def flat(model: Classifier) -> np.ndarray:
    return np.concatenate([model.embedding.ravel(), *[f.ravel() for f in model.filters], model.bias, model.out, [model.shift]])


def shaped(values: np.ndarray) -> Classifier:
    sizes = [BUCKETS * WIDTH, *[s * WIDTH * FILTERS for s in SPANS], FILTERS * len(SPANS), FILTERS * len(SPANS)]
    parts = np.split(values, np.cumsum(sizes))
    filters = [f.reshape(s, WIDTH, FILTERS) for f, s in zip(parts[1:], SPANS)]
    return Classifier(parts[0].reshape(BUCKETS, WIDTH), filters, parts[-3], parts[-2], float(parts[-1][0]))


def stepped(model: Classifier, texts: list[str], toxic: np.ndarray, epochs: range, rng: np.random.Generator, step: float = 0.05) -> Classifier:
    """The model after so many epochs over these texts."""
    ready: dict[str, np.ndarray] = {}
    for t in texts:
        if t not in ready:
            ready[t] = np.array([word_parts(w) for w in words_of(t)], np.int32)
    parts = [ready[t] for t in texts]
    e, filters, bias, out, shift = model.embedding.copy(), [f.copy() for f in model.filters], model.bias.copy(), model.out.copy(), model.shift
    for epoch in epochs:
        rate_now = step / (1 + epoch)
        for i in rng.permutation(len(parts)):
            p = parts[i]
            x = e[p].sum(1)
            best, tops = [], []
            for f in filters:
                n = len(x) - len(f) + 1
                z = sum(x[j:n + j] @ f[j] for j in range(len(f)))
                at = z.argmax(0)
                best.append(at)
                tops.append(z[at, np.arange(FILTERS)])
            h = np.maximum(np.concatenate(tops) + bias, 0)
            error = 1 / (1 + np.exp(-np.clip(h @ out + shift, -30, 30))) - toxic[i]
            if abs(error) < 1e-3:
                continue
            back = error * out * (h > 0)
            out -= rate_now * error * h
            shift -= rate_now * error
            bias -= rate_now * back
            for k, f in enumerate(filters):
                g = back[k * FILTERS:(k + 1) * FILTERS]
                for j in range(len(f)):
                    at = best[k] + j
                    moved = (f[j] * g).T
                    f[j] -= rate_now * x[at].T * g
                    np.add.at(e, p[at], -rate_now * moved[:, None, :])
    return Classifier(e, filters, bias, out, float(shift))


class Scorer:
    """Scores texts; keeps the products of words already met."""

    def __init__(self, model: Classifier, remember: int = 120_000):
        self.model, self.taps, self.remember = model, model.taps(), remember
        self.rows: dict[str, int] = {}
        self.known = np.empty((1024, self.taps.shape[1]), np.float32)

    def _products(self, words: list[str]) -> np.ndarray:
        return self.taps[np.array([word_parts(w) for w in words])].sum(1)

    def __call__(self, text: str | None) -> float:
        words = words_of(text)
        at = np.fromiter((self.rows.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        products = self.known[at]
        if len(new):
            fresh = [words[i] for i in new]
            products[new] = made = self._products(fresh)
            for w, row in zip(fresh, made):
                if len(self.rows) >= self.remember:
                    break
                if w not in self.rows:
                    if len(self.rows) == len(self.known):
                        self.known = np.concatenate([self.known, np.empty_like(self.known)])
                    self.known[len(self.rows)] = row
                    self.rows[w] = len(self.rows)
        return self.model.score(products)


_READY: dict[int, Scorer] = {}


def _scorer(model: Classifier) -> Scorer:
    if model.name not in _READY:
        _READY.clear()
        _READY[model.name] = Scorer(model)
    return _READY[model.name]


def fold(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def _sampled(docs: DataFrame, labels: DataFrame, key: str, sample: int, chars: int) -> list:
    """A look at the labelled rows: at most ``sample`` of ``chars`` characters in all, half of each kind, in the order of a hash of
    the id. Nothing is fitted on it.

    Rows are chosen by lengths and hashes inside Spark; only texts that were chosen reach the driver, each once however
    often its row repeats.
    """
    order = [F.xxhash64(key), F.col(key)]
    halves = [labels.filter(F.col("toxic") == y).orderBy(*order).limit(sample // 2) for y in (0, 1)]
    few = F.broadcast(halves[0].unionByName(halves[1]))  # at most ``sample`` rows
    rows = docs.select(key, "text", "lang", F.xxhash64("text", "lang").alias("_h"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_n"))
    place = [F.crc32(F.col(key).cast("string").cast("binary")), F.col(key), F.col("toxic"), F.col("_h")]
    first = rows.drop("text", "lang").join(few, key).filter(F.col("_n") <= chars // 64).orderBy(*place).limit(sample)
    upto = F.sum("_n").over(W.orderBy(*place).rowsBetween(W.unboundedPreceding, 0))  # ``sample`` rows without texts
    chosen = first.withColumn("_upto", upto).filter(F.col("_upto") <= chars).groupBy(key, "_h", "toxic").agg(F.count("*").alias("_times"))
    texts = rows.drop("_n").join(F.broadcast(chosen), [key, "_h"]).dropDuplicates([key, "_h", "toxic"]).collect()
    found = sorted(texts, key=lambda r: (zlib.crc32(str(r[key]).encode()), r[key], r["toxic"], r["_h"]))
    return [r for r in found for _ in range(r["_times"])]


def language_thresholds(scores: list[float], toxic: list[int], langs: list[str | None], least: int = 20) -> dict[str | None, float]:
    """Per language the threshold with the best F1, half way to the next score; too few rows: one half."""
    out = {}
    for lang in set(langs):
        rows = sorted((s, t) for s, t, g in zip(scores, toxic, langs) if g == lang)
        positive = sum(t for _, t in rows)
        if len(rows) < least or not positive:
            continue
        best, hits = (-1.0, 0.5), 0
        for k in range(len(rows) - 1, -1, -1):
            hits += rows[k][1]
            if k and rows[k - 1][0] == rows[k][0]:
                continue
            f1 = 2 * hits / (len(rows) - k + positive)
            below = rows[k - 1][0] if k else 0.0
            best = max(best, (f1, (below + rows[k][0]) / 2))
        out[lang] = best[1]
    return out


def best_thresholds(scored: DataFrame, least: int = 20) -> dict[str | None, float]:
    """What ``language_thresholds`` finds, for any number of rows (lang, score, toxic): hits are summed along buckets of scores."""
    counts = (scored.select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("lang").isNull().alias("none"), "score", "toxic", (-F.col("score")).alias("down"))
              .groupBy("lang", "none", "score", "down").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")))
    keys = ["lang", "none"]
    along = ordered_scan(counts, keys, ["down"], F.floor(-F.log(F.col("score") / (1 - F.col("score"))) * 256),
                         lead={"below": "score"}, running_sum={"taken": "n", "hits": "p"})
    known = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum("p").alias("positive")).filter((F.col("rows") >= least) & (F.col("positive") > 0))
    f1 = 2 * F.col("hits") / (F.col("taken") + F.col("positive"))
    best = along.join(known, keys).groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), ((F.coalesce("below", F.lit(0.0)) + F.col("score")) / 2).alias("at"))).alias("best"))
    return {None if r["none"] else r["lang"]: r["best"]["at"] for r in best.collect()}


def _seen(rows: DataFrame) -> np.ndarray:
    """For either kind the number of texts that hold a bucket, counted in tasks and added up by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y, np.unique(np.array([word_parts(w) for w in set(words_of(text))]))] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "clean", "toxic"])

    out = np.zeros((2, BUCKETS))
    parts = rows.select("text", "toxic").mapInArrow(count, "bucket long, clean long, toxic long")
    for r in parts.groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).collect():  # one row a bucket
        out[:, r[0]] = r[1], r[2]
    return out


def _round(rows: DataFrame, key: str, values: np.ndarray, epochs: range, rng: np.random.Generator | None) -> np.ndarray:
    """Parameters after every share took its steps from ``values``; a parameter moves by the mean of the shares that moved it."""
    def share(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_c", key, "toxic", "_h"], kind="stable")
        own = rng or np.random.default_rng([5, epochs.start, int(group["_share"].iloc[0])])
        texts = [t if isinstance(t, str) else "" for t in group["text"]]
        moved = flat(stepped(shaped(values), texts, group["toxic"].to_numpy(np.int64), epochs, own)) - values
        return pd.DataFrame({"block": range(BLOCKS), "moved": np.array_split(moved, BLOCKS)})

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        moved = np.stack(group["moved"].to_numpy())
        return pd.DataFrame({"block": [group["block"].iloc[0]], "moved": [moved.sum(0) / np.maximum((moved != 0).sum(0), 1)]})

    kind = "block long, moved array<double>"
    blocks = rows.groupBy("_share").applyInPandas(share, kind).groupBy("block").applyInPandas(mean, kind)
    return values + np.concatenate([r["moved"] for r in sorted(blocks.collect(), key=lambda r: r["block"])])


def _maybe_labelled(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows that may have one of the labels, so that no other text is scored or moved by a join."""
    return possible(docs, key, labels, 1 << 26) if docs.schema[key].dataType == labels.schema[key].dataType else docs


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = 3000, chars: int = 1 << 24,
          updates: int = 12_000, rounds: int = 2) -> tuple[Classifier, dict[str | None, float]]:
    """Classifier and thresholds from all labelled rows outside the held-out fold; fold 1 only calibrates."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).select(key, F.col("toxic").cast("int").alias("toxic"))
    fitting, other = known.filter(fold(key) > 1), known.filter(fold(key) == 1)
    n, positive = fitting.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    hashes = [F.crc32(F.col(key).cast("string").cast("binary")).alias("_c"), F.xxhash64("text", "lang").alias("_h")]
    given = stored(_maybe_labelled(docs.select(key, "text", "lang", *hashes), fitting, key).join(fitting.hint("merge"), key), "labelled") if 0 < positive < n else None
    size = {r["toxic"]: r for r in given.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).collect()} if given else {}
    if len(size) < 2:
        empty = [np.zeros((s, WIDTH, FILTERS), np.float32) for s in SPANS]
        zero = np.zeros(FILTERS * len(SPANS), np.float32)
        return Classifier(np.zeros((BUCKETS, WIDTH), np.float32), empty, zero, zero, 0.0, positive / n if n else 0.0), {}
    found, length = (sum(r[c] for r in size.values()) for c in ("n", "chars"))
    shares = max(1, -(-found // rows), -(-length // chars))
    dealt = given.withColumn("_share", F.pmod(F.xxhash64(key, "toxic", "_h"), F.lit(shares)))
    rng = np.random.default_rng(5)
    values = flat(started(_seen(given), np.array([size[0]["n"], size[1]["n"]]), rng))
    epochs = max(4, min(40, updates * shares // found))
    cuts = [epochs * i // rounds for i in range(rounds + 1)] if shares > 1 else [0, epochs]
    for at, end in zip(cuts, cuts[1:]):
        values = _round(dealt, key, values, range(at, end), rng if shares == 1 else None)
    rate, part = positive / n, size[1]["n"] / found
    made = shaped(values)
    model = Classifier(made.embedding.astype(np.float32), [f.astype(np.float32) for f in made.filters], made.bias.astype(np.float32), made.out.astype(np.float32),
                       made.shift + float(np.log(rate / (1 - rate)) - np.log(part / (1 - part))))
    model.name = zlib.crc32(model.embedding.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            scores = pa.array([scorer(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), scores], names=[key, "lang", "score"])

    # Texts are scored where they are; only scores meet their labels.
    held = _maybe_labelled(docs.select(key, "text", "lang"), other, key)
    kind = docs.schema[key].dataType.simpleString()
    scored = held.mapInArrow(run, f"{key} {kind}, lang string, score double").join(other, key).select("lang", "toxic", "score")
    return model, best_thresholds(stored(scored, "calibration"))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = 3000, chars: int = 1 << 24) -> DataFrame:
    """(key, held_out, score, predicted, flagged) of every document. Nothing is shuffled but labelled rows and parameters."""
    model, thresholds = train(docs, labels, key, rows, chars)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model) if model.constant is None else (lambda _: model.constant)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                get = {c: batch.column(batch.schema.get_field_index(c)) for c in (key, "text", "lang", "held_out")}
                found = [scorer(t) for t in get["text"].to_pylist()]
                flagged = [s >= thresholds.get(g, 0.5) for s, g in zip(found, get["lang"].to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [get[key], get["held_out"], pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32()), pa.array(flagged, pa.bool_())],
                    names=[key, "held_out", "score", "predicted", "flagged"])

    given = docs.select(key, "text", "lang", F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out"))
    return given.mapInArrow(run, f"{key} {kind}, held_out boolean, score double, predicted int, flagged boolean")
