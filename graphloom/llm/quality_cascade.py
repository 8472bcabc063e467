"""Quality rules as a short-circuit cascade.

Every rule looks at one document and may reject it. Which rule runs first does not change the verdict,
only its price, so a sample tells what each rule costs and how often it rejects, and the rules run in
descending order of rejections per second. A document leaves the cascade with its first rejection;
features such as the word list are computed when a rule first asks for them and shared afterwards.

Defined results: a null or empty text has no words and is rejected by ``short``; null ids pass through;
repeated rows are judged one by one; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
# White space, and the bytes that continue a UTF-8 character: what is left is one byte per character of a word.
NO_CHARACTER = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
LETTERS = UPPER + bytes(range(97, 123))


class Text:
    """One document's features, each computed on first use."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, NO_CHARACTER))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a three-word window that occurs at least twice."""
        n = self.n_words
        if n < 4:
            return 0
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in self.words), np.int64, n)
        if len(index) == n:
            return 0
        pairs = ids[:-1] * len(index) + ids[1:]
        if len(index) > 1 << 20:  # keep the combined key inside 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        key = pairs[:-1] * len(index) + ids[2:]
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        again = size[group] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k:n - 2 + k] |= again
        return int(cover.sum())

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, LETTERS))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, UPPER))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


BASE_RULES = (
    Rule("short", lambda t: t.n_words < 50),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
# Thresholds are integers so that any engine decides alike.
MORE_RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("dup_lines", lambda t: 100 * t.n_dup_lines > 40 * len(t.lines)),
    Rule("capitals", lambda t: 100 * t.n_upper > 50 * t.n_letters),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words),
)
RULES = BASE_RULES + MORE_RULES


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def rule_statistics(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", per_task: int = 48) -> DataFrame:
    """(rule, n, rejected, seconds) over the first ``per_task`` documents of each input task.

    Each rule runs alone on every sampled document, features included. A task stops reading once it has
    its share, and hands on one row per rule.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, rows = per_task, {r.name: [0, 0, 0.0] for r in rules}
        for batch in batches:
            for raw in _texts(batch.slice(0, left), text):
                for r in rules:
                    t = time.perf_counter()
                    out = r.rejects(Text(raw))
                    row = rows[r.name]
                    row[0] += 1
                    row[1] += bool(out)
                    row[2] += time.perf_counter() - t
            left -= min(left, batch.num_rows)
            if not left:
                break
        yield pa.RecordBatch.from_pydict({
            "rule": list(rows), "n": [r[0] for r in rows.values()], "rejected": [r[1] for r in rows.values()],
            "seconds": [r[2] for r in rows.values()]})

    parts = docs.select(text).mapInArrow(probe, "rule string, n long, rejected long, seconds double")
    return parts.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("n", "rejected", "seconds")])


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", per_task: int = 48) -> list[Rule]:
    """The rules by sampled rejections per second, best first; a rule not seen rejecting goes by its cost."""
    found = {r["rule"]: r for r in rule_statistics(docs, rules, text, per_task).collect()}  # one row per rule

    def gain(rule: Rule) -> float:
        row = found.get(rule.name)
        return (row["rejected"] + 0.5) / (row["seconds"] + 1e-6) if row else 0.0

    return sorted(rules, key=lambda r: (-gain(r), r.name))


def first_rejection(text: Text, order: Sequence[Rule]) -> str | None:
    for rule in order:
        if rule.rejects(text):
            return rule.name
    return None


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", per_task: int = 48) -> DataFrame:
    """The documents that no rule rejects, all columns as they are. Nothing is shuffled."""
    order = cascade_order(docs, rules, text, per_task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(Text(x), order) is None for x in _texts(batch, text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, base: Sequence[Rule] = BASE_RULES, more: Sequence[Rule] = MORE_RULES, key: str = "doc_id",
          text: str = "text", per_task: int = 48) -> DataFrame:
    """Base counts of every document, whether a base rule rejects it, and the cascade's verdict."""
    order = cascade_order(docs, more, text, per_task)
    kind = docs.schema[key].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Text(x) for x in _texts(batch, text)]
            failed = [any(r.rejects(t) for r in base) for t in texts]
            kept = [not f and first_rejection(t, order) is None for t, f in zip(texts, failed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(key)), *[pa.array([getattr(t, c) for t in texts], pa.int64()) for c in counts],
                 pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=[key, *counts, "base_failed", "kept"])

    return docs.select(key, text).mapInArrow(
        run, f"{key} {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean")
