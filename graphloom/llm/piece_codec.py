"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces of a public vocabulary. A text goes through it once; at each position the
output links give every piece that ends there, longest first, and each relaxes the best score of the text so
far. Following the back pointers gives the best segmentation. A character without a piece is spelled in byte
pieces.

A unigram vocabulary brings its log probabilities. A merge vocabulary only ranks its pieces, so the log
probability of a piece is taken as -log(rank), Zipf's law; its segmentations may differ from merging in
order, but use the same pieces and decode to the same text. Nothing is trained.

As in the original scheme, spaces become a visible mark and one is put in front. No piece has the mark
after another character (checked when the vocabulary is read), so the best segmentation of a text is that
of its space-led chunks, and each worker keeps the answers for chunks it has seen, up to a fixed number.

Defined results: a null or empty text has no pieces and decodes to the empty text. Every text decodes to
exactly itself: runs of spaces, line breaks, the mark itself (spelled in bytes) and long texts included.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
LITERAL_MARK = "literal mark"  # a symbol of its own, so that a mark in a text is no space
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = DEFAULT_MODEL) -> dict:
    """Pieces with log probabilities, byte pieces, and the bytes that each id decodes to."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    data = {i: int(sp.id_to_piece(i)[1:-1], 16) for i in ids if sp.is_byte(i)}
    plain = [i for i in ids if not (i in data or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranked = any(sp.get_score(i) == -1e9 for i in plain) or all(sp.get_score(i) == round(sp.get_score(i)) for i in plain)
    # Whole micro-units add up exactly, so ties are ties in any order of addition; the longest last piece wins them.
    score = {i: round(1e6 * (-math.log(k + 2) if ranked else sp.get_score(i))) for k, i in enumerate(plain)}
    pieces = {sp.id_to_piece(i): (i, score[i]) for i in plain}
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("the vocabulary has pieces that reach over a space")
    decode = [b"" for _ in ids]
    for piece, (i, _) in pieces.items():
        decode[i] = piece.replace(MARK, " ").encode()
    for i, b in data.items():
        decode[i] = bytes([b])
    return {"name": path, "pieces": pieces, "bytes": {b: i for i, b in data.items()}, "byte_score": min(score.values()) - 1_000_000, "decode": decode}


class Segmenter:
    """The automaton, and the answers for chunks seen so far."""

    def __init__(self, vocabulary: dict, remember: int = 250_000):
        self.byte_ids, self.byte_score, self.table = vocabulary["bytes"], vocabulary["byte_score"], vocabulary["decode"]
        self.remember, self.seen = remember, {}
        self.step: list[dict[str, int]] = [{}]
        own: list[tuple[int, int, int] | None] = [None]
        for piece, (i, score) in vocabulary["pieces"].items():
            at = 0
            for ch in piece:
                nxt = self.step[at].get(ch)
                if nxt is None:
                    nxt = self.step[at][ch] = len(self.step)
                    self.step.append({})
                    own.append(None)
                at = nxt
            own[at] = (len(piece), score, i)
        self.fail = [0] * len(self.step)
        # Pieces that end in a state: its own, then those along its output link, longest first.
        self.ends: list[tuple] = [()] * len(self.step)
        queue = deque(self.step[0].values())
        for s in queue:
            self.ends[s] = (own[s],) if own[s] else ()
        while queue:
            s = queue.popleft()
            for ch, t in self.step[s].items():
                f = self.fail[s]
                while f and ch not in self.step[f]:
                    f = self.fail[f]
                self.fail[t] = self.step[f].get(ch, 0)
                self.ends[t] = ((own[t],) if own[t] else ()) + self.ends[self.fail[t]]
                queue.append(t)

    def viterbi(self, symbols: list[str]) -> list[int]:
        best, back = [0], [None]
        step, fail, ends, state = self.step, self.fail, self.ends, 0
        for at, ch in enumerate(symbols, 1):
            while state and ch not in step[state]:
                state = fail[state]
            state = step[state].get(ch, 0)
            top, how, single = -math.inf, None, False
            for length, score, i in ends[state]:
                value = best[at - length] + score
                single = single or length == 1
                if value > top:
                    top, how = value, (length, i)
            if not single:  # no piece for the character alone: spell it
                raw = MARK.encode() if ch == LITERAL_MARK else ch.encode()
                value = best[at - 1] + len(raw) * self.byte_score
                if value > top:
                    top, how = value, (1, raw)
            best.append(top)
            back.append(how)
        out, at = [], len(symbols)
        while at:
            length, i = back[at]
            out.append(i)
            at -= length
        ids = []
        for i in reversed(out):
            ids.extend([i] if isinstance(i, int) else [self.byte_ids[b] for b in i])
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        """Packed ids of one chunk; a chunk without leading spaces stands for one with a single space."""
        symbols = [MARK if c == " " else LITERAL_MARK if c == MARK else c for c in chunk.decode()]
        packed = np.array(self.viterbi(symbols if chunk[:1] == b" " else [MARK, *symbols]), np.int32).tobytes()
        if len(self.seen) < self.remember and len(chunk) <= 64:
            self.seen[chunk] = packed
        return packed

    def encode(self, raw: bytes) -> np.ndarray:
        if not raw:
            return np.empty(0, np.int32)
        if b"  " in raw or raw[:1] == b" " or raw[-1:] == b" ":
            parts = [c[1:] if len(c) > 1 and c[1:2] != b" " else c for c in re.findall(rb" +[^ ]*", b" " + raw)]
        else:
            parts = raw.split(b" ")
        seen, chunk = self.seen, self._chunk
        return np.frombuffer(b"".join([seen.get(p) or chunk(p) for p in parts]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))[1:]


_READY: dict[str, Segmenter] = {}


def _segmenter(vocabulary: dict) -> Segmenter:
    """One segmenter per worker process and vocabulary."""
    name = vocabulary["name"]
    if name not in _READY:
        _READY.clear()
        _READY[name] = Segmenter(vocabulary)
    return _READY[name]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _make_room(df: DataFrame, new: list[str]) -> DataFrame:
    """``df`` with columns that clash with ``new`` names, in either case, renamed to ``own_`` and their name."""
    taken = {c.lower() for c in [*df.columns, *new]}
    clash = {c.lower() for c in new}
    names = []
    for c in df.columns:
        name = c
        while name.lower() in clash or name != c and name.lower() in taken:
            name = f"own_{name}"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def encode(docs: DataFrame, text: str = "text", model: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """``docs`` without its text but with the piece ids, their number and whether they decode to the text.

    Null and empty texts have no pieces. Every row is coded by itself, repeated ones too; an empty table gives an empty
    table. Own columns that are called like a new one stay as ``own_`` and their name (again ``own_`` while that is taken).
    """
    vocabulary = read_vocabulary(model)  # goes to the tasks with the function; as large as its file, whatever the input
    docs = _make_room(docs, [c for c in (ids, "n_tokens", "round_trip") if c != text])
    kept = [c for c in docs.columns if c != text]
    inner = docs.select(*kept, text)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{ids}` array<int>, n_tokens long, round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                raws = [x or b"" for x in _column(batch, text).cast(pa.binary()).to_pylist()]
                found = [seg.encode(x) for x in raws]
                sizes = [len(x) for x in found]
                ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[_column(batch, c) for c in kept], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found))),
                     pa.array(sizes, pa.int64()), pa.array([seg.decode(x) == r for x, r in zip(found, raws)])],
                    names=[*kept, ids, "n_tokens", "round_trip"])

    return inner.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", model: str = DEFAULT_MODEL, text: str = "text") -> DataFrame:
    """``rows`` with the text that the piece ids stand for; null ids give a null text."""
    vocabulary = read_vocabulary(model)
    kept = [c for c in rows.columns if c not in (ids, text)]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(vocabulary)
        for batch in batches:
            lists = _column(batch, ids)
            texts = [seg.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*[_column(batch, c) for c in kept], pa.array(texts, pa.string())], names=[*kept, text])

    return rows.select(*kept, ids).mapInArrow(run, schema)
