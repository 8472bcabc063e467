"""corpus_pipeline.run as a whole against brute force, stage after stage."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import sentencepiece

import corpus_pipeline
from graphloom.llm import piece_codec

from .test_operators import measures, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size int"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n)) + "."


def table():
    rng = random.Random(12)
    passage = prose(rng, 70)
    texts = [None, "", "too short", "LOUD " * 80, "$ # " * 70, "one line of a few words\n" * 40, prose(rng, 49), prose(rng, 3000)]
    for k in range(14):
        body = prose(rng, rng.randint(60, 260)) + "\n" + prose(rng, 20)
        texts.append(body)
        if k % 3 == 0:
            texts.append(body)
        if k % 4 == 0:
            texts.append(body.replace(" ", "  ", 3).rpartition(" ")[0] + " other")
        if k % 5 == 0:
            texts.append(prose(rng, 40) + " " + passage + " " + prose(rng, 40))
    texts.append("é𝄞 " + passage[:-1] + "é " + prose(rng, 30))
    out = [(i, t, ["en", None][i % 2], ["a", "a", "a", "b", "c", None][i % 6], len(t or ""), "x", 3) for i, t in enumerate(texts)]
    lone = prose(rng, 90)
    return out + [out[9], (None, texts[8], "en", "a", len(texts[8]), "x", 3), (None, lone, "fr", "b", len(lone), "y", None), (None, None, None, None, None, None, None)]


def good(r):
    text = r[1] or ""
    words, chars, symbols, dup, repeats = measures(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    return not (words < 50 or 100 * repeats > 50 * words or 10 * symbols > 3 * words or 100 * dup > 40 * len(lines)
                or 100 * upper > 50 * letters or chars < 2 * words or chars > 20 * words)


def one_of_each(rows):
    sets, up = [shingle_set(r[1], 5) for r in rows], list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, j in combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[root(j)] = root(i)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def cut(rows):
    raws = [r[1].encode() for r in rows]
    count = Counter(b[i:i + 200] for b in raws for i in range(len(b) - 199))
    out = []
    for r, b in zip(rows, raws):
        gone = {k for i in range(len(b) - 199) if count[b[i:i + 200]] > 1 for k in range(i, i + 200)}
        text = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        out.append((r[0], text, r[2], r[3], len(text), *r[5:]))
    return out


def mixed(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target = 1.5 * sum(size), {}
    while len(target) < len(order):
        rest = budget - sum(target.values())
        free = [s for s in order if s not in target]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s: 2.0 * total[s] for s in free if share[s] > 2 * total[s]}
        target |= full or share
    queue, out, used = [], [], 0
    for s in order:
        upto = 0
        places = [(e, hashlib.md5(f"mix:{e}:{'-' if r[0] is None else r[0]}:{n}".encode()).hexdigest(), r, n) for e in (0, 1) for r, n in zip(rows, size) if n and r[3] == s]
        for *_, r, n in sorted(places, key=lambda p: p[:2]):
            upto += n
            queue.append((upto / target[s], r, n))
    for _, r, n in sorted(queue, key=lambda q: q[0]):
        used += n
        if used > budget:
            break
        out.append(r)
    return out


def test_run_matches_brute_force(spark, tmp_path):
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows, sizes = table(), []
    for stage in (lambda x: [r for r in x if good(r)], one_of_each, cut, mixed):
        rows = stage(rows)
        sizes.append(len(rows))
    assert sizes[0] < len(table()) and sizes[1] < sizes[0] and sizes[3] > sizes[2]
    assert sum(r[4] for r in cut(one_of_each([r for r in table() if good(r)]))) < sum(r[4] for r in one_of_each([r for r in table() if good(r)]))
    assert [c for c in got.columns if c not in ("ids", "n_tokens", "round_trip")] == ["doc_id", "lang", "source", "n_chars", "node", "size"]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.DEFAULT_MODEL)
    found = got.collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    assert Counter((r.doc_id, sp.decode(list(r.ids)), r.lang, r.source, r.n_chars, r.node, r["size"]) for r in found) == Counter(rows)


def test_run_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"doc_id", "ids", "n_tokens"} <= set(got.columns)


@pytest.mark.parametrize("keep", [0, 4])
def test_run_on_nothing_good(spark, tmp_path, keep):
    bad = [r for r in table() if not good(r)][:keep] + [(None, None, None, None, None, None, None)]
    spark.createDataFrame(bad, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
