"""Merkle manifest against a plain tree, with nulls, repeats, ties, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long, g string, n int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def tree(items):
    """Root and, per item, its steps (place, run)."""
    nodes, steps = [(d, [i]) for i, d in enumerate(items)], [[] for _ in items]
    while len(nodes) > 1:
        up = []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for j, (_, below) in enumerate(run):
                for i in below:
                    steps[i].append((j, [d for d, _ in run]))
            up.append((h(d for d, _ in run), [i for _, below in run for i in below]))
        nodes = up
    return nodes[0][0], steps


def expected(rows):
    by_source = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        crc = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        bent = text.replace("\n", "") if text is not None and crc is not None and crc % 2 == 0 else text
        by_source.setdefault(source, []).append(
            (doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, bent)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for s in names]
    subs = [tree([r[1] for r in g]) for g in groups]
    root, upper = tree([s for s, _ in subs])
    out = Counter()
    for g, (sub, steps), above in zip(groups, subs, upper):
        for (doc_id, own, bent), below in zip(g, steps):
            now = bent
            for place, run in below + above:
                now = h(run[:place] + [now] + run[place + 1:])
            proof = h(d for place, run in below + above for d in run[:place] + run[place + 1:])
            out[doc_id, own, sub, root, proof, now, now == root] += 1
    return out


def rows():
    out = [(i, f"text {i}\nwith lines\n" * (i % 4), "en", ["hot", "hot", "é", "z", None][i % 5], i, "x", 1, "x", 1) for i in range(70)]
    out += [(100, None, None, "lone", None, "x", 1, "x", 1), (None, "a\nb", "en", "hot", 3, "x", 1, "x", 1), (None, "a\nb", "en", None, 3, "x", 1, "x", 1)]
    out += [out[3]] * 11 + [(3, "other text\nof a taken id", "en", "z", 1, "x", 1, "x", 1), (101, "", "en", "", 0, "x", 1, "x", 1)]
    out += [(200, "very long \n" * 40000, "en", "z", 1, "x", 1, "x", 1)]
    return out


@pytest.mark.parametrize("depth", [1, 2, mm.DEPTH])
def test_audit_equals_plain_tree(spark, depth):
    got = mm.audit(spark.createDataFrame(rows(), SCHEMA).repartition(3), depth)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = Counter(map(tuple, got.select(*columns).collect()))
    assert got == expected(rows())
    assert {k[-1] for k in got} == {True, False}


def test_block_size_does_not_show(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    one, two = (Counter(tuple(map(str, r)) for r in mm.manifest(docs, depth=d).select("key", "leaf", "root", "shape", "siblings").collect()) for d in (1, 3))
    assert one == two


def test_witness_leads_to_root_and_notices_change(spark):
    for r in mm.manifest(spark.createDataFrame(rows(), SCHEMA), depth=2).filter("key % 9 = 0").collect():
        assert mm.fold(r.leaf, r["shape"], r.siblings) == r.root
        assert mm.fold(h(r.leaf), r["shape"], r.siblings) != r.root


@pytest.mark.parametrize("n", [*range(1, 12), 26, 27, 28])
def test_frontier(n):
    items = [h(str(i)) for i in range(n)]
    front = mm.Frontier()
    for d in items:
        front.append(d)
    root, steps = tree(items)
    assert front.finish(None) == root
    for own, path, shape, siblings in zip(items, steps, front.shape, front.siblings):
        assert [divmod(m, 4) for m in shape] == [(place, len(run)) for place, run in path]
        assert mm.fold(own, bytes(shape), bytes(siblings)) == root


def test_empty_and_single(spark):
    assert mm.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    one = mm.audit(spark.createDataFrame(rows()[:1], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h("") and one.verified


def test_registered_query(spark, tmp_path):
    from graphloom.llm import queries

    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path))
    assert Counter(map(tuple, out.collect())) == expected(rows())
    assert out.filter(F.col("root").isNull()).count() == 0
