"""Training-data operators against brute force, with nulls, empty and very long texts, ties, repeats and odd columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import (html_graph, lattice_neighbours, ngram_join, paragraph_dedup, piece_codec, quality_cascade, source_mix,
                           suffix_dedup, toxic_cnn, warc_shards)
from graphloom.llm.common import mark_possible, without
from graphloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n bigint, node string, size string, _k int"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)) + "."


def rows():
    """Documents with copies, near copies, shared passages, repeats, nulls and columns whose names clash."""
    rng = random.Random(4)
    passage = sentence(rng, 60)
    texts = [None, "", " \n\t ", "one", "one two", "ONE two", "a b c", "A B C", "x" * 5000, "ab" * 400, "é" * 300 + " 𝄞 tail"]
    for k in range(12):
        body = "\n".join(sentence(rng, rng.randint(6, 60)) for _ in range(rng.randint(1, 7)))
        texts.append(body)
        if k % 3 == 0:
            texts.append(body)  # exact copy
        if k % 4 == 0:
            words = body.split(" ")
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words))
        if k % 2:
            texts.append(sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 30))
        if k % 5 == 0:
            texts.append(sentence(rng, 12) + " " + passage + " " + sentence(rng, 12))
    texts.append(" ".join(sentence(rng, 40) for _ in range(400)))
    texts += ["same line\n" * 30, "### $$$ " * 40, "LOUD " + " ".join("".join(rng.choices("ABCDEFG", k=5)) for _ in range(80))]
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", "s3", "s4", None][min(4, i % 7)], len(t or ""), 7, "x", "y", 1) for i, t in enumerate(texts)]
    out += [out[11], (None, texts[12], "en", None, 1, 1, "x", "y", 1), (11, "another text under an id that is taken", "en", "s1", 1, 1, "x", "y", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def measures(text):
    raw = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", raw)
    seen, dup = set(), 0
    for line in raw.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    cover = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in raw), dup, len(cover)


def test_quality_counts_and_verdicts(docs, empty):
    got = bag(quality_cascade.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter()
    for r in rows():
        m = measures(r[1])
        want[(r[0], *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    assert quality_cascade.judge(empty).count() == 0
    kept = quality_cascade.keep_good(docs)
    assert kept.columns == docs.columns
    assert bag(kept, "doc_id") == bag(quality_cascade.judge(docs).filter("kept"), "doc_id")
    assert bag(kept, *docs.columns) <= bag(docs, *docs.columns)


def test_quality_order_does_not_change_verdicts():
    texts = [quality_cascade.Text((r[1] or "").encode()) for r in rows()]
    a = [quality_cascade.first_rejection(t, quality_cascade.RULES) is None for t in texts]
    assert a == [quality_cascade.first_rejection(t, quality_cascade.RULES[::-1]) is None for t in texts]


def test_cheap_rules_that_reject_run_first(spark):
    slow = quality_cascade.Rule("slow", lambda t: sum(range(20_000)) < 0)
    fast = quality_cascade.Rule("fast", lambda t: True)
    df = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    assert [r.name for r in quality_cascade.cascade_order(df, [slow, fast])] == ["fast", "slow"]


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*[words[i:] for i in range(k)])) if len(words) >= k else frozenset([tuple(words)]) if words else frozenset()


@pytest.mark.parametrize("size, percent, keep", [(3, 90, True), (5, 80, False)])
def test_jaccard_join_matches_brute_force(spark, docs, size, percent, keep):
    rng = random.Random(8)
    near = [r for r in rows() if r[0] is not None]
    near = list({r[0]: r for r in near}.values())
    base = [sentence(rng, 1)[:-1] for _ in range(120)]
    for k in range(40):
        words = list(base[:rng.choice([120, 118, 30, 14, 9])])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{k}"
        near.append((1000 + k, " ".join(words), "en", "s1", 0, 0, "", "", 0))
    df = spark.createDataFrame(near, SCHEMA)
    sets = {r[0]: shingle_set(r[1], size) for r in near}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r[0]: tuple(r)[1:] for r in ngram_join.jaccard_components(df, size=size, percent=percent, keep_signatures=keep).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    left = ngram_join.one_per_component(df, size=size, percent=percent, keep_signatures=keep)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {i for i in ids if root(i) == i}


def test_one_document_stays_of_each_component(spark):
    rng = random.Random(31)
    a, b, c, d, e = (sentence(rng, 120) for _ in range(5))

    def near(text):
        return text.rpartition(" ")[0] + " changed"

    data = [(1, a, "x"), (1, a, "y"), (2, near(a), "x"), (2, b, "x"), (None, b, "x"), (None, c, "x"), (None, c, "y"), (None, near(c), "x"),
            (3, d, "x"), (3, near(d), "x"), (4, e, "x"), (5, near(e), "x"), (6, "", "x"), (6, "", "x"), (None, None, "x"), (7, None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    left = ngram_join.one_per_component(df, size=5, percent=80, keep_signatures=False)
    assert left.columns == df.columns
    got = Counter(tuple(r) for r in left.collect())
    groups = [data[:3], data[3:5], data[5:8], data[8:10], data[10:12]]
    for g in groups:
        stay = [r for r in got.elements() if r in g]
        assert len(stay) == 1 and stay[0][0] == min((r[0] for r in g if r[0] is not None), default=None)
    assert got[6, "", "x"] == 2 and got[None, None, "x"] == 1 and got[7, None, "x"] == 1
    assert sum(got.values()) == len(groups) + 4


def test_jaccard_join_edge_cases(docs, empty):
    got = ngram_join.jaccard_components(docs)
    assert got.count() == docs.count()
    assert got.filter("n_shingles = 0 AND NOT component_id <=> doc_id").count() == 0
    assert ngram_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_allocations_lose_no_pair(percent):
    lows = ngram_join.bands(percent, 5000)
    for low, nxt in zip(lows, lows[1:]):
        ones, twos, spare = ngram_join.allocation(percent, low, nxt - 1, 100_000)
        assert ones - spare + 2 * twos > (nxt - 1) * (100 - percent) // percent
        assert -(-low * percent // 100) >= (lows[lows.index(low) - 1] if lows.index(low) else 1)


def removed(texts, window):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if count[r[i:i + window]] > 1:
                cover[i:i + window] = True
        left = bytes(b for b, c in zip(r, cover) if not c)
        spans = int((cover[1:] & ~cover[:-1]).sum() + cover[0]) if len(r) else 0
        out.append((len(r), int(cover.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup_matches_brute_force(docs, empty):
    want = Counter((r[0], *m) for r, m in zip(rows(), removed([r[1] for r in rows()], 200)))
    assert bag(suffix_dedup.removal_digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.removal_digest(empty).count() == 0


def test_suffix_dedup_cuts_texts(docs):
    got = suffix_dedup.remove_repeats(docs, length="n_chars")
    assert got.columns == docs.columns and got.count() == docs.count()
    for r in got.filter("doc_id > 11").collect():
        assert r.text is None or r.n_chars == len(r.text)


def test_long_texts_are_cut_into_pieces(monkeypatch, spark):
    rng = random.Random(1)
    body = sentence(rng, 2000)
    raw = body.encode()
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    whole = [(s + p[0], s + p[1], s + p[2], p[3], p[4]) for s, d in suffix_dedup._pieces(raw, 200) for p in zip(*suffix_dedup.runs(d, 200, 48))]
    covered = sorted(x for a, b, *_ in whole for x in range(a, b + 1))
    assert covered == list(range(len(raw) - 199))


def test_source_mix_targets(spark, docs, empty):
    got = source_mix.mixed_sizes(docs)
    assert got.count() == docs.count()
    rows_ = [r.asDict() for r in got.collect()]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows_)
    assert Counter(map(str, rows_)) == Counter(map(str, (r.asDict() for r in source_mix.mixed_sizes(docs.repartition(7)).collect())))
    assert source_mix.mixed_sizes(empty).count() == 0
    mix = source_mix.mixed_documents(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r["taken"] // r["size"] for r in rows_ if r["size"])


def test_source_mix_stays_near_targets(spark):
    rng = random.Random(3)
    data = [(i, "w " * rng.randint(1, 60), rng.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in source_mix.mixed_sizes(df).join(df, "doc_id").collect():
        by[r.source].append(r)
    budget = 1.5 * sum(r.size for v in by.values() for r in v)
    assert sum(v[0].target for v in by.values()) == pytest.approx(budget)
    for v in by.values():
        assert v[0].target <= 2 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= 120
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    free = {s: v[0].target / weights[s] for s, v in by.items() if v[0].target < 2 * v[0].source_size - 1}
    assert max(free.values()) == pytest.approx(min(free.values()))


@pytest.fixture(scope="module")
def segmenter():
    return piece_codec.Segmenter(piece_codec.read_vocabulary())


def best_pieces(v, symbols):
    """Viterbi by trying every piece at every position."""
    best, back = [0], [None]
    for at in range(1, len(symbols) + 1):
        top = None
        for length in range(min(16, at), 0, -1):
            part = symbols[at - length:at]
            piece = "".join(part)
            if piece in v["pieces"] and all(len(x) == 1 for x in part):
                i, s = v["pieces"][piece]
                if top is None or best[at - length] + s > top[0]:
                    top = (best[at - length] + s, length, [i])
        if symbols[at - 1] not in v["pieces"]:
            raw = (piece_codec.MARK if symbols[at - 1] == piece_codec.LITERAL_MARK else symbols[at - 1]).encode()
            spelled = best[at - 1] + len(raw) * v["byte_score"]
            if top is None or spelled > top[0]:
                top = (spelled, 1, [v["bytes"][b] for b in raw])
        best.append(top[0])
        back.append(top)
    out, at = [], len(symbols)
    while at:
        out = back[at][2] + out
        at -= back[at][1]
    return out


def test_pieces_match_brute_force_and_round_trip(segmenter):
    import sentencepiece

    v = piece_codec.read_vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.DEFAULT_MODEL)
    rng = random.Random(2)
    parts = ["a", "th", " ", "  ", "\n", "é", "▁", "中", "𝄞", "\t", "the ", " of", "x", "\x00"]
    cases = ["", " ", "  a  ", "▁a▁"] + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(500)]
    for text in cases:
        ids = segmenter.encode(text.encode()).tolist()
        symbols = [piece_codec.MARK if c == " " else piece_codec.LITERAL_MARK if c == piece_codec.MARK else c for c in " " + text] if text else []
        assert ids == best_pieces(v, symbols)
        assert segmenter.decode(np.array(ids, np.int32)) == text.encode()
        if piece_codec.MARK not in text:
            assert sp.decode(ids) == text


def test_encode_and_decode_tables(docs, empty):
    coded = piece_codec.encode(docs)
    assert coded.filter("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    back = bag(piece_codec.decode(coded), "doc_id", "text", "n")
    assert back == Counter((r[0], r[1] or "", r[5]) for r in rows())
    assert piece_codec.encode(empty).count() == 0


def pages():
    long = "<p>" + "word " * 30_000 + "</p>"
    html = [None, "", "<p>a</p>", "<p>a</p>", "<p>b</p>", long, "<article><h1>T</h1><p>text", "<p>a</p>"]
    out = [(i, f"http://x/{i}", h, "clash") for i, h in enumerate(html)]
    return out + [out[3], (None, None, "<p>b</p>", "clash"), (4, "http://y", "<p>other</p>", "clash"), (4000, None, "<p>far</p>", "clash")]


PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), PAGES)
    got = bag(warc_shards.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    best = defaultdict(list)
    for i, _, h, _ in pages():
        if i is not None:
            best[h or ""].append(i)
    want, used = Counter(), set()
    for i, _, h, _ in pages():
        raw, keeper = (h or "").encode(), max(best[h or ""])
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        response = i == keeper and (i, raw) not in used
        used.add((i, raw))
        want[(i, len(raw), digest, "response" if response else "revisit", None if response else keeper)] += 1
    assert got == want
    assert warc_shards.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_bytes_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES)
    found = []
    for k in (1, 5):
        target = f"file://{tmp_path}/{k}"
        found.append(bag(warc_shards.write_archives(df.repartition(k), target, file_bytes=2000, span=3), "file", "records", "bytes", "sha1"))
        assert not [p for p in (tmp_path / str(k)).iterdir() if p.name.startswith(".p")]
    assert found[0] == found[1] and len(found[0]) > 3


def test_html_text():
    model = html_graph.train(html_graph.labelled_pages())
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
      <div class="cookie-banner">We use cookies. Accept them.</div><!-- <p>no</p> -->
      <article><h1>Fish &amp; chips</h1><p>First   paragraph\n with <b>bold</b> words.<p>Second&nbsp;one &#233;.</p>
      <div class="ad">Buy this now. It is cheap.</div><ul><li>one item here</li><li>two items here</li></ul></article>
      <aside class="sidebar"><h3>Related</h3><a href=/c>More</a></aside><form><label>Mail</label><input></form>
      <section id="comments"><div class="comment"><p>I like this article. It is a good read.</p></div></section>
      <footer>&copy; me</footer></body></html>"""
    assert model.text(page) == "Fish & chips\nFirst paragraph with bold words.\nSecond one é.\none item here\ntwo items here"
    assert model.text(None) == model.text("") == model.text("<script>x") == ""


def test_html_open_elements_keep_the_page():
    model = html_graph.train(html_graph.labelled_pages())
    article = "<article><h1>Fish</h1><p>First paragraph with some words.</p><p>Second one, with more words.</p></article>"
    want = "Fish\nFirst paragraph with some words.\nSecond one, with more words."
    for head in ("<html><head><title>x</title>", "<head><meta charset=utf-8><noscript><link href=a></noscript><style>p{}</style>\n", "<head/>", "<head></head><body>"):
        assert model.text(head + article) == want
    runs = lambda page: [n.text for n in html_graph.parse(page) if n.text]
    assert runs("<head><title>x</title>Plain words") == ["Plain words"]
    for tag in ("button", "select", "svg", "object", "video", "audio", "canvas", "noscript", "template", "iframe", "datalist"):
        for page in (f"<body><{tag}>{article}", f"<body><div><{tag}></div>{article}", f"<body><div><{tag} class=c></div>{article}<{tag}></{tag}></body>"):
            assert runs(page) == want.split("\n"), page
    for tag in ("button", "select", "svg", "video", "canvas", "noscript", "template"):
        assert runs(f"<p>one</p><div><{tag}>gone <div>gone</div></{tag}> two</div>") == ["one", "two"]
    assert runs("<svg><g><svg>in</svg>in</g></svg>out") == ["out"]
    assert runs("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, <object data=a>see the text</object> too") == ["where x=1 holds, see the text too"]


def test_html_messages_are_exact_marginals():
    """Sum-product equals the sum over all labellings."""
    from itertools import product

    model = html_graph.train(html_graph.labelled_pages(80))
    nodes = html_graph.parse("<div class=content><p>Some words. More.</p><a href=/>x</a></div><div class=nav>y</div>")
    own = [model.evidence(n) for n in nodes]
    own[0] = [0.0, 0.0, 1.0]
    total = np.zeros((len(nodes), 3))
    for y in product(range(3), repeat=len(nodes)):
        p = np.prod([own[i][k] for i, k in enumerate(y)])
        for i, n in enumerate(nodes[1:], 1):
            p *= model.pair[n.tag == "#text"][y[n.parent]][y[i]]
        for i, k in enumerate(y):
            total[i, k] += p
    assert np.allclose(total / total.sum(1, keepdims=True), model.marginals(nodes))


def test_html_held_out_pages():
    model = html_graph.train(html_graph.labelled_pages())
    right = every = 0
    for page in html_graph.labelled_pages(150, seed=77):
        tree = html_graph.labelled_tree(page)
        want = [n for n in tree if n.text]
        got = model.marginals(html_graph.parse(re.sub(r' data-y="\d"', "", page)))
        every += len(want)
        right += sum((m[1] > 0.5) == (n.label == 1) for n, m in zip(tree, got) if n.text)
    assert right / every > 0.95


def test_html_table(spark):
    got = html_graph.extract(spark.createDataFrame(pages(), PAGES)).collect()
    assert len(got) == len(pages())
    assert all(r.n_chars == len(r.text) for r in got)


def test_lattice_decoder_finds_nearest_points():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (300, 8))
    got = lattice_neighbours.nearest_e8(x)
    d = ((x - got) ** 2).sum(1)
    for root in lattice_neighbours.ROOTS:
        assert (((x - got - root) ** 2).sum(1) >= d - 1e-9).all()
    assert d.max() <= 1 + 1e-9  # the covering radius


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    vectors = [b for b in base] + [base[i % 7] + rng.normal(0, 0.03, 16) for i in range(150)] + [base[3]] * 5
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [1.0, 2.0]]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, [1.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("node", F.lit("clash"))
    got = {r[0]: tuple(r)[1:] for r in lattice_neighbours.near_duplicates(df, tables=8, probes=8, block=16).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.where(near, label[None], len(x)).min(1)
    found = sum(got[i][0] for i in range(len(x)))
    assert found >= 0.95 * (near.sum() - len(x))
    assert all(got[i][0] <= near[i].sum() - 1 for i in range(len(x)))
    assert sum(got[i][1] == label[i] for i in range(len(x))) >= 0.95 * len(x)
    assert all(got[1000 + i] == (0, 1000 + i, True) for i in range(len(bad)))
    assert got[None] == (0, None, False)
    assert lattice_neighbours.near_duplicates(df.limit(0)).count() == 0


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(5)
    data, labels = [], []
    for i in range(900):
        words = [sentence(rng, 1)[:-1] for _ in range(rng.randint(20, 60))]
        bad = i % 5 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zzgr" + rng.choice("abcdef") * 3]))
        data.append((i, " ".join(words), rng.choice(["en", "fr"])))
        labels.append((i, int(bad)))
    data += [(5000, None, None), (5001, "", "en"), (None, "x", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxic_cnn.score(docs, lab).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert {i for i in range(900) if got[i].held_out} == {i for i in range(900) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    right = sum(got[i].predicted == (i % 5 == 0) for i in held) / len(held)
    assert right > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[None].held_out is False
    nothing = toxic_cnn.score(docs, lab.limit(0)).collect()
    assert {r.score for r in nothing} == {0.0}


def test_language_thresholds():
    got = toxic_cnn.language_thresholds([0.1] * 20 + [0.4] * 10, [0] * 20 + [1] * 10, ["en"] * 30)
    assert got["en"] == pytest.approx(0.25)


def test_bands_are_tuned_for_recall():
    bands, width = paragraph_dedup.tune_bands(0.8, 0.99, 24)
    assert bands * width <= 24 and paragraph_dedup.band_recall(0.8, bands, width) >= 0.99


def test_paragraph_dedup(spark, docs, empty):
    got = paragraph_dedup.removable(docs)
    assert got.count() == docs.count()
    by = {r.doc_id: r for r in got.collect() if r.doc_id not in (None, 11)}
    data = {r[0]: r[1] for r in rows() if r[0] not in (None, 11)}
    passage = Counter(line for t in data.values() for line in set((t or "").split("\n")) if len(line.split()) == 60).most_common(1)[0][0]
    holders = sorted(i for i, t in data.items() if t and passage in t)
    assert len(holders) > 5
    assert all(by[i].n_repeated for i in holders)
    assert all(by[i].n_removed for i in holders[1:])
    for i in holders:
        left = paragraph_dedup.cut(data[i].encode(), by[i].starts, by[i].ends).decode()
        assert (passage[-200:] in left) == (i == holders[0])
    assert by[0].n_paragraphs == 0 and by[0].starts == []
    assert paragraph_dedup.removable(empty).count() == 0


def test_paragraphs_near_and_apart(spark):
    rng = random.Random(12)
    line = sentence(rng, 60).split(" ")
    near, far = list(line), list(line)
    near[30] = "other"
    for k in range(0, 60, 6):
        far[k] = "other"
    alone = sentence(rng, 60)
    df = spark.createDataFrame([(1, " ".join(line)), (2, " ".join(near)), (3, " ".join(far)), (4, alone), (5, "short line\nshort line")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in paragraph_dedup.removable(df).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_passages_anywhere_in_a_text(spark):
    rng = random.Random(21)

    def plain(n):
        return sentence(rng, n)[:-1]

    long, verse, other = plain(60), "\n".join(plain(5) for _ in range(12)), plain(80).split(" ")
    edited = " ".join([*other[:41], "changed", *other[42:]])
    hosts = [(plain(a), plain(b)) for a, b in ((33, 41), (17, 50), (25, 25), (44, 13), (29, 37), (51, 22))]
    planted = [long, long, verse, verse, " ".join(other), edited]
    breaks = [(" ", " "), (". And so ", " then "), ("\n", "\n"), (" or ", "\n"), (" ", " "), (" but ", " ")]
    texts = [a + x + p + y + b for (a, b), (x, y), p in zip(hosts, breaks, planted)]
    texts += [plain(40) + " " + " ".join(plain(60).split(" ")[:12]), "x y " * 60]
    got = {r.doc_id: r for r in paragraph_dedup.removable(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in (1, 3, 5):
        raw = texts[i].encode()
        assert [raw[a:b].decode() for a, b in zip(got[i].starts, got[i].ends)] == [planted[i]]
        assert got[i].n_removed == 1
    for i in (0, 2, 4, 6):
        assert got[i].starts == []
    assert paragraph_dedup.cut(texts[7].encode(), got[7].starts, got[7].ends).decode().split() == ["x", "y"] * 4


def test_equal_stretches_share_an_anchor():
    rng = np.random.default_rng(3)
    same = rng.integers(0, 1 << 62, 20 - 8 + 1).astype(np.uint64)
    for k in range(50):
        sides = [[rng.integers(0, 1 << 62, k).astype(np.uint64), rng.integers(0, 1 << 62, 30).astype(np.uint64)] for _ in range(2)]
        found = [{int(i) - len(a) for i in paragraph_dedup.anchors(np.concatenate([a, same, b]), len(same))} & set(range(len(same))) for a, b in sides]
        assert found[0] & found[1]


def test_components_and_bitmap(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 200), (200, 300), (7, 7), (None, 5)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100, **{1000 + i: 1000 for i in range(40)}}
    ids = spark.range(0, 1000, 3).toDF("id")
    marked = mark_possible(spark.range(1000).toDF("id"), "id", ids, "m", 1 << 16)
    hit = {r.id for r in marked.filter("m").collect()}
    assert set(range(0, 1000, 3)) <= hit and len(hit) < 360
    assert {r.id for r in without(spark.range(1000).toDF("id"), "id", ids).collect()} == set(range(1000)) - set(range(0, 1000, 3))
