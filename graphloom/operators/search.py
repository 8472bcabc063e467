"""Symbol search and ranking for batches of queries.

Scores depend only on the distinct name (or path), so names are matched once and expanded to symbols
afterwards. Before the expansion each name keeps its first ``n`` symbols: no later one can enter a
top ``n``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import normalise_camel, normalise_query, words
from .scale import containing_pairs, first_per_key, grams, top_n
from ..session import cut_lineage

PLACE = ("name", "file", "start_line", "symbol_id")


def similarity(a: Column, b: Column) -> Column:
    """One minus edit distance over the longer byte length; two empty texts are equal."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.octet_length(x), F.octet_length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def _named(symbols: DataFrame, n: int) -> DataFrame:
    """First ``n`` symbols of every lower-case name."""
    s = symbols.select(F.lower("name").alias("_lname"), *PLACE)
    return top_n(s, ["_lname"], [F.col(c) for c in PLACE], n)


def search_cascade(queries: DataFrame, symbols: DataFrame, n: int = 20) -> DataFrame:
    """Names equal to the query without regard to case; only without any, names that contain it."""
    q = queries.select("query", F.lower("query").alias("_lq")).distinct()
    # Files of few distinct values are small and their rows are not: never send them through the driver.
    named = cut_lineage(_named(symbols, n)).hint("merge")
    exact = q.join(named, F.col("_lq") == F.col("_lname")).withColumn("tier", F.lit("exact"))
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    pairs = containing_pairs(rest, "_lq", named, "_lname")
    part = rest.join(pairs, "_lq").join(named, "_lname").withColumn("tier", F.lit("contains"))
    cols = ["query", "tier", *PLACE]
    return top_n(exact.select(*cols).unionByName(part.select(*cols)), ["query"], [F.col(c) for c in PLACE], n, "rank")


# Names of one length that share a join key, pairs that one task compares, and names of a gram that give a first score.
LENGTH_BLOCK, PAIRS_PER_TASK, GRAM_NAMES = 2048, 1 << 21, 64
# Fixed value: entries of one step of many edit distances.
STEP = 1 << 21


def _signature(text: Column) -> Column:
    """Up to three occurrences of each of 21 kinds of characters, a bit each; null beyond ASCII.

    An edit changes one occurrence, so two texts differ by at least the bits that only one of them has.
    """
    kind = lambda c: F.ascii(c) % 21 * 3

    def add(bits: Column, c: Column) -> Column:
        more = (F.call_function("shiftright", bits, kind(c)).bitwiseAND(F.lit(7).cast("bigint")) * 2 + 1).bitwiseAND(F.lit(7).cast("bigint"))
        return bits.bitwiseOR(F.call_function("shiftleft", more, kind(c)))

    return F.when(F.length(text) == F.octet_length(text), F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), add))


def _characters(texts: list[str], length: int) -> np.ndarray:
    """(length, texts): the characters of texts of one length."""
    return np.ascontiguousarray(np.array(texts, dtype=f"U{max(length, 1)}").view(np.uint32).reshape(len(texts), -1).T[:length])


def edit_distances(query: str, names: np.ndarray) -> np.ndarray:
    """Edit distance of a text to each of many of one length, given as ``_characters``."""
    length, n = names.shape
    if length * n > STEP and n > 1:
        return np.concatenate([edit_distances(query, names[:, :n // 2]), edit_distances(query, names[:, n // 2:])])
    at = np.arange(length + 1, dtype=np.int32)[:, None]
    row = np.repeat(at, n, axis=1)
    for i, c in enumerate(query, 1):
        step = np.empty_like(row)
        step[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (names != ord(c)), out=step[1:])
        # What an insertion brings from the left is a running minimum once places are taken off.
        row = np.minimum.accumulate(step - at, axis=0) + at
    return row[-1]


def _nearest(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """For each query of a block the names of one length that can be among its ``k`` nearest, with their distances.

    Names of one score stand in the order of ``_first``, and a score follows from the distance and the longer byte length:
    the first ``k`` of each byte length are enough.
    """

    def run(key: tuple, names: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if names.num_rows and asked.num_rows:
            names = names.sort_by("_first")
            texts, firsts, octets = names["_lname"].to_pylist(), names["_first"].to_pylist(), names["_octets"].to_numpy()
            has = names["_ns"].is_valid().to_numpy()
            bits, chars = names["_ns"].fill_null(0).to_numpy().view(np.uint64), _characters(texts, key[0].as_py())
            for query, low, floor, own in zip(*(asked[c].to_pylist() for c in ("query", "_lq", "_floor", "_qs"))):
                longest = np.maximum(octets, len(low.encode()))
                most = np.floor((1.000001 - floor) * longest)
                at = np.arange(len(texts))
                if own is not None:
                    own = np.uint64(own)
                    apart = np.maximum(np.bitwise_count(own & ~bits), np.bitwise_count(bits & ~own))
                    at = np.flatnonzero(~has | (apart <= most))
                distance = edit_distances(low, chars[:, at])
                near = distance <= most[at]
                at, distance = at[near], distance[near]
                for size in np.unique(longest[at]).tolist():
                    some = np.flatnonzero(longest[at] == size)
                    for j in some[np.argsort(distance[some], kind="stable")[:k]].tolist():
                        out.append((query, floor, texts[at[j]], firsts[at[j]], int(distance[j]), size))
        cols = list(zip(*out)) or [()] * 6
        kinds = pa.string(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.int32()
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query", "_floor", "_lname", "_first", "_d", "_long"])

    return run


def fuzzy_top_k(queries: DataFrame, symbols: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most similar symbols per query, exact; names without any similarity fill up what is missing.

    A first pass over ``GRAM_NAMES`` names of each three-letter piece of the query gives a score the
    ``k``-th result must reach. Two texts differ by at least their difference in length, so that
    score bounds the lengths a result can have, and an equality join on (length, salt) brings each
    query only to names of those lengths. Names of a length get one salt per ``LENGTH_BLOCK``, and the
    number of tasks follows the number of pairs, since pairs are the work and tables here are small.
    Characters that two texts do not share (``_signature``) spare most pairs the edit distance; those that are left
    are worked out for all names of a block at once, and a block gives no query more than its ``k`` nearest.
    """
    q = cut_lineage(queries.select("query", F.lower("query").alias("_lq")).distinct())
    named = cut_lineage(_named(symbols, k)).hint("merge")
    names = cut_lineage(named.groupBy("_lname").agg(F.count("*").alias("_c"), F.min("name").alias("_first")).withColumn("_len", F.length("_lname")))

    own = q.select("query", "_lq", F.explode(grams(F.col("_lq"), 3)).alias("_g"))
    post = names.select("_lname", "_c", F.explode(grams(F.col("_lname"), 3)).alias("_g")).join(own.select("_g").distinct(), "_g", "left_semi")
    few = top_n(post, ["_g"], [F.xxhash64("_lname"), F.col("_lname")], GRAM_NAMES)
    score = F.round(similarity(F.col("_lq"), F.col("_lname")), 6)
    near = own.join(few, "_g").select("query", "_lq", "_lname", "_c").distinct().withColumn("score", score)
    best = top_n(near, ["query"], [F.desc("score"), F.col("_lname")], k, "_r")
    so_far = F.sum("_c").over(W.partitionBy("query").orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    floor = best.withColumn("_have", so_far).groupBy("query").agg(F.max(F.when(F.col("_have") >= k, F.col("score"))).alias("_floor"))
    wide = cut_lineage(q.join(floor, "query", "left").withColumn("_floor", F.coalesce("_floor", F.lit(0.0))))

    # Names of a length differ in bytes; the largest ratio of bytes to characters bounds them all.
    ratio = names.agg(F.max(F.octet_length("_lname") / F.greatest("_len", F.lit(1)))).first()[0] or 1.0
    sizes = names.groupBy("_len").agg(F.count("*").alias("_n"))
    sizes = cut_lineage(sizes.withColumn("_salts", F.ceil(F.col("_n") / LENGTH_BLOCK).cast("int")))
    tasks = max(1, -(-q.count() * names.count() // PAIRS_PER_TASK))
    reach = (1.000001 - F.col("_floor"))
    fits = F.abs(F.col("_len") - F.length("_lq")) <= reach * F.greatest(F.col("_len") * ratio, F.octet_length("_lq"))
    asked = wide.crossJoin(sizes).filter(fits).select(
        "query", "_lq", "_floor", "_len", _signature(F.col("_lq")).alias("_qs"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    keyed = names.join(sizes, "_len").select("_lname", "_first", "_len", F.octet_length("_lname").alias("_octets"), _signature(F.col("_lname")).alias("_ns"),
                                             F.pmod(F.hash("_lname"), F.col("_salts")).alias("_salt"))
    blocks = [df.repartition(tasks, "_len", "_salt").groupBy("_len", "_salt") for df in (keyed, asked)]
    close = blocks[0].cogroup(blocks[1]).applyInArrow(_nearest(k), "query string, _floor double, _lname string, _first string, _d int, _long int")
    # Scores are rounded to six digits, as ``similarity`` gives them.
    value = F.when(F.col("_long") == 0, 1.0).otherwise(1 - F.col("_d") / F.col("_long"))
    scored = close.withColumn("score", F.round(value, 6)).filter((F.col("score") > 0) & (F.col("score") >= F.col("_floor")))
    # Names of one score stand in the order of their first spelling, as their symbols do.
    rows = top_n(scored.select("query", "score", "_lname", "_first"), ["query"], [F.desc("score"), F.col("_first")], k, "_r").join(named, "_lname")
    found = cut_lineage(top_n(rows.select("query", "score", *PLACE), ["query"], [F.desc("score"), *[F.col(c) for c in PLACE]], k))
    # A query with fewer than k similar symbols has them all; the first 2k symbols hold enough others.
    short = q.join(found.groupBy("query").agg(F.count("*").alias("_c")), "query", "left").filter(F.coalesce("_c", F.lit(0)) < k)
    first = symbols.select(*PLACE).orderBy(*PLACE).limit(2 * k).withColumn("_k", F.lit(1))
    fill = short.select("query", F.lit(1).alias("_k")).join(F.broadcast(first), "_k").drop("_k").join(
        found.select("query", "symbol_id"), ["query", "symbol_id"], "left_anti").withColumn("score", F.lit(0.0))
    both = found.unionByName(fill.select("query", "score", *PLACE))
    return top_n(both, ["query"], [F.desc("score"), *[F.col(c) for c in PLACE]], k, "rank").select("query", "score", *PLACE, "rank")


def search_with_fallback(queries: DataFrame, symbols: DataFrame, n: int = 20, k: int = 8) -> DataFrame:
    """Cascade first; queries without any hit fall back to similarity. Reports the tier used."""
    hits = cut_lineage(search_cascade(queries, symbols, n))
    rest = queries.select("query").distinct().join(hits.select("query").distinct(), "query", "left_anti")
    fuzzy = fuzzy_top_k(rest, symbols, k).withColumn("tier", F.lit("fuzzy"))
    cols = ["query", "tier", *PLACE, "rank"]
    return hits.select(*cols).unionByName(fuzzy.select(*cols))


# Fixed value: an index of terms drops those of this many bytes or more.
LONG_TERM = 40


def terms(text: Column, too_long: int = LONG_TERM) -> Column:
    """Lower-case alphanumeric terms shorter than ``too_long`` bytes."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.lower)
    return F.filter(found, lambda w: F.octet_length(w) < too_long)


# Names of one block, on average.
BLOCK = 32
K1, B = 1.2, 0.75


class TermIndex(NamedTuple):
    """Inverted index over the distinct names of symbols, in blocks of equal impact.

    ``names``: name, t (its terms). ``classes``: term, tf, len, impact, parts, one row per way a term can weigh in a name.
    ``blocks``: term, tf, len, part, names. ``terms``: term, idf, top (its largest impact). ``stats``: one row.
    """

    names: DataFrame
    classes: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


def _weight(tf: Column, size: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


def term_index(symbols: DataFrame) -> TermIndex:
    """Index the name terms of ``symbols``; statistics count symbols, postings count distinct names.

    What a term adds to a name's score depends on its count in the name and the name's length alone. Postings that agree
    in both have one impact, so no list has to be sorted: it is dealt by hash into parts of about ``BLOCK`` names.
    """
    named = cut_lineage(symbols.groupBy("name").agg(F.count("*").alias("copies")).withColumn("t", terms(F.col("name"))))
    stats = named.agg(F.sum("copies").alias("docs"), (F.sum(F.size("t") * F.col("copies")) / F.sum("copies")).alias("average"))
    stats = cut_lineage(stats.withColumn("_k", F.lit(1)))
    post = named.select("name", "copies", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("name", "term").agg(
        F.count("*").alias("tf"), F.first("copies").alias("copies"), F.first("len").alias("len"))
    post = cut_lineage(post)
    found = post.groupBy("term", "tf", "len").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    df = found.groupBy("term").agg(F.sum("copies").alias("df")).withColumn("_k", F.lit(1)).join(F.broadcast(stats), "_k")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    classes = found.join(df.select("term", idf.alias("idf"), "average"), "term").select(
        "term", "tf", "len", "idf", (F.col("idf") * _weight(F.col("tf"), F.col("len"), F.col("average"))).alias("impact"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    classes = cut_lineage(classes)
    part = F.pmod(F.hash("name"), F.col("parts"))
    blocks = post.join(classes, ["term", "tf", "len"]).groupBy("term", "tf", "len", part.alias("part")).agg(F.collect_list("name").alias("names"))
    best = classes.groupBy("term").agg(F.max("idf").alias("idf"), F.max("impact").alias("top"))
    return TermIndex(named, classes.drop("idf"), cut_lineage(blocks), cut_lineage(best), stats)


def bm25(queries: DataFrame, symbols: DataFrame, n: int = 10, index: TermIndex | None = None) -> DataFrame:
    """Relevance ranking of symbols by their name terms; any query term may match.

    One block per query term gives scores, and the ``n``-th of them is a floor for the query. The terms of a query stand
    in order of what they can add. A name met first through one of them holds none before it, so at best it scores the
    impact of its block plus all that later terms can add: only blocks for which that reaches the floor are read. Scores
    of the names in them are exact.
    """
    index = index or term_index(symbols)
    asked = queries.select("query", F.explode(terms(F.col("query"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("w"))
    asked = asked.join(index.terms, "term").withColumn("most", F.col("w") * F.col("top"))
    later = W.partitionBy("query").orderBy(F.desc("most"), "term").rowsBetween(1, W.unboundedFollowing)
    asked = cut_lineage(asked.withColumn("later", F.coalesce(F.sum("most").over(later), F.lit(0.0))))
    wanted = asked.groupBy("query").agg(F.collect_list(F.struct("term", "w", "idf")).alias("asks"))

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.distinct().join(index.names, "name").join(wanted, "query").withColumn("_k", F.lit(1)).join(F.broadcast(index.stats), "_k")

        def part(ask: Column) -> Column:
            tf = F.size(F.filter("t", lambda x: x == ask["term"]))
            return ask["w"] * ask["idf"] * _weight(tf, F.size("t"), F.col("average"))

        score = F.aggregate("asks", F.lit(0.0), lambda total, ask: total + part(ask))
        return rows.select("query", "name", "copies", F.round(score, 6).alias("score"))

    lead = first_per_key(index.classes, ["term"], [F.desc("impact"), F.col("tf"), F.col("len")]).select("term", "tf", "len", F.lit(0).alias("part"))
    first = asked.join(index.blocks.join(lead, ["term", "tf", "len", "part"], "left_semi"), "term").select("query", F.explode("names").alias("name"))
    seen = top_n(scored(first), ["query"], [F.desc("score"), F.col("name")], n, "_r")
    so_far = F.sum("copies").over(W.partitionBy("query").orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    floor = seen.withColumn("_have", so_far).groupBy("query").agg(F.max(F.when(F.col("_have") >= n, F.col("score"))).alias("floor"))
    reach = asked.join(index.classes, "term").join(floor, "query", "left")
    # Scores are rounded to six digits.
    reach = reach.filter(F.col("floor").isNull() | (F.col("w") * F.col("impact") + F.col("later") >= F.col("floor") - 1e-6))
    pairs = reach.select("query", "term", "tf", "len").join(index.blocks, ["term", "tf", "len"]).select("query", F.explode("names").alias("name"))
    best = top_n(scored(pairs), ["query"], [F.desc("score"), F.col("name")], n).drop("copies")
    firsts = top_n(symbols.select("name", "symbol_id", "file"), ["name"], [F.col("symbol_id")], n)
    return top_n(best.join(firsts, "name"), ["query"], [F.desc("score"), F.col("name"), F.col("symbol_id")], n, "rank")


# Names of entry points that say little about a task.
GENERIC_NAMES = ("app", "index", "main", "bootstrap", "home", "root", "render")


def target_score(text: Column, symbol: Column, preferred: Column | None = None) -> Column:
    """How well a symbol name fits a task text."""
    def score(c: Column) -> Column:
        q_norm, s_norm, q_tok, s_tok = c["q_norm"], c["s_norm"], c["q_tok"], c["s_tok"]
        multi = F.size(s_tok) >= 2
        literal = F.contains(c["q_low"], c["s_low"])
        spelled = (s_norm != "") & F.contains(q_norm, s_norm)
        known = F.size(F.filter(s_tok, lambda w: F.array_contains(q_tok, w)))
        every = (F.size(s_tok) > 0) & (known == F.size(s_tok))

        def add(cond: Column, many: Column, one: Column) -> Column:
            return F.when(cond, F.when(multi, many).otherwise(one)).otherwise(0)

        total = (add(literal, 90 + F.octet_length(c["s_low"]), 20 + F.octet_length(c["s_low"]))
                 + add(spelled, 220 + F.octet_length(s_norm), 60 + F.octet_length(s_norm))
                 + add(every, 120 + F.size(s_tok) * 3, F.lit(25)) + known * 5
                 - F.when((F.size(s_tok) == 1) & (F.octet_length(s_tok[0]) <= 3), 30).otherwise(0)
                 - F.when(s_norm.isin(*GENERIC_NAMES) & ~(literal | spelled), 70).otherwise(0))
        if preferred is not None:
            total = total + F.when((c["p_norm"] != "") & (s_norm == c["p_norm"]), 50).otherwise(0)
        return total

    # Variables of their own: each text is normalised and split once, not once for every use.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    norm = [F.lower(text).alias("q_low"), F.lower(symbol).alias("s_low"), normalise_camel(text).alias("q_norm"), normalise_camel(symbol).alias("s_norm")]
    if preferred is not None:
        norm.append(F.coalesce(normalise_camel(preferred), F.lit("")).alias("p_norm"))
    names = ["q_low", "s_low", "q_norm", "s_norm", *(["p_norm"] if preferred is not None else [])]
    split = lambda c: F.struct(*[c[n].alias(n) for n in names], words(c["q_norm"]).alias("q_tok"), words(c["s_norm"]).alias("s_tok"))
    return once(F.struct(*norm), lambda c: once(split(c), score))


def best_target(candidates: DataFrame, preferred: str | None = None) -> DataFrame:
    """Best candidate per task: (task_id, text, symbol) rows -> one symbol, longer names win ties."""
    pref = F.col(preferred) if preferred else None
    scored = candidates.withColumn("score", target_score(F.col("text"), F.col("symbol"), pref))
    # No filter on the score: it would be pushed below and score every row once more.
    value = F.when(F.col("score") > 0, F.col("score"))
    if preferred:
        exact = F.lower(F.trim(preferred)) == F.lower("symbol")
        value = F.when((F.col("score") > 0) & exact, F.lit(2**30)).otherwise(value)
    order = F.when(F.col("score") > 0, F.struct((-value).alias("s"), (-F.octet_length("symbol")).alias("l"), "symbol"))
    best = scored.groupBy("task_id").agg(F.min_by("symbol", order).alias("target"), F.max(value).alias("score"))
    return best.filter("score IS NOT NULL")


def candidate_files(queries: DataFrame, footprint: DataFrame, symbols: DataFrame, n: int = 18) -> DataFrame:
    """Files that fit a query: 8 points per token in the path, 6 in the objective, 10 in a symbol."""
    tokens = queries.select("query", F.explode(words(normalise_query(F.col("query")))).alias("token")).filter("length(token) >= 2")
    tokens = tokens.groupBy("query", "token").agg(F.count("*").alias("times"))
    wanted = tokens.select("token").distinct()
    f = footprint.select("file", F.lower("file").alias("_path"), F.lower("objective").alias("_obj"))
    s = symbols.select("file", normalise_query(F.col("name")).alias("_sym"))

    def points(rows: DataFrame, column: str, value: int) -> DataFrame:
        pairs = containing_pairs(wanted, "token", rows, column)
        return pairs.join(rows.select("file", column).distinct(), column).select("token", "file").distinct().withColumn("points", F.lit(value))

    table = points(f, "_path", 8).unionByName(points(f, "_obj", 6)).unionByName(points(s, "_sym", 10))
    table = table.groupBy("token", "file").agg(F.sum("points").alias("points"))
    scores = tokens.join(table, "token").groupBy("query", "file").agg(F.sum(F.col("points") * F.col("times")).alias("score"))
    return top_n(scores, ["query"], [F.desc("score"), F.col("file")], n, "rank")


def candidate_symbols(files: DataFrame, symbols: DataFrame, n: int = 64) -> DataFrame:
    """Up to ``n`` symbols of the candidate files, in file order, unique without regard to case."""
    rows = files.select("query", F.col("rank").alias("file_rank"), "file").join(symbols.select("file", "name", "place"), "file")
    one = top_n(rows.withColumn("_l", F.lower("name")), ["query", "_l"], [F.col("file_rank"), F.col("place")], 1)
    return top_n(one, ["query"], [F.col("file_rank"), F.col("place")], n, "symbol_rank").select("query", "name", "file", "symbol_rank")


def pick_definition(wanted: DataFrame, symbols: DataFrame, candidates: DataFrame) -> DataFrame:
    """Choose among symbols of one name: candidate files first, then query tokens in the path.

    ``wanted`` is (query, target). Symbols of one name and file score alike, so only the first stays.
    """
    first = top_n(symbols.select(F.lower("name").alias("_t"), "file", "start_line", "symbol_id"), ["_t", "file"],
                  [F.col("start_line"), F.col("symbol_id")], 1)
    cand = candidates.select("query", "file").distinct().withColumn("_c", F.lit(120))
    rows = (wanted.withColumn("_t", F.lower("target")).join(first, "_t").join(cand, ["query", "file"], "left"))
    path = normalise_query(F.col("file"))
    toks, parts = words(normalise_query(F.col("query"))), words(path)
    hits = F.aggregate(F.transform(toks, lambda w: F.when(F.array_contains(parts, w), 20).when(F.contains(path, w), 8).otherwise(0)),
                       F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("score", F.coalesce("_c", F.lit(0)) + hits)
    return top_n(rows, ["query", "target"], [F.desc("score"), F.col("file"), F.col("start_line")], 1).select(
        "query", "target", "symbol_id", "file", "start_line", "score")


def context_confidence(rows: DataFrame) -> DataFrame:
    """Confidence that the chosen target fits: rows carry the text, the target and four flags."""
    q, s = normalise_query(F.col("text")), normalise_query(F.col("target"))
    parts = ((s != "") & F.contains(q, s), 0.35), (F.col("lexical_hit"), 0.2), (F.col("is_candidate"), 0.2), (F.col("has_neighbours"), 0.15), (F.col("is_preferred"), 0.1)
    total: Column = F.lit(0.0)
    for cond, value in parts:
        total = total + F.when(cond, value).otherwise(0.0)
    return rows.withColumn("confidence", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6))


def module_rank(file_module: Column, target_module: Column, scoped: Column) -> Column:
    """0 for the target's module, 1 for another module in scope, 2 for the rest."""
    return F.when(file_module == target_module, 0).when(F.array_contains(scoped, file_module), 1).otherwise(2)


# ---- typed symbols -------------------------------------------------------------------------

def query_hints(query: Column) -> Column:
    """Struct with the last segment, the module part and the crate part of a qualified name."""
    low = F.lower(F.trim(query))
    seg = F.filter(F.split(low, "::"), lambda s: s != "")
    many = F.size(seg) > 1
    return F.struct(low.alias("normalized"), F.coalesce(F.get(seg, F.size(seg) - 1), low).alias("leaf"),
                    F.when(many, F.array_join(F.slice(seg, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0))), "::")).alias("module_hint"),
                    F.when(many, F.get(seg, F.lit(0))).alias("crate_hint"))


def _lowered(typed: DataFrame) -> DataFrame:
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    return typed.select("symbol_id", low("name").alias("_n"), low("owner_name").alias("_o"), low("trait_name").alias("_t"),
                        low("module_path").alias("_m"), low("crate_name").alias("_c"))


def _key_hits(keys: DataFrame, s: DataFrame) -> DataFrame:
    """(_key, symbol_id): symbols whose name, owner or trait equals a key or whose name contains it."""
    equal = keys.select("_key").distinct().join(
        s.select("symbol_id", F.explode(F.array_distinct(F.array("_n", "_o", "_t", F.concat(F.lit("="), "_c")))).alias("_key")), "_key")
    inside = containing_pairs(keys, "_key", s, "_n").join(s.select("symbol_id", "_n"), "_n")
    return equal.select("_key", "symbol_id").unionByName(inside.select("_key", "symbol_id"))


def _direct_hits(asked: DataFrame, s: DataFrame) -> DataFrame:
    """(query, symbol_id) pairs that the whole query ``_key`` matches: by name, owner, trait, crate or module."""
    crate = asked.select("query", F.concat(F.lit("="), "_key").alias("_key")).join(
        s.select("symbol_id", F.concat(F.lit("="), "_c").alias("_key")), "_key").select("query", "symbol_id")
    module = asked.join(containing_pairs(asked, "_key", s, "_m"), "_key").join(s.select("symbol_id", "_m"), "_m").select("query", "symbol_id")
    return asked.join(_key_hits(asked, s), "_key").select("query", "symbol_id").unionByName(crate).unionByName(module)


def _inside(module: Column, crate: Column) -> Column:
    """Lies the symbol in the module or crate that the query names?"""
    hint, ch = F.col("h.module_hint"), F.col("h.crate_hint")
    return hint.isNull() | F.contains(module, hint) | (crate == ch) | F.startswith(module, ch)


def matched_symbols(queries: DataFrame, typed: DataFrame) -> DataFrame:
    """(query, symbol_id) pairs whose name, owner, trait or crate equals the query or whose name or
    module contains it, or which match the leaf of a qualified query inside its module or crate."""
    q = queries.select("query").distinct().withColumn("h", query_hints(F.col("query")))
    s = _lowered(typed)
    leaves = q.filter("h.leaf <> h.normalized").withColumn("_key", F.col("h.leaf"))
    by_leaf = leaves.join(_key_hits(leaves, s), "_key").join(s.select("symbol_id", "_m", "_c"), "symbol_id").filter(_inside(F.col("_m"), F.col("_c")))
    return _direct_hits(q.withColumn("_key", F.col("h.normalized")), s).unionByName(by_leaf.select("query", "symbol_id")).distinct()


def metadata_search(queries: DataFrame, typed: DataFrame, n: int) -> DataFrame:
    """First ``n`` matching typed symbols per query in file order."""
    place = typed.select("symbol_id", "file", "start_line", "end_line")
    return top_n(matched_symbols(queries, typed).join(place, "symbol_id"), ["query"],
                 [F.col(c) for c in ("file", "start_line", "end_line", "symbol_id")], n, "rank")


def file_evidence(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """What the file of each symbol imports."""
    e = imports.groupBy("file").agg(F.count_distinct("target_file").alias("imported_files"),
                                    F.count_distinct("local_name").alias("imported_names"), F.min("target_file").alias("first_import"))
    zero = F.lit(0).cast("bigint")
    return symbols.join(e, "file", "left").withColumns({
        "imported_files": F.coalesce("imported_files", zero), "imported_names": F.coalesce("imported_names", zero)})


# Order of symbol kinds in definitions.
KIND_ORDER = {"struct": 0, "enum": 0, "trait": 0, "implblock": 1, "method": 2, "function": 3, "module": 4}


def with_evidence(rows: DataFrame, imports: DataFrame) -> DataFrame:
    """Add ``qualified``, ``by_import``, ``own_file`` and the sorting ``key`` to (``h``, typed symbol) rows.

    Path, crate and import evidence come first, then name, ownership, kind and place.
    """
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    name, owner, trait, module, crate = (low(c) for c in ("name", "owner_name", "trait_name", "module_path", "crate_name"))
    hint, norm, leaf = F.col("h.module_hint"), F.col("h.normalized"), F.col("h.leaf")
    evid = imports.select("file", F.lower("local_name").alias("_leaf")).distinct().withColumn("_hit", F.lit(True))
    by_leaf = evid.withColumnRenamed("_hit", "_by_leaf")
    by_trait = evid.select("file", F.col("_leaf").alias("_trait"), F.col("_hit").alias("_by_trait"))
    own = imports.filter(F.col("file") == F.col("target_file")).select("file").distinct().withColumn("_own", F.lit(True))
    rows = (rows.withColumns({"_leaf": leaf, "_trait": trait}).join(by_leaf, ["file", "_leaf"], "left")
            .join(by_trait, ["file", "_trait"], "left").join(own, "file", "left"))
    qualified = (F.when(hint.isNull(), 1).when((module == hint) | F.endswith(module, F.concat(F.lit("::"), hint)) | (name == norm), 0)
                 .when(F.contains(module, hint) | F.contains(name, hint), 1).otherwise(2))
    crate_bias = F.when(crate == F.col("h.crate_hint"), 0).otherwise(1)
    import_bias = F.when(F.coalesce("_by_leaf", "_by_trait", F.lit(False)), 0).otherwise(2)
    resolved_bias = F.when(F.coalesce("_own", F.lit(False)), 0).otherwise(2)
    exact = F.when(name == norm, 0).otherwise(1)
    ownership = F.when((owner == norm) | (trait == norm), 0).when(F.contains(name, norm), 1).otherwise(2)
    kinds = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])
    kind = F.coalesce(kinds[kind_of("kind")], F.lit(5))
    type_bias = F.when(F.col("type") == "class", 0).when(F.col("type") == "function", 1).otherwise(2)
    key = F.struct(qualified.alias("a"), crate_bias.alias("b"), import_bias.alias("c"), resolved_bias.alias("d"), exact.alias("e"),
                   ownership.alias("f"), kind.alias("g"), type_bias.alias("h"), F.coalesce("crate_name", F.lit("")).alias("i"),
                   F.col("file").alias("j"), F.col("start_line").alias("k"))
    return rows.withColumns({"qualified": qualified, "by_import": import_bias == 0, "own_file": resolved_bias == 0, "key": key}).drop(
        "_leaf", "_trait", "_by_leaf", "_by_trait", "_own")


def kind_of(kind: str) -> Column:
    """Kind of a symbol in one spelling: ``impl_block``, ``ImplBlock`` and ``implblock`` are the same."""
    return F.lower(F.replace(kind, F.lit("_"), F.lit("")))


def _leaf_candidates(q: DataFrame, typed: DataFrame, imports: DataFrame, n: int) -> DataFrame:
    """(query, symbol_id) pairs of qualified queries through their leaf; holds every one that can be among the first ``n``.

    What a query adds to the order of its leaf's symbols depends on their module and crate alone, but for names, owners
    and traits with a path in them and names that hold a module hint. So symbols of a leaf fall into classes of one module
    and crate, each such name a class of its own, and a class keeps its first ``n`` places in the order that is left
    (import evidence, kind, type, place). A query meets the classes it is related to; the rest rank last and alike, and
    of them the first ``n`` of its leaf and crate prefix do. So no query meets every symbol of its leaf.
    """
    asked = q.filter("h.leaf <> h.normalized").withColumns({"_key": F.col("h.leaf"), "_p": F.coalesce("h.crate_hint", F.lit(""))})
    s = _lowered(typed)
    plain = asked.select(F.col("h.module_hint").alias("_hint")).filter("_hint IS NOT NULL AND NOT contains(_hint, '::')").distinct()
    holding = containing_pairs(plain, "_hint", s, "_n").select("_n").distinct().withColumn("_holds", F.lit(True))
    path = lambda c: F.when(F.contains(F.col(c), F.lit("::")), F.col(c))
    special = F.struct(F.coalesce(F.when(F.col("_holds"), F.col("_n")), path("_n")).alias("n"), path("_o").alias("o"), path("_t").alias("t"))
    facts = s.join(holding, "_n", "left").select("symbol_id", "_m", "_c", special.alias("_s"))
    # Without hints a row's key is the last that any query can give it.
    none = F.lit(None).cast("string")
    hint = F.struct(none.alias("normalized"), F.col("_key").alias("leaf"), none.alias("module_hint"), none.alias("crate_hint"))
    rows = _key_hits(asked, s).distinct().join(typed, "symbol_id").withColumn("h", hint)
    rows = with_evidence(rows, imports).join(facts, "symbol_id").select("_key", "_m", "_c", "_s", "crate_name", "name", "file", "start_line", "key", "symbol_id")
    order, place = [F.col("key"), F.col("symbol_id")], ["name", "file", "start_line"]
    kind = ["_key", "_m", "_c", "_s", "crate_name"]
    classes = cut_lineage(top_n(top_n(rows, [*kind, *place], order, 1), kind, order, n))

    related = F.col("_s.n").isNotNull() | F.col("_s.o").isNotNull() | F.col("_s.t").isNotNull()
    related = related | F.contains("_m", F.col("h.module_hint")) | (F.col("_c") == F.col("h.crate_hint"))
    near = asked.join(classes.select("_key", "_m", "_c", "_s", "symbol_id"), "_key").filter(related & _inside(F.col("_m"), F.col("_c")))
    prefixed = asked.select("_key", "_p").distinct().join(classes, "_key").filter(F.startswith("_m", F.col("_p")))
    last = top_n(top_n(prefixed, ["_key", "_p", *place], order, 1), ["_key", "_p"], order, n)
    far = asked.join(last.select("_key", "_p", "symbol_id"), ["_key", "_p"])
    return near.select("query", "symbol_id").unionByName(far.select("query", "symbol_id"))


def ranked_symbols(queries: DataFrame, typed: DataFrame, imports: DataFrame, n: int) -> DataFrame:
    """First ``n`` matches by evidence (``with_evidence``); equal (name, file, start) rows count once."""
    q = cut_lineage(queries.select("query").distinct().withColumn("h", query_hints(F.col("query"))))
    # Of the imports only names that a query or a trait asks for matter, and files that import from themselves.
    words = q.select(F.col("h.leaf").alias("_w")).union(typed.select(F.lower(F.coalesce("trait_name", F.lit(""))))).distinct().withColumn("_asked", F.lit(True))
    local = imports.select("file", F.lower("local_name").alias("local_name"), "target_file")
    imports = cut_lineage(local.join(words, F.col("local_name") == F.col("_w"), "left").filter("_asked OR file = target_file")
                          .select("file", "local_name", "target_file").distinct())
    direct = _direct_hits(q.withColumn("_key", F.col("h.normalized")), _lowered(typed))
    pairs = direct.unionByName(_leaf_candidates(q, typed, imports, n)).distinct()
    rows = with_evidence(pairs.join(q, "query").join(typed, "symbol_id"), imports)
    one = top_n(rows, ["query", "name", "file", "start_line"], [F.col("key"), F.col("symbol_id")], 1)
    return top_n(one, ["query"], [F.col("key"), F.col("symbol_id")], n, "rank")


# Kinds that define a name; items per group up to so many tokens, and beyond; how much of an item is shown.
DEFINING = ("struct", "enum", "trait", "function")
CONTEXT_ITEMS = ((250, 3), (500, 6), (900, 10), (None, 14))
CONTEXT_DETAIL = ((280, "signature_first"), (600, "bounded_span"), (None, "expanded_span"))


def _by_tokens(table: Sequence[tuple], max_tokens: int):
    return next(value for limit, value in table if limit is None or max_tokens <= limit)


def module_of(file: str) -> Column:
    """Module path that a source file stands for by its place alone; crate and module roots stand for their folder."""
    path = F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"(\.rs)+(/.*)?$", ".rs")
    path = F.regexp_replace(F.regexp_replace(path, r"(^|/)(lib|main|mod)\.rs$", ""), r"\.rs$", "")
    return F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "::")


def type_context(queries: DataFrame, typed: DataFrame, imports: DataFrame, max_tokens: int) -> DataFrame:
    """Definitions, implementation blocks, methods and modules of a type, one row per item.

    Definitions carry the query's last segment as their name and lie in its module and crate. The crate of the best of
    them is preferred: only its symbols take part; without a definition all do. Implementation blocks belong to the name
    as their owner or trait; methods belong to it or to the owner of one of the blocks shown, or their name contains it.
    Both are ordered by evidence; under a qualified query those that its path or an import of their file supports push
    out the others, unless there are none. Modules are those of all items shown. Names compare without regard to case.
    ``max_tokens`` sets the number of items per group and their detail.
    """
    n = _by_tokens(CONTEXT_ITEMS, max_tokens)
    h = cut_lineage(queries.select("query").filter("query IS NOT NULL").distinct().withColumn("h", query_hints(F.col("query"))).withColumn("_leaf", F.col("h.leaf")))
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    hint, crate_hint = F.col("h.module_hint"), F.col("h.crate_hint")
    best = [F.col("key"), F.col("symbol_id")]
    place = ["query", "name", "file", "start_line"]

    names = typed.filter(kind_of("kind").isin(*DEFINING)).withColumn("_leaf", F.lower("name"))
    inside = (hint.isNull() | F.contains(low("module_path"), hint)) & (
        crate_hint.isNull() | (low("crate_name") == "") | (low("crate_name") == crate_hint) | F.startswith(low("module_path"), crate_hint))
    found = with_evidence(h.join(names, "_leaf").filter(inside), imports)
    found = cut_lineage(top_n(found, place, best, 1))
    anchor = first_per_key(found, ["query"], best).select("query", F.col("crate_name").alias("preferred_crate"))
    asked = cut_lineage(h.join(anchor, "query", "left"))
    preferred = F.col("preferred_crate").isNull() | F.col("crate_name").eqNullSafe(F.col("preferred_crate"))
    defined = top_n(found.join(anchor, "query").filter(preferred), ["query"], best, n, "rank")

    def supported(pairs: DataFrame, members: DataFrame) -> DataFrame:
        """First ``n`` of (query, symbol_id) pairs: none without support if any has it."""
        rows = asked.join(pairs.distinct(), "query").join(members, "symbol_id").filter(preferred)
        rows = top_n(with_evidence(rows, imports), place, best, 1)
        rows = rows.withColumn("_ok", hint.isNull() | (F.col("qualified") == 0) | F.col("by_import") | F.col("own_file"))
        rows = top_n(rows, ["query"], [F.desc("_ok"), *best], n, "rank")
        return rows.withColumn("_any", F.max("_ok").over(W.partitionBy("query"))).filter("_ok OR NOT _any")

    def related(members: DataFrame, *columns: str) -> DataFrame:
        keyed = members.select("symbol_id", F.explode(F.array_distinct(F.array_compact(F.array(*[F.lower(c) for c in columns])))).alias("_leaf"))
        return asked.select("query", "_leaf").join(keyed, "_leaf").select("query", "symbol_id")

    blocks = typed.filter(kind_of("kind") == "implblock")
    shown = cut_lineage(supported(related(blocks, "owner_name", "trait_name"), blocks))
    methods = typed.filter(kind_of("kind") == "method").withColumn("_n", F.lower("name"))
    owners = shown.select("query", F.lower("owner_name").alias("_o")).filter("_o IS NOT NULL").distinct()
    owned = owners.join(methods.select("symbol_id", F.lower("owner_name").alias("_o")), "_o").select("query", "symbol_id")
    named = containing_pairs(asked, "_leaf", methods, "_n")
    named = asked.select("query", "_leaf").join(named, "_leaf").join(methods.select("symbol_id", "_n"), "_n").select("query", "symbol_id")
    pairs = related(methods, "owner_name", "trait_name").unionByName(owned).unionByName(named)
    members = supported(pairs, methods.drop("_n"))

    cols = ["query", "rank", "symbol_id", "name", "file", "module_path", "preferred_crate"]
    items = defined.select(*cols).withColumn("group", F.lit("definition"))
    items = items.unionByName(shown.select(*cols).withColumn("group", F.lit("impl_block"))).unionByName(members.select(*cols).withColumn("group", F.lit("method")))
    items = cut_lineage(items)
    modules = items.select("query", "preferred_crate", F.coalesce("module_path", module_of("file")).alias("name")).filter("name != ''").distinct()
    modules = modules.withColumns({"rank": F.row_number().over(W.partitionBy("query").orderBy("name")), "group": F.lit("module"),
                                   "symbol_id": F.lit(None).cast(typed.schema["symbol_id"].dataType), "file": F.lit(None).cast("string")})
    return items.drop("module_path").unionByName(modules).withColumn("detail", F.lit(_by_tokens(CONTEXT_DETAIL, max_tokens)))


def symbol_bundle(seeds: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """A symbol with its neighbours and its logic nodes, one row per item."""
    hits = near.join(seeds.select("seed", F.col("node").alias("symbol_id")), "seed").filter("depth > 0")
    a = hits.select("symbol_id", F.lit("neighbour").alias("kind"), F.col("node").cast("string").alias("item"))
    b = nodes.join(seeds.select(F.col("node").alias("symbol_id")), "symbol_id", "left_semi").select(
        "symbol_id", F.lit("logic_node").alias("kind"), F.col("pos").cast("string").alias("item"))
    return a.unionByName(b).distinct()
