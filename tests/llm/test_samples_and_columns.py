"""Bounded samples of the toxicity classifier and clashing columns of the piece codec."""

from collections import Counter

from pyspark.sql import functions as F

from graphloom.llm import piece_codec, toxic_cnn


def docs_of(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def labels_of(spark, n):
    return spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


def sampled(spark, data, n, sample, chars=1 << 26):
    rows = toxic_cnn._sampled(docs_of(spark, data), labels_of(spark, n), "doc_id", sample, chars)
    return Counter((r["doc_id"], r["text"], r["lang"], r["toxic"]) for r in rows)


def test_small_tables_are_sampled_whole(spark):
    data = [(i, f"text {i}", "en") for i in range(30)] + [(3, "text 3", "en"), (3, "other", "fr"), (4, None, None), (4, None, None), (5, "", "en")]
    want = Counter((i, t, g, i % 2) for i, t, g in data)
    assert sampled(spark, data, 30, 200) == want


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    data = [(1, f"copy {i % 40}", "en") for i in range(2000)] + [(i, "x", "en") for i in range(2, 40)]
    got = sampled(spark, data, 40, 20)
    assert 0 < sum(got.values()) <= 20


def test_characters_bound_the_sample(spark):
    data = [(i, "ab" * 50, "en") for i in range(40)] + [(40, "z" * 5000, "en")]
    got = sampled(spark, data, 41, 100, chars=6400)
    assert sum(len(t) * n for (_, t, _, _), n in got.items()) <= 6400 and sum(got.values()) == 40
    assert all(len(t) <= 100 for _, t, _, _ in got)
    assert sum(sampled(spark, data, 41, 100, chars=6400 * 2).values()) == 40
    assert not sampled(spark, [], 41, 100)


def test_the_same_rows_each_time(spark):
    data = [(i % 50, f"t{i}", "en") for i in range(300)]
    one = sampled(spark, data, 50, 40)
    assert one == sampled(spark, list(reversed(data)), 50, 40) and sum(one.values()) == 40


def test_own_columns_of_new_names_stay(spark):
    rows = [(1, "a b", "mine", 7, True, "x"), (1, "a b", "mine", 7, True, "x"), (None, None, None, None, None, None), (2, "", "y", 1, False, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, N_Tokens int, round_trip boolean, own_ids string")
    coded = piece_codec.encode(docs)
    assert coded.columns == ["doc_id", "own_own_ids", "own_N_Tokens", "own_round_trip", "own_ids", "ids", "n_tokens", "round_trip"]
    back = piece_codec.decode(coded).select("doc_id", F.col("text"), "own_own_ids", "own_N_Tokens", "own_round_trip", "own_ids").collect()
    assert Counter(map(tuple, back)) == Counter((r[0], r[1] or "", *r[2:]) for r in rows)
    assert coded.filter("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    assert piece_codec.encode(docs.limit(0)).columns == coded.columns
