"""The toxicity classifier fits on every labelled row outside the held-out fold."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import toxic_cnn


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_every_labelled_row_counts_and_fits(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    data = [(i, " ".join(rng.choices(words, k=12) + (["zzgrim"] if i % 4 == 0 else [])), rng.choice(["en", None])) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    used = []
    seen = toxic_cnn._seen
    monkeypatch.setattr(toxic_cnn, "_seen", lambda rows: used.append(sorted(r.doc_id for r in rows.select("doc_id").collect())) or seen(rows))
    model, thresholds = toxic_cnn.train(docs, labels, rows=100)
    assert used == [[i for i in range(600) if fold(i) > 1]]
    scorer = toxic_cnn.Scorer(model)
    assert sum((scorer(t) >= 0.5) == (i % 4 == 0) for i, t, _ in data if fold(i) == 0) > 0.95 * sum(fold(i) == 0 for i in range(600))
    rows = [(scorer(t), int(i % 4 == 0), g) for i, t, g in data if fold(i) == 1]
    assert thresholds == pytest.approx(toxic_cnn.language_thresholds(*map(list, zip(*rows))))


def test_long_texts_fit_and_thresholds_see_every_score(spark):
    docs = spark.createDataFrame([(i, ("grim " if i % 2 else "fine ") * (4000 if i < 20 else 3), "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model, _ = toxic_cnn.train(docs.filter("doc_id < 20"), labels.filter("doc_id < 20"), chars=6400)
    assert model.constant is None
    scored = spark.createDataFrame([(0.1 + i % 7 / 10, int(i % 7 > 3), g) for i in range(70) for g in ("en", None)] + [(0.3, 1, "fr")], "score double, toxic int, lang string")
    rows = scored.collect()
    want = toxic_cnn.language_thresholds([r.score for r in rows], [r.toxic for r in rows], [r.lang for r in rows])
    assert toxic_cnn.best_thresholds(scored) == pytest.approx(want) and set(want) == {"en", None}
    assert toxic_cnn.best_thresholds(scored.filter(F.lit(False))) == {}


def test_only_texts_that_may_be_labelled_move(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 590, ("grim " if i % 2 else "fine ") * 3, "en") for i in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 590, 3)], "doc_id long, toxic int")
    plans, stored = {}, toxic_cnn.stored
    monkeypatch.setattr(toxic_cnn, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or stored(df, name))
    model, thresholds = toxic_cnn.train(docs, labels)
    # The join of texts does not turn from a broadcast into a shuffle as labels grow, and only possible keys reach it.
    assert "SortMergeJoin" in plans["labelled"] and "bitmap_construct_agg" in plans["labelled"]
    # Scores, not texts, meet the labels that set thresholds.
    assert 0 <= plans["calibration"].find("Join") < plans["calibration"].find("MapInArrow")
    scorer = toxic_cnn.Scorer(model)
    rows = [(scorer(r.text), r.toxic, r.lang) for r in docs.join(labels, "doc_id").collect() if fold(r.doc_id) == 1]
    assert thresholds == pytest.approx(toxic_cnn.language_thresholds(*map(list, zip(*rows))))
