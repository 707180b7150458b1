"""Held-out accuracy of both classifiers, and odd inputs."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality_classifier, queries, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")


@needs_data
@pytest.mark.parametrize(("query", "label", "least"), [(queries.op1_quality_classifier, "quality", 0.93), (queries.op5_toxicity, "toxic", 0.9)])
def test_held_out(spark, query, label, least):
    scored = query(spark, DATA)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert scored.where("score < 0 OR score > 1 OR predicted <> cast(score >= 0.5 AS int)").count() == 0
    labels = queries.table(spark, DATA, "labels")
    right = scored.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


ODD = [None, "", " ", "a", "x" * 100_000, "same", "same", "||| !!!", "É" * 9]


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
@pytest.mark.parametrize("ys", [[], [None, 1, 1], [0, 1, 0, 1, None, 1, 0, 1, 0]])
def test_odd_inputs(spark, module, ys):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)], "doc_id long, text string, score double")
    labels = spark.createDataFrame(list(enumerate(ys)), "doc_id long, y int").select("doc_id", F.col("y").alias("quality"), F.col("y").alias("toxic"))
    model = module.fit(docs, labels, F.lit(True))
    got = module.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert got[5].score == got[6].score
    assert module.score(docs.where("false"), model).count() == 0


def test_rules_compile_to_what_they_say(spark):
    model = quality_classifier.RuleModel([(("words", True, 2.0), ("pipes", False, 0.1)), (("capitals", True, 0.5),)], [2.0, -1.0], 0.25)
    docs = spark.createDataFrame([(0, "a b c"), (1, "a | b c"), (2, "ABC"), (3, "A B C")], "doc_id long, text string")
    want = {0: 2.25, 1: 0.25, 2: -0.75, 3: 1.25 + 0.0}
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    import math

    assert all(abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9 for i, z in want.items())


def test_features_of_a_batch_are_those_of_each_text():
    texts = ["An Idiot", None, "", "idiot and clown", "x" * 50]
    import numpy as np

    weight = np.random.RandomState(0).normal(size=1 << toxicity.BITS).astype(np.float32)
    model = toxicity.Model(weight, 0.1)
    z = model.scores(texts)
    for t, s in zip(texts, z, strict=True):
        assert abs(1 / (1 + np.exp(-(0.1 + weight[toxicity.features(t)].sum()))) - s) < 1e-6


@pytest.mark.parametrize(("module", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_repeated_labels_and_documents(spark, module, label):
    """A doc_id is learnt once, however often its label or its document is there: the highest label, the longest text."""
    texts = [("bad words here " if i % 2 else "a fine text ") * (3 + i) + ("| " * 9 if i % 2 else "") for i in range(40)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], f"doc_id long, {label} int, fold int")
    again = docs.unionByName(docs.selectExpr("doc_id", "'' AS text", "y")).unionByName(docs).unionByName(docs.selectExpr("cast(NULL AS long) AS doc_id", "text", "y"))
    more = labels.unionByName(labels.selectExpr("doc_id", f"0 AS {label}", "fold")).unionByName(labels.selectExpr("doc_id", f"cast(NULL AS int) AS {label}", "fold"))
    a, b = module.fit(docs, labels, F.lit(True)), module.fit(again, more, F.lit(True))
    score = {r.doc_id: (r.score, r.predicted) for r in module.score(docs, a).collect()}
    assert score == {r.doc_id: (r.score, r.predicted) for r in module.score(docs, b).collect()}
    assert all(p == i % 2 for i, (_, p) in score.items())


def test_folds_leave_their_rows_out(spark):
    """Labels that no text tells: the figures of the rows left out must not look good, and few are called toxic."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choices("abcdefgh ", k=300)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 120"), labels, F.lit(True))
    assert model.report["area"] < 0.75
    assert toxicity.score(docs.where("doc_id >= 120"), model).where("predicted = 1").count() <= 8


def test_area_and_calibration():
    import numpy as np

    y = np.asarray([0, 0, 1, 1, 0, 1])
    z = np.asarray([0.1, 0.4, 0.4, 0.8, 0.2, 0.9])
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in z[y == 1] for b in z[y == 0]]
    assert abs(toxicity.area(z, y) - sum(pairs) / len(pairs)) < 1e-12
    r = np.random.RandomState(1)
    z = r.normal(size=4000) * 3
    y = (r.random_sample(4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    slope, offset = toxicity.calibrated(z, y)
    assert abs(slope - 0.5) < 0.08 and abs(offset + 1) < 0.15
