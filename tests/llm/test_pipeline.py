"""Each stage against a brute-force version on its own input."""

import os

import pytest

import corpus_pipeline as P
from corpusloom.llm import quality_classifier, queries
from tests.llm.test_dedup import SPACE, brute
from tests.llm.test_text_rules import base

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        steps.append((name, docs.toPandas(), spark.read.parquet(f"{tmp_path}/{k}").toPandas()))
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = steps
    model = quality_classifier.fit(spark.read.parquet(f"{DATA}/documents.parquet"), queries.table(spark, DATA, "labels"), queries.fold() % 3 != 1)
    good = {r.doc_id for r in quality_classifier.score(spark.read.parquet(f"{DATA}/documents.parquet"), model).where("predicted = 1").collect()}
    assert set(b.doc_id) == good and 0 < len(b) < len(a)
    short = b[b.n_chars < 3000]
    ruled = {i for i, t in zip(short.doc_id, short.text) for x in [base(t)] if x[0] >= 20 and 100 * x[4] <= 30 * x[0] and x[5] <= 0.25 * x[0] and x[6] <= max(64, 0.1 * x[0])}
    assert set(c.doc_id) & set(short.doc_id) == ruled
    best = {}
    for i, t in zip(c.doc_id, c.text):
        key = SPACE.sub("", t)
        best[key] = max(best.get(key, (-1, 0)), (len(t), -i))
    assert set(d.doc_id) == {-i for _, i in best.values()}
    rows = d.sort_values("doc_id").reset_index(drop=True)
    assert set(e.doc_id) == {rows.doc_id[root] for _, root in brute(list(rows.text), 5)}
    assert set(f.doc_id) == set(e.doc_id) and f.groupby("doc_id").length.sum().equals(f.groupby("doc_id").doc_tokens.first())


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names, an empty table."""
    good = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) BETWEEN 500 AND 900").orderBy("doc_id").limit(12).toPandas()
    fine = [r for r in good.itertuples(index=False) if base(r.text)[4] == 0]
    a, b, c = fine[0].text, fine[1].text, fine[2].text
    longest = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, a), (1, a), (1, b), (2, " ".join(a.split())), (None, b), (None, c), (None, c + " "), (7, None), (8, ""), (9, longest), (10, longest + " more"), (None, None)]
    docs = spark.createDataFrame([(*x, True, 1, "n", b"s", 0.1) for x in rows], "doc_id long, text string, kept boolean, _kept int, component_id string, sketch binary, score double")
    stages = dict(P.STAGES)
    assert stages["quality classifier"](spark, docs, DATA).columns == docs.columns
    ruled = stages["quality rules"](spark, docs, DATA)
    assert sorted((r.doc_id or 0, len(r.text)) for r in ruled.collect()) == sorted((i or 0, len(t)) for i, t in rows if t)
    exact = stages["exact dedup"](spark, ruled, DATA)
    assert exact.columns == docs.columns
    got = sorted((r.doc_id or 0, len(r.text)) for r in exact.collect())
    assert got == sorted([(1, len(a)), (1, len(b)), (0, len(c) + 1), (9, len(longest)), (10, len(longest) + 5)])
    near = stages["minhash near-dedup"](spark, exact, DATA)
    assert near.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text)) for r in near.collect()) == sorted([(1, len(a)), (1, len(b)), (0, len(c) + 1), (9, len(longest))])
    pieces = stages["packing"](spark, near, DATA).toPandas()
    assert pieces.length.sum() == pieces[pieces.start == 0].doc_tokens.sum() and (pieces.start == 0).sum() == 4
    empty = docs.where("false")
    for name, stage in P.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
