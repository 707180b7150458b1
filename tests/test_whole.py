"""Queries of the registry do the whole job: every character, every row."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import embedding, lexical, retrieval
from corpusloom.plans import registry


def _as_sql(spark, name, path, *tables):
    """Rows of a query over Parquet folders, sorted, once they are those of its SQL."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, str(path))
    columns = ", ".join(found.columns)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(db.execute(f"SELECT {columns} FROM ({registry.SQL[name]})").fetchall(), key=repr)
    return got


def test_chunks_are_embedded_whole(spark, tmp_path):
    texts = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((1, 20, 55, 60, 400))] + ["é☃ " * 500, "", None]
    spark.createDataFrame([(i, t, "fr", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.chunk_id: r for r in registry.u2_embed(spark, str(tmp_path)).collect()}
    client = embedding.hashing_client(32)()
    want = {}
    for i, t in enumerate(texts):
        for k, at in enumerate(range(0, len(t or ""), 320)):
            if at == 0 or at + 64 < len(t):
                want[f"DOC_{i}_{k:04d}"] = client([t[at : at + 384]])[0][1]
    assert got.keys() == want.keys() and len(want) > 10
    assert not any(r.truncated for r in got.values())
    for name, vector in want.items():
        assert np.allclose(got[name].embedding, vector, atol=1e-6), name


def test_version_chain_of_one_hot_customer(spark, tmp_path):
    n = 30_000
    spark.range(n).selectExpr("id AS o_orderkey", "if(id % 3 = 0, id, 7) AS o_custkey", "date_add(date'2000-01-01', cast(id * 7919 % 5000 AS int)) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    frame = registry.l7_version_chain(spark, str(tmp_path))
    assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = [(int(r.src[8:]), int(r.dst[8:])) for r in frame.collect()]
    order = sorted((i for i in range(n) if i % 3 or i == 7), key=lambda i: (i * 7919 % 5000, i))
    assert sorted(got) == sorted([*zip(order, order[1:], strict=False)] * 2)


def test_passages_of_short_texts(spark, tmp_path):
    """A labelled text of three characters, an empty one, a null one, a label without a text and one without a number."""
    texts = ["De.", "", None, "abcd", "abcdef é", "xyz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (9,), (None,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    got = _as_sql(spark, "r8_passages", tmp_path, "documents", "labels")
    assert len(got) == 5 and (0, "Doc 0", "e.", 1, 4) in got
    spans, docs = registry._found(spark, str(tmp_path))
    for strict in (spans.where("rank = 0"), spans.where("rank = 9")):
        with pytest.raises(Exception, match="contract violation"):
            retrieval.passages(strict, docs).collect()
    with pytest.raises(Exception, match="contract violation"):
        retrieval.passages(spans.where("rank = 3").selectExpr("rank", "identifier", "3 AS char_start", "3 AS char_end"), docs, strict=False).collect()


def test_nested_hits_of_many_questions_are_bounded(spark, monkeypatch):
    """A batch of 400 documents meets 2,000 questions: a question gets its best documents alone, and products are held in parts."""
    import tracemalloc

    r = np.random.default_rng(5)
    vectors = r.integers(-2, 3, (2000, 4)).astype(float)
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("chunk_id", pa.string()), ("embedding", pa.list_(pa.float32()))]))
    passages = [[{"ordinal": n, "chunk_id": f"{d}_{n}", "embedding": vectors[5 * d + n].tolist()} for n in range(5)] for d in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{d}" for d in range(400)]), pa.array(passages, kind)], ["identifier", "passages"])
    index = spark.createDataFrame([], "identifier string, passages array<struct<ordinal int, chunk_id string, embedding array<float>>>")
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(vectors)], "query_id int, vector array<double>")
    caught = []
    monkeypatch.setattr(type(index), "mapInArrow", lambda frame, search, schema: caught.append(search) or spark.createDataFrame([], schema))
    retrieval.nested_hits(index, queries, 10)
    tracemalloc.start()
    found, most = 0, 0
    for out in caught[0](iter([batch, batch])):
        found += out.num_rows
        most = max(most, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 20_000 <= found <= 40_000 and most <= 10_000 and peak < 200 << 20


@pytest.mark.parametrize("cells", [16, 1 << 20])
def test_questions_to_a_table_and_to_an_index(spark, monkeypatch, cells):
    """search() gives what top_k() gives over an index: ties, repeated words, references, texts without a term, questions without one."""
    import random

    r = random.Random(8)
    words = ["alpha", "beta", "gammas", "Delta", "l'omega", "œuvre", "les", "L. 12-3", "12-34.567", "chevaux"]
    texts = [(k, " ".join(r.choices(words, weights=[40, 20, 10, 5, 3, 2, 9, 1, 1, 1], k=r.randint(0, 20)))) for k in range(150)] + [(200 + k, "omega delta alpha") for k in range(6)] + [(300, None), (301, "")]
    asked = [(1, "delta omega"), (2, "alpha alpha l12-3"), (3, "unknown"), (4, "cheval beta 12-34.567"), (5, ""), (6, "les oeuvres"), (7, None)]
    passages, questions = spark.createDataFrame(texts, "chunk_id int, text string").repartition(3), spark.createDataFrame(asked, "query_id int, text string")
    want = sorted(tuple(x) for x in lexical.top_k(lexical.build_index(passages), questions, 4).select("query_id", "rank", "chunk_id", "score").collect())
    monkeypatch.setattr(lexical, "SCORE_CELLS", cells)
    got = sorted(tuple(x) for x in lexical.search(passages, questions, 4).select("query_id", "rank", "chunk_id", "score").collect())
    assert got == want and {x[0] for x in got} == {1, 2, 4, 6}
    assert lexical.search(passages, questions.where("query_id = 5"), 4).collect() == []


def test_lexical_queries_join_no_postings(spark, tmp_path):
    """As in the SQL with repeated and missing numbers and null texts; questions and passages don't meet in a join, whose rows grow with both."""
    texts = [(k, f"word{k % 3} word{k % 7} common Common tale{k % 11}s") for k in range(60)] + [(5, "word1 again"), (5, "word1 common"), (None, "word1 word2"), (70, None), (71, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "word1 tales common"), (1, "word2 word2 again"), (2, "nothing"), (200, "tale3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = np.random.default_rng(4).normal(size=(130, 8)).tolist()
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(_as_sql(spark, "d3_lexical_top_k", tmp_path, "documents", "benchmark")) == 26
    _as_sql(spark, "d5_hybrid", tmp_path, "documents", "benchmark", "embeddings")
    assert "Join" not in registry.d3_lexical_top_k(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
