import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import embedding, retrieval, sinks, stats
from corpusloom.plans import ingest
from corpusloom.streaming import incremental
from tests.test_parsing import A, ARTICLE, B, TEXT


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize(spark):
    raw = "été   x<b>y</b>z​­w\n\n\n\n  a  \t b \n"
    assert one(spark, T.normalize_text(F.lit(raw))) == "été x y zw\n\na b"
    assert one(spark, T.normalize_text(F.lit(None).cast("string"))) == ""


def test_utf16(spark):
    r = one(spark, T.utf16_range(F.lit("\U0001f600abc"), F.lit(1), F.lit(3)))
    assert (r.start, r.end) == (2, 4)
    for a, b in ((0, 9), (2, 2), (3, 1), (-1, 2)):
        assert one(spark, T.utf16_range(F.lit("\U0001f600abc"), F.lit(a), F.lit(b))) is None


def test_identifiers(spark):
    import hashlib

    assert one(spark, T.point_id(F.lit("x_0001"))) == int(hashlib.sha256(b"x_0001").hexdigest(), 16) % 2**63
    assert one(spark, T.chunk_id(F.lit("x"), F.lit(10000))) == "x_10000"


def test_verbs_against_a_regular_expression(spark):
    import random
    import re

    r = random.Random(11)
    words = ["".join(r.choice("aZ9_ é-\t") for _ in range(r.randint(0, 6))) for _ in range(400)]
    got = {x.w: x.v for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.verb_of(F.col("w")).alias("v")).collect()}
    fine = {w: w.strip().lower() if re.fullmatch("[a-z][a-z0-9_]*", w.strip().lower()) else None for w in words}
    assert got == fine and 10 < sum(v is not None for v in fine.values()) < 390


def test_top_k_ties_and_zero_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0, 1.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    got = [(r.rank, r.chunk_id) for r in retrieval.top_k(rows, q, 3, 0.5).orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "d")]
    assert retrieval.top_k(rows.where("false"), q).count() == 0


@pytest.mark.parametrize("batch", ["3", "2000"])
def test_top_k_against_brute_force(spark, batch):
    """Many equal vectors, ties over keys, zero and null vectors, any least score, in small batches and one; the scan is one."""
    import random

    r = random.Random(7)
    pool = [[float(r.randint(-2, 2)) for _ in range(4)] for _ in range(25)] + [[0.0] * 4]
    rows = [(f"c{k}", r.choice(pool[:3] if k % 3 else pool), k) for k in range(300)] + [("null", None, 0)]
    asked = [(q, r.choice(pool)) for q in range(40)]

    def cosine(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, extra int").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    for k, least in ((1, 0.5), (7, -1.0), (400, 0.3)):
        found = retrieval.top_k(chunks, queries, k, least)
        got = sorted((x.query_id, x["rank"], x.chunk_id) for x in found.collect())
        expected = []
        for q, v in asked:
            best = sorted(((-cosine(e or [0.0] * 4, v), c) for c, e, _ in rows if cosine(e or [0.0] * 4, v) >= least))[:k]
            expected += [(q, n + 1, c) for n, (_, c) in enumerate(best)]
        assert got == sorted(expected)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


@pytest.mark.parametrize("batch", ["2", "2000"])
def test_nested_hits_against_brute_force(spark, batch):
    """Equal vectors, ties, documents without passages, null vectors."""
    import random

    r = random.Random(9)
    pool = [[float(r.randint(-2, 2)) for _ in range(3)] for _ in range(9)] + [[0.0] * 3]
    held = {f"d{k}": [r.choice([*pool, None]) for _ in range(r.randint(0, 5))] for k in range(40)}
    asked = [(q, r.choice(pool)) for q in range(12)]

    def cosine(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    documents = spark.createDataFrame([(d, d.upper()) for d in held], "identifier string, title string")
    chunks = spark.createDataFrame([(d, n, f"{d}_{n}", v) for d, vs in held.items() for n, v in enumerate(vs)], "parent_identifier string, ordinal int, chunk_id string, embedding array<float>")
    index = retrieval.nested_index(documents, chunks)
    assert index.count() == 40
    for k, least in ((4, -1.0), (50, 0.1)):
        found = retrieval.nested_hits(index, spark.createDataFrame(asked, "query_id int, vector array<float>"), k, 2, least)
        assert found.columns == ["identifier", "title", "query_id", "score", "hits", "rank"]
        got = sorted((x.query_id, x["rank"], x.identifier, [h.chunk_id for h in x.hits]) for x in found.collect())
        expected = []
        for q, v in asked:
            scored = {d: sorted((-cosine(p or [0.0] * 3, v), f"{d}_{n}") for n, p in enumerate(vs)) for d, vs in held.items() if vs}
            best = sorted((s[0][0], d) for d, s in scored.items() if -s[0][0] >= least)[:k]
            expected += [(q, n + 1, d, [c for _, c in scored[d][:2]]) for n, (_, d) in enumerate(best)]
        assert got == sorted(expected)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_lexical_terms(spark):
    from corpusloom.operators import lexical

    text = "L'article L. 1234-5 du code du travail, les chevaux; Lois et travaux: pourvoi 12-34.567, ECLI:FR:CCASS:2020:SO00123 l1234-5"
    got = {(x.term, x.tf) for x in lexical.terms(spark.createDataFrame([(1, text)], "chunk_id int, text string"), "chunk_id").collect()}
    assert {("ref:l1234-5", 2), ("ref:12-34.567", 1), ("ref:ecli:fr:ccass:2020:so00123", 1), ("cheval", 1), ("travail", 1), ("traval", 1), ("articl", 1), ("code", 1)} <= got
    assert not {"du", "les", "et"} & {t for t, _ in got}


@pytest.mark.parametrize("size", [5, 4096])
def test_lexical_top_k_in_blocks(spark, size):
    """Blocks of five passages, of which most need not be scored, give what one block gives, and what a plain sum gives."""
    import math
    import random
    from collections import Counter

    from corpusloom.operators import lexical

    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "omega", "theta"]
    texts = {k: " ".join(r.choices(words, weights=[40, 20, 10, 5, 3, 2, 1], k=r.randint(0, 25))) for k in range(120)} | {200 + k: "omega theta alpha" for k in range(6)}
    asked = {1: "theta omega", 2: "alpha alpha", 3: "unknown", 4: "kappa beta theta", 5: ""}
    index = lexical.build_index(spark.createDataFrame(list(texts.items()), "chunk_id int, text string"), block_size=size)
    got = sorted((x.query_id, x["rank"], x.chunk_id, x.score) for x in lexical.top_k(index, spark.createDataFrame(list(asked.items()), "query_id int, text string"), 4).collect())
    counts = {k: Counter(t.split()) for k, t in texts.items()}
    mean, df = sum(sum(c.values()) for c in counts.values()) / len(texts), Counter(w for c in counts.values() for w in c)
    expected = []
    for q, text in asked.items():
        scores = []
        for k, c in counts.items():
            found = [math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(text.split()) if c[w]]
            if found:
                scores.append((-sum(math.floor(x * 1e6 + 0.5) for x in found), k))
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(sorted(scores)[:4])]
    assert got == sorted(expected)


def test_contract(spark):
    fine = spark.createDataFrame([("c", "i", 0, 2, "article")], "chunk_id string, identifier string, char_start int, char_end int, document_type string")
    assert retrieval.checked(fine).count() == 1
    with pytest.raises(Exception, match="contract violation"):
        retrieval.checked(fine.withColumn("chunk_id", F.lit(""))).collect()


def test_prompt_and_stream(spark):
    lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(['data: {"choices":[{"delta":{"content":"Bon"}}]}', "noise", '{"choices":[{"delta":{"content":"jour"}}]}', "data: [DONE]", '{"choices":[{"delta":{"content":"!"}}]}'])], "id int, n int, line string")
    assert retrieval.stream_text(lines).first().text == "Bonjour"
    none = spark.createDataFrame([], "rank int, title string, text string")
    assert retrieval.context_text(none).first().context == retrieval.NO_CONTEXT
    parts = spark.sql("SELECT array(named_struct('type', 'text', 'text', 'a'), named_struct('type', 'data', 'text', 'x'), named_struct('type', 'text', 'text', 'b')) AS p")
    assert parts.select(retrieval.joined_parts(F.col("p")).alias("t")).first().t == "ab"
    assert [retrieval.health(n) for n in (3, 2, 1)] == ["ok", "degraded", "down"]


def test_status_and_counts(spark):
    def status(*n):
        return one(spark, stats.status(F.lit(n[0]), *map(F.lit, n[1:])))

    assert status("ok", 0, 5, 0, 0) == "ok" and status("ok", 3, 2, 1, 0) == "ok"
    assert status("ok", 3, 2, 0, 0) == "degraded" and status("ok", 3, 2, 0, 1) == "degraded" and status("failed", 3, 3, 0, 0) == "failed"
    events = spark.createDataFrame([("document.fetched", "4"), ("document.fetched", "-1"), ("document.fetched", "x"), ("document.parsed", "9"), ("document.parsed", None)], "event_type string, count string")
    assert {r.event_type: r.n for r in stats.event_counts(events).collect()} == {"document.fetched": 6, "document.parsed": 2}
    empty = spark.createDataFrame([], "category string, value string, n long, example struct<identifier:string,source_file:string>")
    assert {r.category: r["values"] for r in stats.with_all_categories(empty).collect()} == {"tags": [], "roots": [], "links": []}


def test_embedding_policy(spark):
    chunks = spark.createDataFrame([("a", "x" * 50), ("b", "short"), ("c", "y" * 9)], "chunk_id string, text string")
    embedded = embedding.embed(chunks, embedding.hashing_client(8, limit=20), 8, "m")
    got = {r.chunk_id: r for r in embedded.collect()}
    assert got["a"].truncated and not got["b"].truncated and len(got["c"].embedding) == 8
    assert stats.truncated_chunks(embedded).first().n == 1 and all(r.error is None for r in got.values())


def test_requests_overlap_in_order(spark):
    """A client of 50 ms a call: eight in flight are four times as fast at least, with equal vectors in the same order."""
    import threading
    import time

    busy, most, lock = [0], [0], threading.Lock()

    def slow():
        inner = embedding.hashing_client(8)()

        def embed(texts):
            with lock:
                busy[0] += 1
                most[0] = max(most[0], busy[0])
            time.sleep(0.05)
            with lock:
                busy[0] -= 1
            return list(reversed(inner(texts)))

        return embed

    texts = [f"text {k} " + "x" * (k % 7) for k in range(320)]
    taken, results = {}, {}
    for n in (1, 8):
        began = time.time()
        results[n] = embedding.overlapped(slow, texts, 8, 4, 10_000, n, 0, 0)
        taken[n] = time.time() - began
    assert results[1] == results[8] and taken[1] > 4 * taken[8] and most[0] == 8
    assert [len(x) for x in embedding._requests(["a" * 60, "b" * 60, "c", "d" * 500, "e"], 3, 100)] == [1, 2, 1, 1]
    chunks = spark.createDataFrame([(f"{k}", t) for k, t in enumerate(texts)], "chunk_id string, text string")
    one, eight = ({r.chunk_id: r.embedding for r in embedding.embed(chunks, embedding.hashing_client(8), 8, "m", in_flight=n).collect()} for n in (1, 8))
    assert one == eight


def test_an_unavailable_client_is_asked_again():
    calls = []

    def make():
        inner = embedding.hashing_client(8)()

        def embed(texts):
            calls.append(len(texts))
            if len(calls) < 3:
                raise embedding.Unavailable
            return inner(texts)

        return embed

    (vector, _, error), = embedding.overlapped(make, ["a"], 8, 4, 100, 1, 4, 0.001)
    assert len(vector) == 8 and error is None and calls == [1, 1, 1]
    calls.clear()
    (vector, _, error), = embedding.overlapped(make, ["a"], 8, 4, 100, 1, 1, 0.001)
    assert vector is None and error[0] == "Unavailable"


def plan(root, **more):
    return ingest.RunPlan.of({"root": root, "max_chars": 20, "overlap_chars": 5, "sources": "legi", **more})


def test_plan_is_strict():
    with pytest.raises(ValueError, match="unknown: x.*missing: root"):
        ingest.RunPlan.of({"x": 1, "max_chars": 5, "overlap_chars": 1})
    with pytest.raises(ValueError, match="development"):
        plan("r", wipe=True)


def test_two_runs_promote_a_pending_edge(spark, tmp_path):
    (tmp_path / "legi").mkdir()
    (tmp_path / "legi/a.xml").write_text(ARTICLE, encoding="utf-8")
    (tmp_path / "legi/bad.xml").write_text("<ARTICLE>", encoding="utf-8")
    store = sinks.Store(spark, f"file://{tmp_path}/store")
    first = ingest.run(spark, plan(f"file://{tmp_path}"), store, embedding.hashing_client(8), 8, "m")
    assert first["written"] == 1 and first["relations_pending"] == 5 and first["relations_written"] == 0 and first["counts"]["document.unreadable"] == 1
    (tmp_path / "legi/a.xml").unlink()
    (tmp_path / "legi/b.xml").write_text(f"<ARTICLE><META><ID>{B}</ID></META></ARTICLE>", encoding="utf-8")
    second = ingest.run(spark, plan(f"file://{tmp_path}"), store, embedding.hashing_client(8), 8, "m")
    assert second["relations_promoted"] == 1
    edges = store.read("edges", ingest.EDGES).collect()
    assert {(e.src, e.dst, e.type) for e in edges} == {(A, B, "cite")}
    assert store.read("chunks", "chunk_id string").count() > 0
    assert store.read("run_summaries", "run_id string, status string").count() == 2
    store.wipe()
    assert not store.exists("documents") and store.exists("run_summaries")
    assert TEXT


def test_stream_of_runs(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    kind = f"identifier string, e struct<{', '.join(f.replace(' ', ':', 1) for f in incremental.EDGES.split(', '))}>"
    kind = "identifier string, e struct<src:string,dst:string,type:string,props:map<string,string>,source:string,doc:string,seq:int>"
    source = tmp_path / "in"
    rows = [("A", None), (None, ("A", "X", "cite", {"k": "v"}, "legi", "A", 0))]
    spark.createDataFrame(rows, kind).coalesce(1).write.json(str(source / "1"))
    stream = spark.readStream.schema(kind).json(f"{source}/*")
    incremental.incremental_runs(stream, store, f"{tmp_path}/c").awaitTermination()
    assert store.read("pending", incremental.PENDING).count() == 1 and store.read("edges", incremental.KEPT).count() == 0
    spark.createDataFrame([("X", None)], kind).coalesce(1).write.json(str(source / "2"))
    incremental.incremental_runs(stream, store, f"{tmp_path}/c").awaitTermination()
    assert store.read("pending", incremental.PENDING).count() == 0
    assert store.read("edges", incremental.KEPT).first().props == {"k": "v"}


def test_changes_are_merged_on_read(spark, tmp_path, monkeypatch):
    """Upserts and removals of many publishes against a dict; parts are merged meanwhile."""
    import random

    monkeypatch.setattr(sinks, "RAW", 3)
    r, held, store = random.Random(1), {}, sinks.Store(spark, f"file://{tmp_path}/s", buckets=4)
    schema = "identifier string, label string, props map<string,string>"
    for n in range(8):
        some = {f"k{r.randint(0, 30)}" for _ in range(9)}
        gone = {f"k{r.randint(0, 30)}" for _ in range(4)} - some
        store.upsert("nodes", spark.createDataFrame([(k, f"{n}", {"n": str(n)}) for k in some], schema))
        held |= {k: f"{n}" for k in some}
        if n % 2:
            store.remove("nodes", spark.createDataFrame([(k, None, None) for k in gone] or [("none", None, None)], schema))
            held = {k: v for k, v in held.items() if k not in gone}
        store.publish()
        again = sinks.Store(spark, f"file://{tmp_path}/s", buckets=4)
        assert {x.identifier: x.label for x in again.read("nodes", schema).collect()} == held
        keys = spark.createDataFrame([(f"k{k}",) for k in range(0, 40, 3)], "identifier string")
        assert {x.identifier: x.label for x in again.fetch("nodes", schema, keys).collect()} == {k: v for k, v in held.items() if int(k[1:]) % 3 == 0}
        assert {x.identifier for x in again.existing("nodes", keys).collect()} == {k for k in held if int(k[1:]) % 3 == 0}
    parts = store.manifest()["nodes"]
    assert any(p["buckets"] for p in parts) and len(parts) < 8


def test_a_lookup_reads_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    """The files that are read follow the keys and not the store."""
    monkeypatch.setattr(sinks, "RAW", 1)
    schema = "identifier string, label string, props map<string,string>"
    read = {}
    for n in (1_000, 100_000):
        store = sinks.Store(spark, f"file://{tmp_path}/{n}", buckets=max(8, n // 500))
        store.upsert("nodes", spark.range(n).selectExpr("concat('k', id) AS identifier", "'x' AS label", "map('a', 'b') AS props"))
        store.publish()
        found = store.fetch("nodes", schema, spark.createDataFrame([("k7",), ("k8",), ("none",)], "identifier string"))
        assert {x.identifier for x in found.collect()} == {"k7", "k8"}
        part = store.manifest()["nodes"][0]
        files = store._part(part, schema, spark.createDataFrame([("k7",), ("k8",), ("none",)], "identifier string"), "nodes")
        read[n] = len(files.select(F.input_file_name()).distinct().collect())
    assert all(few <= 3 for few in read.values())


def test_the_cost_of_a_batch_follows_the_batch(spark, tmp_path, monkeypatch):
    """A batch of ten nodes and edges into a store of 400 and of 8,000 nodes and edges reads about as much."""
    monkeypatch.setattr(sinks, "RAW", 1)
    kind = "identifier string, e struct<src:string,dst:string,type:string,props:map<string,string>,source:string,doc:string,seq:int>"
    spent = {}
    for n in (400, 8_000):
        store = sinks.Store(spark, f"file://{tmp_path}/{n}", buckets=n // 50)
        whole = spark.range(n).selectExpr("concat('n', id) AS identifier", "named_struct('src', concat('n', id), 'dst', concat('n', id + 1), 'type', 'cite', 'props', map('k', 'v'), 'source', 's', 'doc', 'd', 'seq', 0) AS e")
        incremental.apply_batch(store, whole, "run-0")
        assert store.read("edges", incremental.KEPT).count() == n - 1 and store.read("pending", incremental.PENDING).count() == 1
        monkeypatch.setattr(sinks, "RAW", 8)
        rows = []
        monkeypatch.setattr(store, "_part", lambda part, *a, _part=store._part: rows.append(out := _part(part, *a)) or out)
        few = spark.createDataFrame([(f"n{k}", (f"n{k}", f"n{k + 1}", "cite", {"k": "w"}, "s", "d", 0)) for k in range(n, n + 10)], kind)
        incremental.apply_batch(store, few, "run-1")
        spent[n] = sum(r.count() for r in rows)
        monkeypatch.setattr(sinks, "RAW", 1)
        assert store.read("edges", incremental.KEPT).count() == n + 9
    assert spent[8_000] < 3 * spent[400]


def test_a_run_that_stops_anywhere_leaves_nothing_half_written(spark, tmp_path, monkeypatch):
    """Stopped before any of its writes, before it publishes or at the rename: the store is as before, and the next start deletes what is left."""
    monkeypatch.setattr(sinks, "RAW", 2)
    kind = "identifier string, e struct<src:string,dst:string,type:string,props:map<string,string>,source:string,doc:string,seq:int>"
    root = f"file://{tmp_path}/s"

    def batch(k):
        return spark.createDataFrame([(f"n{k}", (f"n{k}", f"n{k + 1}", "cite", {}, "s", "d", 0))], kind)

    def state():
        store = sinks.Store(spark, root)
        return sorted(r.identifier for r in store.read("nodes", incremental.NODES).collect()), store.read("edges", incremental.KEPT).count(), store.read("pending", incremental.PENDING).count()

    def folders():
        store = sinks.Store(spark, root)
        held = {at for n in store._numbers() for at in sinks._folders(store._read(n)["tables"])}
        return {f"file://{f}" for t in ("nodes", "edges", "pending") for f in (tmp_path / "s" / t).iterdir()} - held

    incremental.apply_batch(sinks.Store(spark, root), batch(0), "r0")
    incremental.apply_batch(sinks.Store(spark, root), batch(1), "r1")
    before = state()
    assert before == (["n0", "n1"], 1, 1) and not folders()

    class Stopped(Exception):
        pass

    for step in range(6):
        store = sinks.Store(spark, root)
        intend, seen = store._intend, []

        def stop(name, intend=intend, seen=seen, step=step):
            if len(seen) == step:
                raise Stopped
            seen.append(name)
            return intend(name)

        if step < 5:
            monkeypatch.setattr(store, "_intend", stop)
        else:
            monkeypatch.setattr(store, "_replace", lambda *a: (_ for _ in ()).throw(Stopped))
        with pytest.raises(Stopped):
            incremental.apply_batch(store, batch(2), "r2")
        assert state() == before
        done = sinks.Store(spark, root).recover()
        assert not folders() and done["saga.compensation.triggered"] == done["saga.compensation.completed"] and done["saga.compensation.failed"] == 0
        assert (done["saga.compensation.triggered"] > 0) == (step > 0)
    stuck = sinks.Store(spark, root)
    stuck.upsert("nodes", spark.createDataFrame([("x", None, None)], incremental.NODES))
    monkeypatch.setattr(stuck, "_delete", lambda at: (_ for _ in ()).throw(OSError))
    assert stuck.discard()["saga.compensation.failed"] == 1 and len(folders()) == 1
    assert sinks.Store(spark, root).recover()["saga.compensation.completed"] == 1 and not folders()
    incremental.apply_batch(sinks.Store(spark, root, keep=1), batch(2), "r2")
    assert state() == (["n0", "n1", "n2"], 2, 1) and not folders() and len(sinks.Store(spark, root)._numbers()) == 1


def test_rate_limit_stream(spark, tmp_path):
    spark.sql("SELECT id % 2 AS user_id, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts FROM range(40)").write.parquet(f"{tmp_path}/e")
    late = spark.sql("SELECT 9L AS user_id, timestamp'2024-01-02' AS ts")
    late.write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(late.schema).parquet(f"{tmp_path}/e")
    q = incremental.rate_limited_stream(stream, 60, 10).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.n) for r in spark.table("limited").collect()} == {(0, 20), (1, 20)}


def test_last_writer_wins_and_publish_survives_a_stop(spark, tmp_path):
    old = spark.createDataFrame([("a", "old"), ("b", "old")], "identifier string, v string")
    new = spark.createDataFrame([("a", "1"), ("a", "3"), ("a", "2"), ("c", "1"), ("c", "1")], "identifier string, v string")
    assert sorted(map(tuple, sinks.replaced(old, new, "identifier", "v").collect())) == [("a", "3"), ("b", "old"), ("c", "1")]
    chunks = spark.createDataFrame([("a_0", "a", 0, 2, "xy"), ("a_0", "a", 0, 3, "xyz"), ("a_1", "a", 2, 3, "z")], "chunk_id string, parent_identifier string, char_start int, char_end int, text string")
    kept = sinks.replaced_chunks(chunks, chunks, new).select("chunk_id", "text").collect()
    assert sorted(map(tuple, kept)) == [("a_0", "xyz"), ("a_1", "z")]
    store = sinks.Store(spark, f"file://{tmp_path}/store")
    store.stage("documents", old)
    store.publish()
    store.stage("documents", new)

    class Stopped(Exception):
        pass

    whole = store._fs
    jvm, fs = whole()

    class NoRename:
        def __getattr__(self, name):
            if name == "rename":
                raise Stopped
            return getattr(fs, name)

    store._fs = lambda: (jvm, NoRename())
    try:
        store.publish()
        raise AssertionError("not stopped")
    except Stopped:
        pass
    again = sinks.Store(spark, f"file://{tmp_path}/store")
    assert again.read("documents", old.schema).count() == 2
    store._fs = whole
    store.publish()
    assert again.read("documents", old.schema).count() == 5


def test_repeated_new_nodes_are_one(spark):
    from corpusloom.operators import graph

    old = spark.createDataFrame([("n", "Texte", {"a": "0", "z": "9"})], "identifier string, label string, props map<string,string>")
    new = spark.createDataFrame([("n", "Texte", {"a": "1"}), ("n", "Texte", {"a": "2", "b": "1"}), ("m", "Article", {}), ("m", "Article", {})], old.schema)
    assert {r.identifier: r.props for r in graph.merge_nodes(old, new).collect()} == {"n": {"a": "2", "b": "1", "z": "9"}, "m": {}}
    assert graph.merge_nodes(old, new).count() == 2


def test_a_failing_document_is_counted_and_the_run_goes_on(spark, tmp_path):
    (tmp_path / "legi").mkdir()
    for name, me, text in (("a", A, "fine words"), ("b", B, "poison words")):
        (tmp_path / f"legi/{name}.xml").write_text(f"<ARTICLE><META><ID>{me}</ID></META><BLOC_TEXTUEL><CONTENU>{text}</CONTENU></BLOC_TEXTUEL></ARTICLE>", encoding="utf-8")

    def refusing():
        inner = embedding.hashing_client(8)()

        def embed(texts):
            # Takes what has a "fine" in it only, so a text without it is refused however short.
            if not all("fine" in t for t in texts):
                raise embedding.TooLarge
            return inner(texts)

        return embed

    store = sinks.Store(spark, f"file://{tmp_path}/store")
    report = ingest.run(spark, plan(f"file://{tmp_path}"), store, refusing, 8, "m")
    assert (report["written"], report["failed"], report["status"]) == (1, 1, "degraded")
    assert report["counts"]["document.fetched"] == 2 and report["counts"]["document.failed"] == 1
    assert [r.identifier for r in store.read("documents", "identifier string").collect()] == [A]
    assert [r.parent_identifier for r in store.read("chunks", "parent_identifier string").distinct().collect()] == [A]
    assert store.read("run_summaries", "status string").first().status == "degraded"


def test_each_failure_is_isolated_and_typed(spark, tmp_path):
    """Any error of a client for one text, and a file that the reader cannot take apart: both are counted by kind, all others are written."""
    (tmp_path / "legi").mkdir()
    c = "LEGIARTI000000000777"
    for name, me, text in (("a", A, "fine words"), ("b", B, "poison words"), ("c", c, "more words")):
        (tmp_path / f"legi/{name}.xml").write_text(f"<ARTICLE><META><ID>{me}</ID></META><BLOC_TEXTUEL><CONTENU>{text}</CONTENU></BLOC_TEXTUEL></ARTICLE>", encoding="utf-8")
    (tmp_path / "legi/d.xml").write_bytes(b'<?xml version="1.0" encoding="shift_jis"?><ARTICLE/>')

    def moody():
        inner = embedding.hashing_client(8)()

        def embed(texts):
            if any("poison" in t for t in texts):
                raise ZeroDivisionError("no vector today")
            return inner(texts)

        return embed

    store = sinks.Store(spark, f"file://{tmp_path}/store")
    report = ingest.run(spark, plan(f"file://{tmp_path}"), store, moody, 8, "m")
    assert (report["written"], report["failed"], report["status"]) == (2, 2, "degraded")
    assert report["failures"][("embed", "ZeroDivisionError")] == (1, B, "no vector today")
    assert report["failures"][("decode", "ValueError")][0] == 1
    counts = report["counts"]
    assert counts["document.fetched"] == counts["document.persisted"] + counts["document.invalidated"] + counts["document.failed"] == 4
    assert {r.identifier for r in store.read("documents", "identifier string").collect()} == {A, c}


def test_nothing_is_written_for_another_model(spark, tmp_path):
    (tmp_path / "legi").mkdir()
    (tmp_path / "legi/a.xml").write_text(ARTICLE, encoding="utf-8")
    store = sinks.Store(spark, f"file://{tmp_path}/store")
    here = f"file://{tmp_path}"

    def named(model, dim):
        def make():
            client = embedding.hashing_client(dim)()
            client.served = model, dim
            return client

        return make

    for make, dim in ((embedding.hashing_client(9), 8), (named("other", 8), 8), (named("m", 9), 8)):
        with pytest.raises(ValueError, match="served"):
            ingest.run(spark, plan(here), store, make, dim, "m")
    assert store.manifest() == {} and not (tmp_path / "store").exists()
    ingest.run(spark, plan(here), store, named("m", 8), 8, "m")
    held = store.manifest()
    for make, dim, model in ((named("m", 9), 9, "m"), (named("n", 8), 8, "n")):
        with pytest.raises(ValueError, match="was made with"):
            ingest.run(spark, plan(here), store, make, dim, model)
    assert store.manifest() == held
    ingest.run(spark, plan(here, development=True, wipe=True), store, named("n", 9), 9, "n")


def test_a_repeated_key_stops_the_run(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/store")
    store.stage("nodes", spark.createDataFrame([("a",), ("b",)], "identifier string"))
    store.check_unique()
    store.stage("documents", spark.createDataFrame([("a",), ("a",)], "identifier string"))
    with pytest.raises(ValueError, match="more than once: documents a"):
        store.check_unique()


def test_rows_of_an_unknown_source_are_an_error(spark):
    from corpusloom.operators import links, parsing
    from corpusloom.sources import xml

    files = spark.createDataFrame([("x/a.xml", ARTICLE.encode())], "path string, content binary")
    raw = xml.raw_documents(xml.decode_facets(files, "legi"))
    assert parsing.parse_all(raw, ["legi"]).count() == 1
    with pytest.raises(Exception, match="no parser for the source"):
        parsing.parse_all(raw, ["jade"]).collect()
    with pytest.raises(Exception, match="no links for the source"):
        links.extract(parsing.parse_all(raw, ["legi"]), ["jade"]).collect()
