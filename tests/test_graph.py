import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph


def edges(spark, pairs, kind="contient"):
    rows = [(a, b, kind, {"n": str(i)}, "d", i) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src string, dst string, type string, props map<string,string>, doc string, seq int")


def brute(pairs):
    pairs = list(dict.fromkeys(pairs))
    step = {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)

    def reach(a, seen=()):
        out = set()
        todo = list(step.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += step.get(x, ())
        return out

    if any(a in reach(a) for a in step):
        return set(pairs)
    return {(a, b) for a, b in pairs if not any(b in reach(m) for m in step[a] if m != b)}


@pytest.mark.parametrize("seed", range(3))
def test_reduction_against_brute_force(spark, seed):
    r = random.Random(seed)
    pairs = [(a, b) if seed == 2 or a < b else (b, a) for a, b in ((str(r.randint(0, 9)), str(r.randint(10, 12) if seed == 1 else r.randint(0, 9))) for _ in range(22)) if a != b]
    got = {(x.src, x.dst) for x in graph.reduce_transitively(edges(spark, pairs), "doc", "seq").collect()}
    assert got == brute(pairs)


@pytest.mark.parametrize("seed", range(6))
def test_reduction_of_forks_and_joins(spark, seed):
    """Acyclic graphs without thin nodes to contract, and such with long chains between them."""
    r = random.Random(seed)
    names = [f"{r.random():.6f}" for _ in range(14)]
    pairs = [tuple(names[k] for k in sorted(r.sample(range(14), 2))) for _ in range(30)]
    for k in range(3):
        a, b = sorted(r.sample(range(14), 2))
        chain = [names[a], *(f"c{k}.{j}" for j in range(r.randint(1, 30))), names[b]]
        pairs += list(zip(chain, chain[1:], strict=False)) + [(names[a], names[b])]
    got = {(x.src, x.dst) for x in graph.reduce_transitively(edges(spark, pairs), "doc", "seq").collect()}
    assert got == brute(pairs)


@pytest.mark.parametrize("small", [0, 12, 2048])
def test_reduction_by_component(spark, monkeypatch, small):
    """Many components of any size, with one top and with several: all in tasks, some, or none; and a cycle in one of them."""
    r = random.Random(small)
    pairs = []
    for c in range(60):
        n = r.choice((2, 3, 5, 9))
        tops = r.choice((0, 0, 3))
        names = [f"{r.random():.6f}" for _ in range(n + tops)]
        pairs += [(names[k], names[k + 1]) for k in range(n - 1)]
        pairs += [tuple(names[k] for k in sorted(r.sample(range(n), 2))) for _ in range(n)]
        pairs += [(names[n + k], names[r.randrange(n)]) for k in range(tops) for _ in range(2)]
    monkeypatch.setattr(graph, "SMALL", small)
    reduced = {(x.src, x.dst) for x in graph.reduce_transitively(edges(spark, pairs), "doc", "seq").collect()}
    assert reduced == brute(pairs) and len(set(pairs)) - len(reduced) > 40
    if small:
        cyclic = [*pairs, ("x", "y"), ("y", "z"), ("x", "z"), ("z", "y")]
        assert {(x.src, x.dst) for x in graph.reduce_transitively(edges(spark, cyclic), "doc", "seq").collect()} == set(cyclic)


def test_components_in_batches(monkeypatch):
    """Components that batches cut, and tables of nodes that go over the limit, against one component at a time."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    pairs = sorted({(c, *sorted(r.sample(range(8), 2))) for c in range(300) for _ in range(12)})
    rows = pa.RecordBatch.from_arrays([pa.array([f"{c}.{a}" for c, a, _ in pairs]), pa.array([f"{c}.{b}" for c, _, b in pairs]), pa.array([str(c) for c, _, _ in pairs])], ["src", "dst", "part"])
    monkeypatch.setattr(graph, "SMALL", 1)
    monkeypatch.setattr(graph, "REACH_CELLS", 500)
    found = [(x["src"], x["dst"]) for b in graph._reduced(rows.slice(k, 50) for k in range(0, len(pairs), 50)) for x in b.to_pylist()]
    want = {(f"{c}.{a}", f"{c}.{b}") for c, a, b in pairs} - brute([(f"{c}.{a}", f"{c}.{b}") for c, a, b in pairs])
    assert len(found) == len(want) > 300 and set(found) == want
    assert graph._longer_paths(np.array([0, 1]), np.array([1, 0]), np.zeros(2, np.int64), 2) is None


def test_many_small_graphs_take_few_jobs(spark):
    """Chains with shortcuts, of which each needs several rounds of contraction and of search."""
    pairs = [(f"{c}.{k}", f"{c}.{k + j}") for c in range(40) for k in range(2 + c % 18) for j in (1, 3) if j == 1 or (k + c) % 2 and k + 3 <= 2 + c % 18]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("small", "small")
    got = {(x.src, x.dst) for x in graph.reduce_transitively(edges(spark, pairs), "doc", "seq").collect()}
    jobs = len(tracker.getJobIdsForGroup("small"))
    spark.sparkContext.setJobGroup("", "")
    assert got == {p for p in pairs if int(p[1].split(".")[1]) - int(p[0].split(".")[1]) == 1}
    assert jobs < 80, jobs


def test_cycles(spark):
    def cyclic(pairs):
        return graph.has_cycle(spark.createDataFrame(pairs, "src string, dst string"))

    chain = [(str(k), str(k + 1)) for k in range(40)]
    assert not cyclic(chain) and not cyclic([]) and not cyclic(chain + [("0", "40"), ("3", "30"), ("x", "5"), ("5", "y")])
    assert cyclic([("a", "a")]) and cyclic([("a", "b"), ("b", "a")])
    assert cyclic(chain + [("40", "0")]) and cyclic(chain + [("30", "7"), ("x", "5"), ("x", "y")])
    ladder = [(f"{k}{a}", f"{k + 1}{b}") for k in range(6) for a in "ab" for b in "ab"]
    assert not cyclic(ladder) and cyclic(ladder + [("6a", "0b")])
    pairs = [*chain, ("0", "40"), ("40", "12")]
    assert {(x.src, x.dst) for x in graph.reduce_transitively(edges(spark, pairs), "doc", "seq").collect()} == set(pairs)


def test_a_deep_chain_takes_few_jobs(spark):
    """A chain of 1,000 edges, each node with a leaf besides, and an edge from its begin to its end."""
    chain = [(str(k), str(k + 1)) for k in range(1000)]
    pairs = [*chain, ("0", "1000"), *((str(k), f"leaf {k}") for k in range(1, 1000))]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "deep")
    got = {(x.src, x.dst) for x in graph.reduce_transitively(edges(spark, pairs), "doc", "seq").collect()}
    jobs = len(tracker.getJobIdsForGroup("deep"))
    spark.sparkContext.setJobGroup("", "")
    assert got == set(pairs) - {("0", "1000")}
    assert jobs < 120


def test_other_verbs_pass_with_repeats(spark):
    both = edges(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("A", "B")]).unionByName(edges(spark, [("A", "C"), ("A", "C")], "cite"))
    got = sorted((x.src, x.dst, x.type) for x in graph.reduce_transitively(both, "doc", "seq").collect())
    assert got == [("A", "B", "contient"), ("A", "C", "cite"), ("A", "C", "cite"), ("B", "C", "contient")]


def test_written_and_pending_make_up_the_input(spark):
    nodes = spark.createDataFrame([("A",), ("B",)], "identifier string")
    e = edges(spark, [("A", "B"), ("A", "X"), ("Y", "B"), ("A", "B")], "cite")
    written, pending = graph.split_by_endpoints(e, nodes)
    assert written.count() == 2 and pending.count() == 2


def test_pending_keeps_its_first_run_and_is_promoted(spark):
    none = spark.createDataFrame([], "src string, dst string, type string, source string, props map<string,string>, first_seen_run string, last_seen_run string")
    seen = edges(spark, [("A", "X"), ("A", "Z")], "cite").withColumn("source", F.lit("legi"))
    two = graph.upsert_pending(graph.upsert_pending(none, seen, "r1"), seen.where("dst = 'X'"), "r2")
    assert {(p.dst, p.first_seen_run, p.last_seen_run) for p in two.collect()} == {("X", "r1", "r2"), ("Z", "r1", "r1")}
    nodes = spark.createDataFrame([("A",), ("X",)], "identifier string")
    promoted, still = graph.promote(two, spark.createDataFrame([("X",)], "identifier string"), nodes)
    assert [p.dst for p in promoted.collect()] == ["X"] and [p.dst for p in still.collect()] == ["Z"]


def test_merges(spark):
    e = edges(spark, [("A", "B"), ("A", "B")], "cite")
    assert graph.merged_props(e, "doc", "seq").first().props == {"n": "1"}
    old = spark.createDataFrame([("A", "Article", {"title": "x", "k": "1"})], "identifier string, label string, props map<string,string>")
    new = spark.createDataFrame([("A", "Article", {"title": "y"}), ("B", "Texte", {})], old.schema)
    got = {r.identifier: r.props for r in graph.merge_nodes(old, new).collect()}
    assert got == {"A": {"title": "y", "k": "1"}, "B": {}}
    kept = spark.createDataFrame([("A", "B", "r1"), ("A", "C", "r2")], "src string, dst string, run_id string")
    assert graph.without_run(kept, "r1").count() == 1 and graph.without_source(kept, "A").count() == 0
