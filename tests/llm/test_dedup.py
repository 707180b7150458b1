"""Exact and near deduplication against brute force; the cuckoo index; components."""

import hashlib
import random
import re

import pytest

from corpusloom.llm import components, exact_dedup, near_dedup
from corpusloom.llm.exact_dedup import CuckooIndex

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest int, keep_id string")


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live, r = CuckooIndex(4), set(), random.Random(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(4000)]
    for _ in range(12000):
        k = r.choice(keys)
        if index.find(k) is None:
            assert k not in live
            index.insert(k, None)
            live.add(k)
        elif r.random() < 0.4:
            assert index.delete(k)
            live.discard(k)
    assert {d for d, _ in index.items()} == live and index.resized > 0 and not index.delete(b"\1" * 32)


def test_exact(spark):
    texts = [None, "", " \n", "ab c", "a bc", "abc", "a b  c", "abd", "É x", "éx", "abc", "z" * 50000] + ["same"] * 40
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts).repartition(5)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(SPACE.sub("", t or ""), []).append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_live_index_changes(spark):
    """Rows are deleted one by one: a digest is live as long as one row of it is."""
    d = exact_dedup.digests(frame(spark, ["a", "b", "c", "a"]))
    index = exact_dedup.live_index(d)
    gone, new = exact_dedup.digests(frame(spark, ["a", "zz"])), exact_dedup.digests(frame(spark, ["d", "b"]))

    def content(index):
        return {bytes(r.digest): (r.keep_id, r.group_size) for r in index.digests.collect()}

    sha = {x: hashlib.sha256(x.encode()).digest() for x in "abcd"}
    assert content(index) == {sha["a"]: (0, 2), sha["b"]: (1, 1), sha["c"]: (2, 1)}
    index = exact_dedup.apply_changes(index, new, gone)
    assert content(index) == {sha["a"]: (3, 1), sha["b"]: (1, 2), sha["c"]: (2, 1), sha["d"]: (0, 1)}
    # Once more: row 0 of "a" is not live, so nothing goes; row 1 of "b" is there twice.
    index = exact_dedup.apply_changes(index, exact_dedup.digests(frame(spark, [])), gone)
    assert content(index)[sha["a"]] == (3, 1)
    index = exact_dedup.apply_changes(index, exact_dedup.digests(frame(spark, [])), d)
    assert content(index) == {sha["b"]: (1, 1), sha["d"]: (0, 1)}
    assert content(exact_dedup.apply_changes(index, exact_dedup.digests(frame(spark, [])), new.unionByName(d))) == {}


def test_live_index_against_brute_force(spark):
    r = random.Random(5)
    live = []
    index = exact_dedup.live_index(exact_dedup.digests(frame(spark, [])))
    for _ in range(3):
        new = [(r.choice([None, 1, 2, 3, 4]), r.choice("xyz") + r.choice(["", " ", "  "])) for _ in range(30)]
        old = [r.choice(live) for _ in range(12)] + [(9, "x")] if live else []
        for x in old:
            if x in live:
                live.remove(x)
        live += new
        a, b = (exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")) for rows in (new, old))
        index = exact_dedup.apply_changes(index, a, b, per_shard=5)
        want = {}
        for i, t in live:
            want.setdefault(hashlib.sha256(t.strip().encode()).digest(), []).append((len(t), i is not None, -(i or 0)))
        got = {bytes(x.digest): (x.keep_id, x.group_size) for x in index.digests.collect()}
        assert got == {k: (-max(v)[2] if max(v)[1] else None, len(v)) for k, v in want.items()}


def test_exactly_one_row_of_a_group_stays(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "ab c"), (None, "zz"), (None, "zz"), (2, None), (2, ""), (3, "x" * 1_000_000), (4, "x" * 1_000_000)]
    docs = spark.createDataFrame([(*x, True, 7, "k") for x in rows], "doc_id long, text string, kept boolean, keep_id int, digest string")
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows) and sorted((r.keep_id or -1, r.group_size) for r in got if r.kept) == [(-1, 2), (1, 3), (2, 2), (3, 2)]
    kept = exact_dedup.keep_documents(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1, (r.text or "")[:5]) for r in kept.collect()) == [(-1, "zz"), (1, "a b c"), (2, ""), (3, "xxxxx")]
    assert exact_dedup.keep_documents(docs.where("false")).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(50, 51), (51, 52), (60, 50), (70, 71), (71, 70)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 50 for i in (50, 51, 52, 60)} | {70: 70, 71: 70}


def brute(texts, size):
    sets = []
    for t in texts:
        w = [x for x in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(r):
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "One", "one", "ONE two", "x" * 3000]
    for _ in range(25):
        base = r.choices(words, k=r.randint(15, 120))
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 14))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else " \n".join(copy))
    base = r.choices(words, k=100)  # a large group of near copies
    for _ in range(150):
        copy = list(base)
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(100)] = r.choice(words)
        texts.append(" ".join(copy))
    return texts


def test_near(spark):
    for size, seed in ((2, 5), (5, 6)):
        texts = corpus(random.Random(seed))
        got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, texts), shingle=size).collect()}
        assert len(got) == len(texts)
        for i, (n, root) in enumerate(brute(texts, size)):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, i == root)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.near_duplicates(frame(spark, [None, ""])).count() == 2


def test_rows_without_doc_id(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, None), (3, "a b c d"), (4, "a  b c d"), (None, "only here")], "doc_id long, text string")
    exact = exact_dedup.exact_dedup(rows).collect()
    assert sorted((r.keep_id or -1, r.group_size, r.kept) for r in exact) == [(-1, 1, True), (-1, 1, True), (4, 3, False), (4, 3, False), (4, 3, True)]
    near = near_dedup.near_duplicates(rows, shingle=2).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near) == [(-1, 0, -1, True), (-1, 1, -1, True), (-1, 3, -1, True), (3, 3, 3, True), (4, 3, 3, False)]


def dense(r):
    """Groups whose texts share most of their shingles, linked in part, in chains and not at all; and very common words."""
    texts = []
    for rate in (3, 6, 9, 12):
        base = [f"v{rate}x{i}" for i in range(60)]
        for _ in range(45):
            copy = list(base)
            for _ in range(r.randint(0, rate)):
                copy[r.randrange(60)] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [f"of the of the law {i} and the law of {i}" for i in range(60)]
    return texts


def test_near_branches_deep_and_compares_leaves_by_blocks(spark, monkeypatch):
    """Small nodes, few levels and small blocks: what is right must not depend on them."""
    texts = dense(random.Random(11))
    want = brute(texts, 2)
    seen = []
    whole = near_dedup._in_blocks
    monkeypatch.setattr(near_dedup, "_in_blocks", lambda found, rows, *a: seen.append(rows.count()) or whole(found, rows, *a))
    for pools, few, many, block in (((24, 8, 8, 8, 8, 8), 4, 4, 256), ((24, 8), 4, 4, 16), ((24,), 2, 2, 16), ((24, 8, 8, 8), 4, 16, 7)):
        monkeypatch.setattr(near_dedup, "POOLS", pools)
        monkeypatch.setattr(near_dedup, "_LEVELS", [near_dedup._level(k) for k in range(len(pools))])
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(near_dedup, "MANY", many)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts), shingle=2).collect()}
        # Two in a thousand links at the threshold may be lost; no text may be linked that must not be.
        assert sum(got[i] != w for i, w in enumerate(want)) <= 1, pools
        assert all(want[i][1] == want[root][1] for i, (_, root) in got.items())
    assert len(seen) >= 2 and all(n > 16 for n in seen)


def test_near_a_class_is_looked_up_once_and_small_tables_are_few_files(spark, monkeypatch):
    """A class in many nodes meets its component and its set once; 48 shuffle partitions don't make 48 files of a few hundred rows."""
    texts = dense(random.Random(11))
    for name, value in (("POOLS", (24, 8, 8, 8)), ("_LEVELS", [near_dedup._level(k) for k in range(4)]), ("FEW", 4), ("MANY", 16), ("BLOCK", 7)):
        monkeypatch.setattr(near_dedup, name, value)
    looked, files, deep = [], [], []
    component, write, whole = near_dedup._Links.with_component, near_dedup.write_table, near_dedup._in_blocks

    def with_component(found, rows):
        looked.append((rows.count(), rows.select("rep").distinct().count()))
        return component(found, rows)

    def write_table(*a, **kw):
        out = write(*a, **kw)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup._Links, "with_component", with_component)
    monkeypatch.setattr(near_dedup, "write_table", write_table)
    monkeypatch.setattr(near_dedup, "_in_blocks", lambda found, rows, *a: deep.append(rows.count() > rows.select("rep").distinct().count()) or whole(found, rows, *a))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, texts), shingle=2).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = brute(texts, 2)
    assert sum(got[i] != root for i, (_, root) in enumerate(want)) <= 1 and all(want[i][1] == want[root][1] for i, root in got.items())
    assert any(deep) and looked and all(rows == classes for rows, classes in looked)
    assert max(files) <= near_dedup.TASKS


def test_near_branches_of_listed_nodes():
    """A class with the list of its nodes has the children that it has in each of them, and its component goes along."""
    import numpy as np
    import pyarrow as pa

    r, pool = np.random.RandomState(3), near_dedup.POOLS[1]
    tokens = [r.randint(0, 1 << 16, pool).astype(np.uint16).tobytes() for _ in range(3)]
    nodes = [[5, 6, 7], [], [6]]

    def children(rows, node):
        who = [k for k, _ in rows]
        batch = {"rep": pa.array(who, pa.int64()), "component": pa.array([10 * k for k in who], pa.int64()), "node": node, "sketch": pa.array([bytes(24)] * len(who), pa.binary()), near_dedup._level(1): pa.array([tokens[k] for k in who], pa.binary())}
        got = list(near_dedup._branch(1, 0.4)(iter([pa.RecordBatch.from_pydict(batch)])))
        return sorted((x["node"], x["rep"], x["component"]) for b in got for x in b.to_pylist())

    every = [(k, n) for k, ns in enumerate(nodes) for n in ns]
    one = children(every, pa.array([n for _, n in every], pa.int64()))
    assert one == children(list(enumerate(nodes)), pa.array(nodes, pa.list_(pa.int64()))) and len(one) >= 4
    assert all(c == 10 * k for _, k, c in one)


def test_near_one_level_loses_no_more_than_it_says():
    """Trees alone, without a star or connections: the share of pairs that meet in a last node."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.llm.near_dedup import GROWTH, POOLS, TREES, _branch, _level, _minwise, _plant

    from corpusloom.llm.words import mixed

    r = np.random.RandomState(5)
    pairs, share = 400, GROWTH / 0.8 - 1
    sets = []
    for _ in range(pairs):
        common = mixed(r.randint(0, 1 << 62, 800).astype(np.uint64))
        sets += [np.unique(np.r_[common, mixed(r.randint(0, 1 << 62, 100).astype(np.uint64))]) for _ in range(2)]
    tokens = _minwise(sets)
    assert abs((tokens[::2] == tokens[1::2]).mean() - 0.8) < 0.01
    few = [np.sort(mixed(np.arange(20 * i + k, 20 * i + k + 9, dtype=np.uint64))) for i in range(300) for k in range(2)]  # 8 of 10 are shared
    short = _minwise(few)
    assert abs((short[::2] == short[1::2]).mean() - 0.8) < 0.02
    cut = np.cumsum([0, *POOLS])
    columns = {_level(k): [np.ascontiguousarray(x[a:b].astype(np.uint16)).tobytes() for x in tokens] for k, (a, b) in enumerate(zip(cut, cut[1:]))}
    rep = np.arange(2 * pairs)
    sketch = [bytes(24)] * (2 * pairs)
    batch = pa.RecordBatch.from_pydict({"rep": rep, "sketch": pa.array(sketch, pa.binary()), _level(0): pa.array(columns[_level(0)], pa.binary())})
    got = [b for b in _plant(TREES, share)(iter([batch]))]
    for level in range(1, len(POOLS)):
        node, who = (np.concatenate([b[c].to_numpy() for b in got]) for c in ("node", "rep"))
        # Only pairs go on, as all else is alone in its node.
        key = np.stack([node, who // 2])
        _, at, n = np.unique(key, axis=1, return_inverse=True, return_counts=True)
        keep = n[at.ravel()] > 1
        met = np.unique(who[keep] // 2)
        assert len(met) >= 0.99 * pairs, level
        node, who = node[keep], who[keep]
        batch = pa.RecordBatch.from_pydict({"node": node, "rep": who, "sketch": pa.array([sketch[0]] * len(who), pa.binary()), _level(level): pa.array([columns[_level(level)][k] for k in who], pa.binary())})
        got = list(_branch(level, share)(iter([batch])))


def test_near_odd_rows(spark):
    """Repeated rows, a doc_id with several texts, clashing columns, a very long text, null doc_ids."""
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z u v w"), (2, "X y z u v w"), (3, "a b c d e  f"), (4, long), (5, long + " end"), (6, None), (6, None), (None, "a b c d e f"), (None, "p q r"), (None, "p q r")]
    docs = spark.createDataFrame([(*x, 1, "s", b"t") for x in rows], "doc_id long, text string, rep long, first string, sketch binary")
    got = near_dedup.near_duplicates(docs, shingle=2).collect()
    key = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got)
    n = len({tuple(x) for x in zip(long.split(), long.split()[1:])})
    assert key == sorted([(1, 5, 1, True)] * 3 + [(2, 5, 1, False), (3, 5, 1, False), (4, n, 4, True), (5, n + 1, 4, False), (6, 0, 6, True), (6, 0, 6, True), (-1, 5, -1, True), (-1, 2, -1, True), (-1, 2, -1, True)])
    kept = near_dedup.keep_documents(docs, shingle=2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:11]) for r in kept.collect()) == [(-1, "p q r"), (1, "a b c d e f"), (1, "x y z u v w"), (4, "w0 w1 w2 w3"), (6, ""), (6, "")]
    assert near_dedup.keep_documents(docs.where("false")).count() == 0


def test_upper_halves_never_contradict_full_sets():
    import numpy as np

    r, seen = np.random.RandomState(1), [0, 0, 0]
    for _ in range(1500):
        n = r.randint(1, 2000)
        same = int(n * r.uniform(0.85, 0.95))
        hashes = r.randint(0, 1 << 63, 3 * n).astype(np.uint64) * np.uint64(2)
        x, y = np.unique(hashes[:n]), np.unique(np.r_[hashes[:same], hashes[n : 2 * n - same]])
        upper = [(s >> np.uint64(32)).astype(np.uint32) for s in (x, y)]
        verdict = near_dedup._verdict(*upper, 80)
        seen[verdict] += 1
        assert verdict == 1 or (verdict == 2) == near_dedup._linked(x, y, 80)
    assert min(seen) > 0
    # Upper halves that agree by chance leave a doubt, they do not make a link.
    x = np.arange(1, 101, dtype=np.uint64) << np.uint64(32)
    y = np.r_[x[:88], x[88:89] + np.uint64(1), np.arange(300, 311, dtype=np.uint64) << np.uint64(32)]
    assert near_dedup._verdict(*[(s >> np.uint64(32)).astype(np.uint32) for s in (x, y)], 80) == 1 and not near_dedup._linked(x, y, 80)
    assert near_dedup._shared(np.array([1, 1, 2, 3], np.uint32), np.array([1, 2, 2, 2], np.uint32)) == 2
    assert 64 < near_dedup._chance(10**7, 10**7) < 10**5


@pytest.mark.parametrize("how", ["explode", "join", "union", "select"])
def test_rows_made_from_one_row_are_several(spark, tmp_path, how):
    """Frames derived from a scan: rows share the place of the row that they were made from, and still one of each group stays."""
    from pyspark.sql import functions as F

    words = [" ".join(f"w{k}{j}" for j in range(30)) for k in range(3)]
    spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    if how == "explode":
        docs = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    elif how == "join":
        docs = docs.join(spark.createDataFrame([(k, c) for k in range(3) for c in range(2)], "doc_id long, copy int"), "doc_id")
    elif how == "union":
        docs = docs.unionByName(docs)
    else:
        docs = docs.where("doc_id >= 0").select("text", F.lower("text").alias("low"), "doc_id")
    copies = 1 if how == "select" else 2
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 3
    assert exact_dedup.exact_dedup(docs).count() == 3 * copies
    for module in (exact_dedup, near_dedup):
        assert sorted(r.doc_id for r in module.keep_documents(docs).collect()) == [0, 1, 2]


def test_only_in_groups_of_files(spark, tmp_path, monkeypatch):
    """With bits for 100 rows in a broadcast and 8 rows in a block, rows of many files are still told apart."""
    from corpusloom.llm import rows

    monkeypatch.setattr(rows, "BROADCAST_BITS", 100)
    monkeypatch.setattr(rows, "BLOCK", 8)
    spark.range(0, 450, 1, 5).selectExpr("id", "repeat('x', 5) AS text").write.parquet(f"{tmp_path}/d")
    docs, every = rows.numbered(spark.read.parquet(f"{tmp_path}/d"))
    kept = every.where("id % 3 = 0 OR id > 400").select(rows.FILE, rows.AT)
    got = rows.only(every, kept)
    assert got.columns == ["id", "text"]
    assert sorted(r.id for r in got.collect()) == [k for k in range(450) if k % 3 == 0 or k > 400]
    assert rows.only(every, kept.where("false")).count() == 0
