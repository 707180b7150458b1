"""Near-duplicates by a chosen-path set similarity join.

Texts with the same shingle set are one class. Each class has minwise tokens, one for each of `BINS` bins
of its hashes; an empty bin borrows from another by a fixed order. One bit of each makes a sketch, and the
tokens are dealt to the levels of the trees, so that no level sees a token that one above it has seen.

A tree's node is a path of chosen tokens: at a node, one coordinate of its level (and a second one for a
share of the nodes) is picked by the node's own hash, by the tree's number at the root, and every class
goes on to the child of its token there. At the threshold a pair shares `GROWTH` children on average, so
that it stays together for ever in 0.41 of the trees, however deep they get, and in one of `TREES` trees at
least with probability 0.998; more above the threshold.

Classes of a node are compared unless they are connected already. Where that takes at most FEW / 2 comparisons
for each class, all are compared on sketches. Below the first level, where nodes share several tokens, nodes of
up to MANY / 2 comparisons for each class are compared on the full sets: classes are dealt to blocks, pairs of
blocks are compared, so that no node is one task, and only links leave a task, a forest of them; sketches tell
which classes need their sets at all. In other nodes every class is
compared with one that the node's hash picks, and all branch on. What has used up the tokens of `POOLS` is a
leaf and is compared by blocks, too, however large it is.

Candidates are confirmed on the full sets, each pair once. The upper halves of the hashes settle most pairs, as
what these share bounds what the sets share; only pairs within reach of a chance agreement need all bits. What links already connect is not compared again, and a node
whose classes are all connected is done, so a large group of near copies costs a star of links and not
all its pairs. All these rules hold at every size of the input.

Null, empty and all-space texts have no shingles and are linked with nothing. Rows whose doc_id is null are
linked with nothing by near_duplicates(), which keeps them with a null component_id; keep_documents() tells
rows apart by their place and takes them last. Rows of one doc_id may have different texts, each of which counts.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.rows import AT, FILE, TASKS, numbered, only, writers  # noqa: F401
from corpusloom.llm.words import LOWER, mixed, shingle_hashes
from corpusloom.llm.workers import trimmed
from corpusloom.session import drop_table, write_table

TREES, GROWTH, FEW, MANY = 12, 1.1, 64, 1024
#: Classes of a block, and shingles of all of them.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
BINS = 192
#: 64-bit words of a sketch.
WORDS = BINS // 64
#: Tokens of each level of a tree. The root's are dealt to the trees, one as first and one as second coordinate.
POOLS = (24,) * 4 + (8,) * 12
#: So many standard deviations fewer bits than the threshold's share must agree.
SLACK = 3.5
#: Bits for each wanted row in the filter that thins the texts read again for confirmation, and its largest size: 32 MB.
FILTER_SHARE, FILTER_BITS = 16, 1 << 28

#: For each bin the bins that it borrows from at first; then its neighbours' turn comes.
_BORROW = np.random.RandomState(20240229).randint(0, BINS, (BINS, 12))


def _shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the text with A-Z in lower case."""
    return np.unique(shingle_hashes(text.encode().translate(LOWER).split(), size)) if text else np.empty(0, np.uint64)


def _filled(low: np.ndarray) -> np.ndarray:
    """Rows of bins with the empty ones (the largest value) filled from the first of their order that is not; none is empty as a whole."""
    empty = np.uint32(0xFFFFFFFF)
    out, rows = low.copy(), np.flatnonzero((low == empty).any(axis=1))
    for k in range(_BORROW.shape[1]):
        if not len(rows):
            return out
        part = out[rows]
        part = np.where(part == empty, low[rows][:, _BORROW[:, k]], part)
        out[rows] = part
        rows = rows[(part == empty).any(axis=1)]
    # The nearest full bin before, round the end.
    part = np.hstack([out[rows]] * 2)
    at = np.maximum.accumulate(np.where(part != empty, np.arange(2 * BINS), 0), axis=1)[:, BINS:]
    out[rows] = np.take_along_axis(part, at, axis=1)
    return out


def _minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets of sorted hashes: a row for each. A hash's first bits say its bin."""
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int64) * BINS, [len(s) for s in sets])
    place = owner + ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    value = (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(sets) * BINS, 0xFFFFFFFF, np.uint32)
    low[place[starts]] = np.minimum.reduceat(value, starts)
    return mixed(_filled(low.reshape(len(sets), BINS)).astype(np.uint64))


def _sketch(tokens: np.ndarray) -> np.ndarray:
    return np.packbits((tokens >> np.uint64(40) & np.uint64(1)).astype(np.uint8), axis=1)


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches (rows of words) agree."""
    return BINS - np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _level(k: int) -> str:
    return f"tokens_{k}"


_LEVELS = [_level(k) for k in range(len(POOLS))]
#: Shingles whose tokens are found together.
TOGETHER = 1 << 20


def _profile(size: int):
    """n_shingles, set_key, sketch and tokens of each row; what else it has passes."""

    pools, names = POOLS, ["doc_id", FILE, AT, "n_shingles", "set_key", "sketch", *_LEVELS]

    def coordinates(sets: list[np.ndarray]) -> list[list[bytes | None]]:
        full = [k for k, s in enumerate(sets) if len(s)]
        out: list[list[bytes | None]] = [[None] * len(sets) for _ in range(1 + len(pools))]
        held, n = [], 0
        for last, k in enumerate(full, 1):
            held.append(k)
            n += len(sets[k])
            if n > TOGETHER or last == len(full):
                tokens = _minwise([sets[j] for j in held])
                cut = np.cumsum([0, *pools])
                for column, rows in enumerate([_sketch(tokens), *(np.ascontiguousarray(tokens[:, a:b].astype(np.uint16)) for a, b in zip(cut, cut[1:], strict=False))]):
                    for j, row in zip(held, rows, strict=True):
                        out[column][j] = row.tobytes()
                held, n = [], 0
        return out

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            sets = [_shingles(t, size) for t in batch["text"].to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *(pa.array(c, pa.binary()) for c in coordinates(sets))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch[FILE], batch[AT], *made], names)

    return profile


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    schema = f"doc_id long, {FILE} long, {AT} long, n_shingles long, set_key binary, sketch binary, " + ", ".join(f"{c} binary" for c in _LEVELS)
    return docs.mapInArrow(_profile(shingle), schema)


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


_NODES = "node long, rep long, component long, sketch binary"


def _rows(got: list[tuple[np.ndarray, np.ndarray]], rep: np.ndarray, component: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of node, rep, component and sketch of (row numbers, nodes)."""
    who, node = (np.concatenate(x) for x in zip(*got, strict=True))
    for at in range(0, len(node), 20_000):
        w = who[at : at + 20_000]
        s = np.ascontiguousarray(sketch[w])
        held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), len(s), [None, pa.py_buffer(s)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 20_000].view(np.int64)), pa.array(rep[w]), pa.array(component[w]), held], ["node", "rep", "component", "sketch"])


def _children(node: np.ndarray, tokens: np.ndarray, first: np.ndarray, second: np.ndarray, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their child nodes: by the first coordinate, and for a share of the nodes by the second one."""
    more = np.flatnonzero((mixed(node + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) < np.uint64(share * 2**32))
    out = []
    for at, who in ((first, np.arange(len(node))), (second, more)):
        at = at[who].astype(np.uint64)
        token = tokens[who, at.astype(np.int64)].astype(np.uint64)
        out.append((who, mixed(mixed(node[who] + at + np.uint64(1)) ^ token)))
    return out


def _plant(trees: int, share: float):
    pool = POOLS[0]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, rep, sketch = _matrix(batch[_level(0)], np.uint16, pool), batch["rep"].to_numpy(), _matrix(batch["sketch"], np.uint64, WORDS)
            for tree in range(trees):
                root = np.full(len(rep), mixed(np.asarray([tree + 1]))[0])
                first, second = np.full(len(rep), 2 * tree % pool), np.full(len(rep), (2 * tree + 1) % pool)
                # A tree has one root, so the share with a second coordinate is one of the trees.
                more = int((tree + 1) * share) > int(tree * share)
                yield from _rows(_children(root, tokens, first, second, 1.0)[: 1 + more], rep, rep, sketch)

    return plant


def _branch(level: int, share: float):
    """Of each class with its node, or the list of its nodes, the children in all of them: its tokens come once, in however many nodes it is.

    Its component comes and goes along; without one the class is its own.
    """
    pool = POOLS[level]

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, row = batch["node"], np.arange(batch.num_rows)
            if pa.types.is_list(node.type):
                row, node = np.repeat(row, node.value_lengths().to_numpy(zero_copy_only=False)), node.flatten()
            node = node.to_numpy().view(np.uint64)
            u = mixed(node + np.uint64(0x9E3779B97F4A7C15))
            first = u % np.uint64(pool)
            second = (first + np.uint64(1) + (u >> np.uint64(8)) % np.uint64(pool - 1)) % np.uint64(pool)
            got = _children(node, _matrix(batch[_level(level)], np.uint16, pool)[row], first, second, share)
            component = batch["component" if "component" in batch.schema.names else "rep"].to_numpy()
            yield from _rows(got, batch["rep"].to_numpy()[row], component[row], _matrix(batch["sketch"], np.uint64, WORDS)[row])

    return branch


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _exhaustive(agree: int):
    """Rows sorted by node: each with all later ones of its node that are not connected with it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches_of(batches), [None]):
            if batch is None:
                if held is not None:
                    yield _within(*held, agree)
                return
            now = (batch["node"].to_numpy(), batch["rep"].to_numpy(), batch["component"].to_numpy(), _matrix(batch["sketch"], np.uint64, WORDS))
            every = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            begin = np.searchsorted(every[0], every[0][-1])  # the last node may go on in the next batch
            if begin:
                yield _within(*(x[:begin] for x in every), agree)
            held = tuple(x[begin:] for x in every)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b for b in batches if b.num_rows)

    return compare


#: Nodes of more classes are compared one by one.
ALONE = 48


def _within(node: np.ndarray, rep: np.ndarray, component: np.ndarray, sketch: np.ndarray, agree: int) -> pa.RecordBatch:
    """Pairs of one node and different components whose sketches are alike enough."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.r_[starts, len(node)])
    for at, n in zip(starts[sizes > ALONE].tolist(), sizes[sizes > ALONE].tolist(), strict=True):
        order = at + np.argsort(component[at : at + n], kind="stable")
        r, c, s = rep[order], component[order], np.ascontiguousarray(sketch[order].T)
        ends = np.searchsorted(c, c, side="right")  # a class meets those of later components
        for i in np.flatnonzero(ends < n).tolist():
            e = ends[i]
            apart = np.bitwise_count(s[0, e:] ^ s[0, i])
            for word in s[1:]:
                apart = apart + np.bitwise_count(word[e:] ^ word[i])
            near = np.flatnonzero(apart <= BINS - agree)
            if len(near):
                right.append(r[e + near])
                left.append(np.full(len(near), r[i]))
    few = np.repeat(sizes <= ALONE, sizes)
    node, rep, component, sketch = node[few], rep[few], component[few], sketch[few]
    same, d = np.arange(max(0, len(node) - 1)), 1
    while len(same):
        same = same[node[same] == node[same + d]]
        i = same[component[same] != component[same + d]]
        i = i[_agreeing(sketch[i], sketch[i + d]) >= agree]
        left.append(rep[i])
        right.append(rep[i + d])
        d += 1
        same = same[same + d < len(node)]
    return _pairs(left, right)


def _star(agree: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _agreeing(_matrix(batch["sketch"], np.uint64, WORDS), _matrix(batch["head_sketch"], np.uint64, WORDS)) >= agree
                yield _pairs([batch["rep"].to_numpy()[near]], [batch["head"].to_numpy()[near]])

    return compare


def _bits(file: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return (mixed(mixed(file.view(np.uint64)) ^ at.view(np.uint64)) % np.uint64(size)).astype(np.int64)


def _filter_of(wanted: DataFrame, size: int) -> np.ndarray:
    """A bitmap of `size` bits (a multiple of 32,768) with a bit for each wanted row (FILE, AT); the driver gets its bytes, FILTER_BITS / 8 at most."""

    def bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits(batch[FILE].to_numpy(), batch[AT].to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["block", "bit"])

    def block(pdf):
        import pandas as pd

        held = np.zeros(32768, np.uint8)
        held[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(held).tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    marked = wanted.select(FILE, AT).mapInArrow(bit, "block long, bit long")
    for row in marked.groupBy("block").applyInPandas(block, "block long, bits binary").collect():
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _filter_size(wanted: DataFrame) -> int:
    return min(FILTER_BITS, 1 << max(15, int(FILTER_SHARE * wanted.count()).bit_length()))


def _thinned(sets: DataFrame, wanted: DataFrame, upper: bool) -> DataFrame:
    """Those of sets (rep, shingles) that are wanted (rep), and few others: what a bitmap lets through. With only the upper half of each hash, or whole. wanted may name a class more than once."""
    size = _filter_size(wanted)
    shared = sets.sparkSession.sparkContext.broadcast(_filter_of(wanted.select(F.col("rep").alias(FILE), F.lit(0).cast("long").alias(AT)), size))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            rep = batch["rep"].to_numpy()
            at = _bits(rep, np.zeros(len(rep), np.int64), size)
            batch = batch.filter(pa.array((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            if upper:
                half = [(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch["shingles"]]
                batch = pa.RecordBatch.from_arrays([batch["rep"], pa.array(half, pa.binary())], ["rep", "shingles"])
            yield batch

    return sets.select("rep", "shingles").mapInArrow(thin, "rep long, shingles binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, tasks: int) -> DataFrame:
    """A written table of rep and shingles for the wanted classes (rep, FILE, AT: a row that has the set). A bitmap thins the texts before they are cut into shingles."""
    size = _filter_size(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, size))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in trimmed(batches):
            at = _bits(batch[FILE].to_numpy(), batch[AT].to_numpy(), size)
            batch = batch.filter(pa.array((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([part[FILE], part[AT], pa.array([_shingles(t, shingle).tobytes() for t in part["text"].to_pylist()], pa.binary())], [FILE, AT, "shingles"])

    full = docs.select("text", FILE, AT).mapInArrow(sets, f"{FILE} long, {AT} long, shingles binary").join(wanted.select("rep", FILE, AT), [FILE, AT]).select("rep", "shingles")
    full = write_table(full, "near-sets", tasks=tasks)
    shared.unpersist()
    return full


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets are similar enough."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays share, each as often as both have it."""
    values, at = np.unique(x, return_index=True)
    times = np.diff(np.r_[at, len(x)])
    return int(np.minimum(times, np.searchsorted(y, values, "right") - np.searchsorted(y, values, "left")).sum())


def _chance(n: int, m: int) -> int:
    """More halves than this agree by chance in sets of n and m hashes with a probability under 2**-60."""
    rate, k = n * m / 2.0**32, 0
    if rate > 1:
        return int(2 * rate) + 64
    tail = rate
    while tail > 2.0**-60:
        k += 1
        tail *= rate / (k + 1)
    return k


def _verdict(x: np.ndarray, y: np.ndarray, percent: int) -> int:
    """From the upper halves of two sets' hashes: 0 not similar enough, 2 similar enough, 1 only the full hashes can tell."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return 0
    most = _shared(x, y)
    least = most - _chance(len(x), len(y))
    return int(100 * most >= percent * (len(x) + len(y) - most)) + int(100 * least >= percent * (len(x) + len(y) - least))


class _Links:
    """Confirmed links between classes, what they connect, and the sets that were read for that."""

    def __init__(self, docs: DataFrame, reps: DataFrame, shingle: int, percent: int, tasks: int) -> None:
        self.docs, self.reps, self.shingle, self.percent, self.tasks = docs, reps, shingle, percent, tasks
        self.sets: DataFrame | None = None
        #: a, b: what has been tried.
        self.tried: DataFrame | None = None
        #: node, component: every class that has a link, with the smallest class that its links lead to.
        self.components: DataFrame | None = None

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """rep, shingles of the classes (rep) and maybe of others; texts are read only for those not read yet."""
        missing = ids if self.sets is None else ids.join(self.sets.select("rep"), "rep", "left_anti")
        missing = write_table(missing.join(self.reps.select("rep", FILE, AT), "rep"), "near-missing", tasks=self.tasks)
        if not missing.isEmpty():
            more = _sets_of(self.docs, missing, self.shingle, self.tasks)
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def confirm(self, pairs: DataFrame) -> None:
        """Link those of pairs (a, b) whose full sets are similar enough and that were not tried before: by the upper halves of the hashes, by all of them where these leave a doubt."""
        pairs = pairs.distinct()
        pairs = write_table(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "near-pairs", tasks=self.tasks)
        if pairs.isEmpty():
            return
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        percent = self.percent

        def judged(dtype, verdict):
            def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    sets = zip(batch["x"], batch["y"], strict=True)
                    good = pa.array([int(verdict(np.frombuffer(x.as_buffer(), dtype), np.frombuffer(y.as_buffer(), dtype), percent)) for x, y in sets], pa.int32())
                    out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], good], ["a", "b", "good"])
                    yield out.filter(pa.compute.greater(good, 0))

            return judge

        def both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
            x, y = (sets.select(F.col("rep").alias(end), F.col("shingles").alias(name)) for end, name in (("a", "x"), ("b", "y")))
            return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

        def ends(pairs: DataFrame) -> DataFrame:
            return pairs.select(F.explode(F.array("a", "b")).alias("rep"))

        full = self.sets_of(ends(pairs).distinct())
        seen = write_table(both(pairs, _thinned(full, ends(pairs), True)).mapInArrow(judged(np.uint32, _verdict), "a long, b long, good int"), "near-judged", tasks=self.tasks)
        links, doubtful = seen.where("good = 2").select("a", "b"), seen.where("good = 1").select("a", "b")
        if not doubtful.isEmpty():
            links = links.unionByName(both(doubtful, _thinned(full, ends(doubtful), False)).mapInArrow(judged(np.uint64, _linked), "a long, b long, good int").select("a", "b"))
        self.add(write_table(links, "near-links", tasks=self.tasks))
        drop_table(seen)

    def add(self, links: DataFrame) -> None:
        """Connect what new links (a, b) connect: they join components that are there already."""
        if self.components is None:
            self.components = connected_components(links, self.tasks)
            return
        was = self.components
        for end in ("a", "b"):
            links = links.join(was.select(F.col("node").alias(end), F.col("component").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        links = write_table(links.where("a <> b"), "near-links", tasks=self.tasks)
        if links.isEmpty():
            return
        joined = connected_components(links, self.tasks)
        moved = was.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        self.components = write_table(moved.unionByName(joined.join(was.select("node"), "node", "left_anti").select("node", "component")), "near-components", tasks=self.tasks)

    def with_component(self, rows: DataFrame) -> DataFrame:
        if self.components is None:
            return rows.withColumn("component", F.col("rep"))
        return rows.join(self.components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _blocked(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows (node, component, n_shingles, ...) of nodes that are not connected yet, with their node's number of blocks, from its n and shingles."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(sizes.where("low < high").select("node", blocks.cast("int").alias("blocks")), "node")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with their block, copied to each pair of blocks (one, two) of their node that it is in."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("one", F.least("block", "to")).withColumn("two", F.greatest("block", "to")).drop("to", "blocks")


def _in_blocks(found: _Links, nodes: DataFrame, percent: int, agree: int) -> DataFrame:
    """Links between the classes of each node that are not connected yet, by blocks and on full sets. nodes: node, rep, sketch.

    Two classes that meet in several of the nodes are compared in the first of these.
    """
    import pandas as pd

    tasks = found.tasks
    # A class is in as many nodes as trees and branches lead to, however large these are. It meets what it has in common in all of them once.
    classes = nodes.groupBy("rep").agg(F.collect_list("node").alias("nodes"), F.first("sketch").alias("sketch"))
    classes = found.with_component(classes).join(found.reps.select("rep", "n_shingles"), "rep")
    held = write_table(classes.select(F.explode("nodes").alias("node"), "rep", "component", "n_shingles", "sketch"), "near-blocks", tasks=tasks)
    every = write_table(_blocked(held, F.ceil(F.col("n") / BLOCK)), "near-blocks", tasks=tasks)
    drop_table(held)

    def alike(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two, comp, block = int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0]), pdf["component"].to_numpy(), pdf["block"].to_numpy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(-1, WORDS)
        right, hit = np.flatnonzero(block == two), np.zeros(len(pdf), bool)
        for i in np.flatnonzero(block == one).tolist():
            near = right[(right > i) & (comp[right] != comp[i])] if one == two else right[comp[right] != comp[i]]
            near = near[_agreeing(sketch[near], sketch[i]) >= agree]
            hit[near] = True
            hit[i] |= len(near) > 0
        return pdf.loc[hit, ["node", "rep"]]

    # Sets are large and sketches small: only classes whose sketch is like one of another component need their sets.
    hits = _dealt(every.drop("n_shingles")).groupBy("node", "one", "two").applyInPandas(alike, "node long, rep long").distinct()
    near = write_table(every.drop("blocks").join(hits, ["node", "rep"], "left_semi"), "near-blocks", tasks=tasks)
    drop_table(every)
    if near.isEmpty():
        return near.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    rows = write_table(_blocked(near, F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))), "near-blocks", tasks=tasks)
    drop_table(near)
    classes = rows.groupBy("rep").agg(F.collect_list(F.struct("node", "blocks")).alias("places"), *(F.first(c).alias(c) for c in ("component", "sketch")))
    full = _thinned(found.sets_of(rows.select("rep").distinct()), rows.select("rep"), False)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        here, one, two = int(pdf["node"].iloc[0]), int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
        rep, comp, block = pdf["rep"].to_numpy(), pdf["component"].to_numpy(), pdf["block"].to_numpy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(-1, WORDS)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        nodes = np.full((len(pdf), max(map(len, pdf["nodes"]))), np.iinfo(np.int64).max)
        for k, x in enumerate(pdf["nodes"]):
            nodes[k, : len(x)] = x
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b = [], []
        for i in left.tolist():
            near = right[(right > i) & (comp[right] != comp[i])] if one == two else right[comp[right] != comp[i]]
            near = near[_agreeing(sketch[near], sketch[i]) >= agree]
            if not len(near):
                continue
            before = nodes[i][nodes[i] < here]
            near = near[~np.isin(nodes[near], before).any(axis=1)]
            for j in near.tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and _linked(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    a.append(min(rep[i], rep[j]))
                    b.append(max(rep[i], rep[j]))
        return pd.DataFrame({"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64)})

    # A class meets its set once, and is copied to its nodes and to pairs of their blocks only then.
    rows = classes.join(full, "rep").select("*", F.sort_array("places.node").alias("nodes"), F.explode("places").alias("place"))
    rows = _dealt(rows.select("place.*", "rep", "component", "sketch", "shingles", "nodes"))
    return rows.groupBy("node", "one", "two").applyInPandas(compare, "a long, b long")


def _joined(docs: DataFrame, shingle: int, percent: int, trees: int) -> DataFrame:
    """docs: doc_id, text, FILE, AT. doc_id, FILE, AT, n_shingles, first_id (the smallest doc_id of the row's component), component (null without shingles)."""
    share, alike = GROWTH * 100 / percent - 1, (1 + percent / 100) / 2  # equal tokens agree in their bit, others in half of the cases
    agree = max(1, int(BINS * alike - SLACK * (BINS * alike * (1 - alike)) ** 0.5))
    profiles = write_table(_profiles(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "near-profiles")
    tasks = writers(profiles.count())
    # A class is named after one of its rows.
    classes = write_table(profiles.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id")), "near-classes", tasks=tasks)
    tokens = [F.when(F.col("row") == F.col("rep"), F.col(c)).alias(c) for c in ("sketch", *_LEVELS)]
    members = write_table(profiles.where("n_shingles > 0").join(classes, "set_key").select("doc_id", FILE, AT, "rep", "row", "n_shingles", "first_id", *tokens), "near-members", tasks=tasks)
    reps = members.where("row = rep")
    found = _Links(docs, reps, shingle, percent, tasks)

    active = write_table(reps.select("rep", "sketch", _level(0)).mapInArrow(_plant(trees, share), _NODES), "near-nodes")
    picked = F.min_by("rep", F.xxhash64("node", "rep"))
    for level in range(1, len(POOLS) + 1):
        if found.components is None:
            sizes = active.groupBy("node").agg(F.count("*").alias("n"), picked.alias("head")).withColumns({"square": F.col("n"), "head_component": F.col("head"), "parts": F.col("n")})
        else:
            parts = active.groupBy("node", "component").agg(F.count("*").alias("c"), picked.alias("head"))
            sizes = parts.groupBy("node").agg(F.sum("c").alias("n"), F.min_by("head", F.xxhash64("node", "head")).alias("head"), F.sum(F.col("c") * F.col("c")).alias("square"), F.min_by("component", F.xxhash64("node", "head")).alias("head_component"), F.count("*").alias("parts"))
        work = F.col("n") * F.col("n") - F.col("square")
        kind = F.when(work <= FEW * F.col("n"), "small").when((work <= MANY * F.col("n")) & (level > 1), "dense").otherwise("large")
        open_nodes = sizes.where("parts > 1").select("node", "head", "head_component", kind.alias("kind"))
        live = write_table(active.join(open_nodes, "node").select("node", "rep", "component", "sketch", "kind", "head", "head_component"), "near-live", tasks=tasks)
        drop_table(active)
        large, kinds = live.where("kind = 'large'"), {r.kind for r in live.select("kind").distinct().collect()}
        small = live.where("kind = 'small'").select("node", "rep", "component", "sketch").repartition("node").coalesce(tasks).sortWithinPartitions("node", "rep")
        candidates = small.mapInArrow(_exhaustive(agree), "a long, b long")
        if "large" in kinds:
            heads = large.where("rep = head").select("head", F.col("sketch").alias("head_sketch")).dropDuplicates(["head"])
            star = large.where("component <> head_component").select("rep", "head", "sketch").join(heads, "head")
            candidates = candidates.unionByName(star.mapInArrow(_star(agree), "a long, b long"))
        found.confirm(candidates)
        last = level == len(POOLS)
        if "dense" in kinds or ("large" in kinds and last):
            dense = live.where("kind = 'dense' OR kind = 'large'") if last else live.where("kind = 'dense'")
            found.add(write_table(_in_blocks(found, dense.select("node", "rep", "sketch"), percent, agree), "near-links", tasks=tasks))
        if "large" not in kinds or last:
            break
        # A class is in few nodes: trees times GROWTH for each level. What is connected does not change until the next level compares.
        within = found.with_component(large.groupBy("rep").agg(F.collect_list("node").alias("node")))
        active = write_table(within.join(reps.select("rep", "sketch", _level(level)), "rep").mapInArrow(_branch(level, share), _NODES), "near-nodes", tasks=tasks)
        drop_table(live)

    every = members.select("doc_id", FILE, AT, "rep", "n_shingles", "first_id")
    bare = profiles.where("n_shingles = 0").select("doc_id", FILE, AT, F.lit(None).cast("long").alias("rep"), "n_shingles", F.col("doc_id").alias("first_id"))
    if found.components is None:
        return every.withColumn("component", F.col("rep")).unionByName(bare.withColumn("component", F.lit(None).cast("long"))).drop("rep")
    named = found.components.join(reps.select(F.col("rep").alias("node"), "first_id"), "node")
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_first"))
    linked = write_table(found.components.join(firsts, "component"), "near-components", tasks=tasks)
    out = every.unionByName(bare).join(linked, F.col("rep") == F.col("node"), "left")
    named = F.when(F.col("node").isNotNull(), F.col("component_first")).otherwise(F.col("first_id"))
    return out.select("doc_id", FILE, AT, "n_shingles", named.alias("first_id"), F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked at 100 * |intersection| >= percent * |union| of their `shingle`-word sets. percent: 60 to 100.
    """
    every = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))[1]
    found = _joined(every.where("doc_id IS NOT NULL"), shingle, percent, trees)
    out = found.select("doc_id", "n_shingles", F.col("first_id").alias("component_id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(_shingles(t, shingle)) for t in batch["text"].to_pylist()], pa.int64())], ["n_shingles"])

    unnamed = every.where("doc_id IS NULL").select("text").mapInArrow(counted, "n_shingles long")
    null = F.lit(None).cast("long")
    out = out.unionByName(unnamed.select(null.alias("doc_id"), "n_shingles", null.alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """The first row of each component of docs, by doc_id, rows without one last, then by place; with all columns of docs."""
    docs, every = numbered(docs)
    found = _joined(every.select(F.col("doc_id").cast("long").alias("doc_id"), "text", FILE, AT), shingle, percent, trees)
    # A text without shingles is linked with nothing; of several rows of a first doc_id the first by place stays.
    first = found.where(F.col("component").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first_id")))
    place = F.min(F.struct(FILE, AT)).alias("place")
    kept = first.groupBy("component").agg(place).select("place.*").unionByName(found.where("component IS NULL").select(FILE, AT))
    return only(every, kept)
