"""The tree of conversations against one that is built turn by turn in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from corpusloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in turns:
        h, sign = zlib.crc32(str(c).encode()) % 4, -1 if c < 0 else 1
        base = c - sign * (abs(c) % 20)
        paths[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    saved, leaves = defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        own_saved = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own_saved
            leaves[path[:d]] += not children[path]
    return sorted(
        (min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path], leaves[path], saved[path], hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest())
        for path, who in members.items()
    )


def tree(spark, rows, schema=SCHEMA):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema))
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def conversations(seed, n, longest, texts="abc"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 200), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([turn, turn, turn, None, 1]), rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else ["user", "assistant"][turn % 2], rng.choice([None, "", *texts, "two words"]) if rng.random() < 0.3 else texts[0]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [1, 16])
def test_as_built_turn_by_turn(spark, monkeypatch, bits):
    """Nulls, ties and repeated rows; with blocks of two turns, a conversation runs over many."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    rows = conversations(bits, 60, 9)
    assert tree(spark, rows) == brute(rows)


def test_chains_hang_deep(spark):
    """Each conversation leaves the one before it one turn further down; equal ones own nothing; one goes on for long."""
    rows = [(20 * k, t, "user", f"{t}" if t < k else f"{t} of {k}") for k in range(12) for t in range(k + 2)]
    rows += [(20 * k + 400, t, "user", f"{t}" if t < k else f"{t} of {k}") for k in range(12) for t in range(k + 2)]
    rows += [(1000, t, "user", f"{t}") for t in range(300)]
    assert tree(spark, rows) == brute(rows)


def test_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(c, 0, "user", "the same") for c in range(0, 4000, 20)] + [(c, 1, "user", "more") for c in range(0, 4000, 60)]
    assert tree(spark, rows) == brute(rows)


def test_no_turns_left(spark):
    """Conversations whose own turns are all replaced, while there is nothing to replace them by, end at the root."""
    bare = [c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    rows = [(c, t, "user", "x") for c in bare for t in range(2)]
    assert tree(spark, rows) == brute(rows)
    rows.append((1, 0, "user", "y"))
    assert tree(spark, rows) == brute(rows)


def test_odd_tables(spark):
    assert tree(spark, []) == []
    assert tree(spark, [(None, 1, "user", "a")]) == []
    rows = [(5, 2, "user", "a b\x0bc d"), (5, None, None, None), (None, 0, "user", "a"), (9, 1, "user", "word " * 300_000)]
    assert tree(spark, rows) == brute(rows)
    names = SCHEMA + ", depth int, digest string, words string, _block int, owner long, length string"
    assert tree(spark, [(*r, 7, "x", None, 3, 1, "l") for r in rows], names) == brute(rows)
