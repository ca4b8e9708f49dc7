import hashlib
import random
import re
import zlib

import pytest

from meridia.llm import trie
from meridia.llm.oracles import OP12
from tests.oracle import expected, rows

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, part string"


def brute(data):
    """The contract, conversation by conversation."""
    own = {}
    for c, t, role, text, *_ in data:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, data):
    out = trie.conversation_trie(spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def branching(seed, convs=60, long=0):
    rng = random.Random(seed)
    data = []
    for c in range(convs):
        if rng.random() < 0.1:
            continue
        turns = rng.choice([1, 2, 3, 4, 9]) if c != 21 or not long else long
        for t in range(turns):
            data.append((c, t, rng.choice(["user", "assistant"]) if t > 4 else "user", rng.choice(["a b", "a b", "a b", "c\td e", ""])))
    rng.shuffle(data)
    return data


AWKWARD = [
    (0, None, None, None), (0, 0, "user", "one two"), (0, 0, "user", "one two"), (0, 1, "user", "x"), (1, 5, "user", None), (1, 5, None, "b"), (1, 5, None, "a"),
    (7, 1, "user", "only"), (None, 1, "user", "nobody"), (27, 1, "user", "no base"), (27, 2, "user", " \n "), (1 << 40, 1, "u", "w " * 5000), ((1 << 40) + 1, 1, "u", "w"),
]


@pytest.mark.parametrize("data", [AWKWARD, [], [(3, 1, "user", "hi")], branching(1), branching(2)], ids=["awkward", "empty", "one", "first", "second"])
def test_trie_matches_brute_force(spark, data):
    assert found(spark, data) == brute(data)


def test_long_conversations_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "CHUNK", 2)
    data = branching(3, 45, long=40) + [(c, t, "user", "a b") for c in range(100, 130) for t in range(12)]
    assert found(spark, data) == brute(data)


def test_chains_that_change_along_a_heavy_path(spark):
    """A smaller id leaves the heavy path at every depth, so the path passes through many chains."""
    data = [(c, t, "user", "w" if t < c // 20 or c == 2000 else f"own {c}") for c in range(0, 2001, 20) for t in range(c // 20 + 1)]
    data += [(c, t, "user", "w") for c in range(2020, 2080, 20) for t in range(101)]
    assert found(spark, data) == brute(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_matches_its_sql(spark, sf):
    df = trie.op12_heavy_path_trie(spark, f"/root/testdata/{sf}")
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected(OP12, f"/root/testdata/{sf}")
