import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import rows_of
from tickerloom.llm import prefix_trie
from tickerloom.llm.prefix_trie import conversation_trie, find_close, parentheses, parents, subtree_ends

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "e") for r in rows], "conv_id long, turn long, role string, text string, depth int, entry string")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """The contract by plain dictionaries."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members, parent = {}, {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in kids.get(node, []))
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), up, len(cs), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, convs=40, most=14, words=2):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 120), convs):
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hé", "", None, "abc"][: words + 1])) for t in range(rng.randint(1, most))]
    return rows


def same(spark, rows):
    assert rows_of(conversation_trie(frame(spark, rows)), *COLUMNS) == brute(rows)


@pytest.mark.parametrize("band, final", [(64, 100_000), (3, 100_000), (2, 40)])
def test_equals_brute_force(spark, monkeypatch, band, final):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "SUPER", 2)
    monkeypatch.setattr(prefix_trie, "FINAL", final)
    monkeypatch.setattr(prefix_trie, "SPINE_SHARD", 80)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if band == 3 else "25")
    try:
        same(spark, made(band))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    assert conversation_trie(frame(spark, [])).collect() == []
    assert conversation_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
    same(spark, [(1, None, None, None), (1, None, "user", "x" * 100_000), (1, 3, "user", "a"), (1, 3, "user", "a"), (1, 3, "assistant", "a"), (None, 0, "user", "b")])
    # Turnless: the base is absent and the own turns go.
    lonely = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    same(spark, [(lonely, t, "user", "x") for t in range(3)])
    same(spark, [(lonely, t, "user", "x") for t in range(3)] + [(7, 0, "user", "y"), (5, 0, "user", "z")])


def test_copies_share_every_node(spark):
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(300) for t in range(4)]
    got = conversation_trie(frame(spark, rows)).collect()
    assert sorted((r["depth"], r["n_convs"], r["n_leaves"]) for r in got) == [(d, 300, 1) for d in range(5)]
    same(spark, rows)


def test_long_conversation_is_numbered_across_tasks(spark):
    rows = [(10, t, "user", f"{t % 7}") for t in range(500)] + [(c, t, "user", f"{t % 7}") for c in (11, 12, 20) for t in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_parentheses_equal_a_stack():
    rng = random.Random(3)
    for n in (1, 2, 5, 300, 5000):
        depth = [0]
        while len(depth) < n:
            depth.append(rng.randint(0, depth[-1] + 1) if rng.random() < 0.4 else depth[-1] + 1)
        depth = np.array(depth)
        bits, opens = parentheses(depth)
        stack, close, up, node = [], np.zeros(n, int), np.full(n, -1), 0
        for i, b in enumerate(bits):
            if b > 0:
                up[node] = stack[-1] if stack else -1
                stack.append(node)
                node += 1
            else:
                close[stack.pop()] = i
        assert not stack and (find_close(np.cumsum(bits), opens, 100) == close).all() and (parents(depth) == up).all()
        ends, pair = subtree_ends(depth)
        assert (ends == [next((j for j in range(i + 1, n) if depth[j] <= depth[i]), n) for i in range(n)]).all()
        assert (pair == (ends == np.arange(n) + 1)).all()
