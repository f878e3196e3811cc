"""The conversation trie against plain Python and SQL."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from taxloom.llm import queries, tries
from tests.llm.plain import SPACED, sha

TALKS = "conv_id long, turn long, role string, text string, a int, depth string, block int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    talks = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in talks.items()}
    made = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = talks.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [(k, m) for k, m in nodes.items() if k[:len(key)] == key]
        child = [k for k in nodes if len(k) == len(key) + 1 and k[:-1] == key]
        leaves = sum(not any(len(o) == len(k) + 1 and o[:-1] == k for o, _ in under) for k, _ in under)
        saved = sum((len(m) - 1) * len(SPACED.findall(k[-1][1])) for k, m in under if k)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(child), leaves, saved, sha(ends)))
    return sorted(out, key=repr)


def sample(seed, convs=60):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "lost", 1, "x", 2), (7, None, None, None, 1, "x", 2), (7, None, "user", "first", 1, "x", 2), (-3, 2, "user", "minus", 1, "x", 2), (-20, 1, "user", "minus", 1, "x", 2)]
    for c in rng.sample(range(120), convs):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t // 2]), rng.choice(["user", "assistant"]), rng.choice(["hi there", "ok", "a b\nc", ""]), 1, "x", 2))
    for t in range(90):
        rows.append((200, t, "user", f"long {t % 3}", 1, "x", 2))
    return rows + rows[5:9]


@pytest.mark.parametrize("limit", [3, 40, 8192])
def test_trie_is_that_of_the_definition(spark, limit, monkeypatch):
    monkeypatch.setattr(tries, "TURNS", 16)
    monkeypatch.setattr(tries, "IDS", 5)
    rows = sample(limit)
    got = tries.conversation_trie(spark.createDataFrame(rows, TALKS).repartition(3), limit=limit)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain(rows)


def test_copies_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", f"the same {t}") for c in range(100) for t in range(4)]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in tries.conversation_trie(spark.createDataFrame(rows, schema), limit=20).collect()), key=repr) == plain(rows)
    for few in ([], [(None, 1, "user", "x")]):
        assert tries.conversation_trie(spark.createDataFrame(few, schema)).count() == 0


@pytest.mark.parametrize("n,seed", [(1, 1), (2, 2), (50, 3), (400, 4)])
def test_centroid_totals(n, seed):
    rng = np.random.default_rng(seed)
    parent = np.array([-1 if v == 0 or rng.random() < 0.02 else int(rng.integers(max(0, v - int(rng.choice([1, 2, 50]))), v)) for v in range(n)])
    shuffled = rng.permutation(n)
    moved = np.empty(n, dtype=np.int64)
    moved[shuffled] = np.where(parent >= 0, shuffled[parent], -1)
    own, values = rng.integers(1, 5, n), rng.integers(-9, 9, (n, 2))
    weight, sums = own.copy(), values.copy()
    for v in range(n):  # plain: every node into all nodes above it
        up = moved[v]
        while up >= 0:
            weight[up] += own[v]
            sums[up] += values[v]
            up = moved[up]
    assert (tries.centroid_totals(moved, weight, values, np.zeros((n, 2), dtype=np.int64)) == sums).all()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = queries.QUERIES["op11_conversation_trie"](spark, sf)
    expected = con.execute(queries.ORACLE["op11_conversation_trie"])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(expected.fetchall(), key=repr)
    assert re.fullmatch("[0-9a-f]{64}", got.first()["ends_sha256"])
