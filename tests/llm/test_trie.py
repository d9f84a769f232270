"""Prefix trie against a plain trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from marketlake.llm import prefix_trie
from marketlake.llm.queries import SQL

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string"


def made(seed, convs=130, hot=True):
    """Conversations with shared openings, whole copies, tied and null turns, repeated rows."""
    r = random.Random(seed)
    rows, pool = [], ["a", "b", "Ä😀", None, "", "long text here"]
    for c in r.sample(range(-150, 420), convs):
        size = r.choice([1, 1, 2, 3, 5, 7, 9])
        same = hot and r.random() < 0.4
        for k in range(size):
            turn = None if r.random() < 0.05 else (k if r.random() < 0.9 else 0)
            rows.append((c, k if same else turn, "user" if same else r.choice(["user", "bot", None]), "hello" if same else r.choice(pool), 1, "x"))
    rows += rows[:3] + [(None, 0, "user", "lost", 1, "x")]
    return rows


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            text = text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 6, c - abs(c) % 100 * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(rest, [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if full[c] == node))).encode()).hexdigest()) for node, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize(("seed", "range_rows", "block_turns"), [(1, 10**6, 10**6), (2, 11, 10**6), (3, 40, 6), (4, 10**6, 1), (5, 5, 17)])
def test_equals_a_plain_trie(spark, seed, range_rows, block_turns):
    rows = made(seed, hot=seed != 5)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(table, range_rows, block_turns)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_sql_equals_a_plain_trie(spark):
    rows = made(6)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    found = con.execute(f"select {', '.join(COLUMNS)} from ({SQL['op12_prefix_trie']})").fetchall()
    assert sorted(found, key=repr) == sorted(plain(rows), key=repr)


def test_empty_table_and_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = [(c, 0, "user", "x", 1, "x") for c in range(101, 140)]  # their base does not exist: most are left without turns
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(lone, SCHEMA)).collect()), key=repr) == sorted(plain(lone), key=repr)


def test_one_very_long_conversation(spark):
    rows = [(1, k, "user", str(k % 7), 1, "x") for k in range(20_000)] + [(2, k, "user", str(k % 7), 1, "x") for k in range(9_000)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 1, 100)
    deepest = 20_000 - zlib.crc32(b"1") % 6
    assert got.agg({"depth": "max"}).first()[0] == deepest and got.where("conv_id = 1").count() >= deepest
