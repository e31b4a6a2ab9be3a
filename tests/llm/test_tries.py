"""The trie of conversations against plain Python, at several sizes of its containers."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from plumbline.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string, `a.b` int"


def plain(rows):
    """All nodes by brute force: {(conv_id, depth): the other columns}."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, name, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 4, c % 20 if c >= 0 else -(-c % 20)
        paths[c] = own.get(c - rest, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out = {}

    def visit(node):
        parts = [visit(child) for child in below[node]]
        saved = (len(members[node]) - 1) * len((node[-1][1] if node else "").split()) + sum(p[1] for p in parts)
        leaves = sum(p[0] for p in parts) or 1
        ends = ",".join(str(c) for c in sorted(members[node]) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node)] = (parent, len(members[node]), len(parts), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if paths:
        visit(())
    return out


def found(frame):
    rows = frame.collect()
    nodes = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(nodes) == len(rows)
    return nodes


def odd_rows():
    random_ = random.Random(3)
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, None, None, None), (0, 1, "user", "a b  c"), (0, 1, "", "a b  c"), (1, 2, "user", "a b  c"),
        (40, 0, "user", "x" * 40_000 + " y"), (41, 0, "user", "only"), (-5, 0, "user", "a b  c"), (-20, 3, "assistant", "naïve Σας  x\n"),
    ]
    # a third of all turns in one conversation, and many conversations that are equal
    rows += [(60, i, "user", f"t{i % 7}") for i in range(150)]
    rows += [(c, i, "user", f"same {i}") for c in range(100, 160) for i in range(6)]
    rows += [(c, i, random_.choice(["user", None]), random_.choice(["p", "q r", ""])) for c in range(200, 260) for i in range(random_.randint(1, 6))]
    return rows


@pytest.mark.parametrize("limit", [1, 7, 60, 400, tries.LIMIT])
def test_nodes(spark, limit, monkeypatch):
    monkeypatch.setattr(tries, "STRETCH", 16 if limit < 100 else 65_536)
    monkeypatch.setattr(tries, "PIECE", 5 if limit < 100 else 8_192)
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], SCHEMA).repartition(5)
    assert found(tries.prefix_trie(tries.rebuilt_turns(table), limit)) == plain(rows)


def test_no_conversations(spark):
    table = spark.createDataFrame([(None, 1, "user", "x", 1, "n", 2)], SCHEMA)
    assert found(tries.prefix_trie(tries.rebuilt_turns(table))) == {} == plain([])
    assert found(tries.prefix_trie(tries.rebuilt_turns(table.where("false")), 1)) == {}


def test_whole_table_with_small_containers(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert found(tries.prefix_trie(tries.rebuilt_turns(table), 40)) == plain(rows)
