"""The prefix trie of conversations against a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from pageline.llm import conversations
from pageline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    told = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(told[x][0] for x in children[node]) or 1
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(told[x][1] for x in children[node])
        told[node] = leaves, saved
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(full[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), *told[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-12, 3 * n), n):
        base = rng.choice((0, 1, 1, 1, 2))
        for t in range(rng.choice((1, 2, 3, 5, 12))):
            text = f"common {base} {t}" if rng.random() < 0.8 else rng.choice((None, "", "é", f"own {c} {t}"))
            rows.append((c, rng.choice((t, t, t, None)), rng.choice(("user", "user", "user", None, "")), text))
    rows += [(1000, t, "user", "same") for t in range(14)] + [(1001, t, "user", "same") for t in range(14)] + [(None, 1, "user", "none"), (1003, 3, "a", "tie"), (1003, 3, "b", "tie"), (1003, 3, "b", "tie")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", (5, conversations.BLOCK))
def test_trie_against_brute_force(spark, save, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = made(12, 60)
    assert found(QUERIES["op12_conversation_trie"](spark, save(conversations=spark.createDataFrame(rows, SCHEMA)))) == plain(rows)


def test_copies_of_one_conversation_share_one_path(spark, save):
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    got = found(QUERIES["op12_conversation_trie"](spark, save(conversations=spark.createDataFrame(rows, SCHEMA))))
    assert got == plain(rows) and [r[3] for r in got] == [400] * 4


def test_small_and_empty_tables(spark, save):
    for rows in ([], [(None, 1, "a", "b")], [(7, None, None, None)], [(5, 1, "a", "b")], [(4, 1, "a", "x"), (9, 1, "a", "x")]):
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS name", "3 AS pos", "4 AS key")
        assert found(QUERIES["op12_conversation_trie"](spark, save(conversations=df))) == (plain(rows) if any(r[0] is not None for r in rows) else [])


def test_blocks_of_ids_join_to_the_digest_of_the_whole_list(monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 7)
    ids = {b"a": list(range(0, 3000, 3)), b"b": [5], b"c": [-3, -1, 10**12]}
    rows = [(n, c) for n, v in ids.items() for c in v]
    cut = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.binary()), pa.array([r[1] for r in x], pa.int64())], ["name", "conv_id"]) for x in (rows[:10], rows[10:1001], rows[1001:])]
    packed = list(conversations._pack(iter(cut)))
    assert sum(b.num_rows for b in packed) > 300
    got = [r for b in conversations._digest(iter(packed)) for r in b.to_pylist()]
    assert got == [{"name": n, "ends_sha256": hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()} for n, v in ids.items()]
