"""The prefix trie of conversations against a plain trie, and against its SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tidewater.llm import conversation_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def _order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _brute(rows):
    turns = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=_order):
        turns[r[0]].append((r[2] or "", r[3] or ""))
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(p))
        out[(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def _got(df, **more):
    return Counter(tuple(r[c] for c in COLUMNS) for r in conversation_trie.prefix_trie(df, **more).collect())


def _random_rows(seed: int) -> list[tuple]:
    """Few roles and texts, so that prefixes are shared within and across families; nulls, ties, gaps and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-12, 400), 150):
        n = rng.choice([1, 1, 2, 3, 5, 9, 14])
        rows += [(c, rng.choice([None, *range(6)]) if rng.random() < 0.1 else i, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["a", "b", "é", "", None]) if i > 1 else "a") for i in range(n)]
    return [*rows, *rows[:5], (None, 0, "user", "x")]


@pytest.mark.parametrize("most", [conversation_trie.NODES, 3])
def test_trie_equals_brute_force(spark, most):
    for seed in (1, 2):
        rows = _random_rows(seed)
        assert _got(spark.createDataFrame(rows, SCHEMA), most=most) == _brute(rows)


def test_trie_of_a_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = _brute([tuple(r) for r in df.collect()])
    assert _got(df) == want
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    sql = con.execute(conversation_trie.ORACLE).fetchall()
    assert Counter(sql) == want


def test_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 16)
    rows = [(5, i, "user", f"t{i}") for i in range(300)] + [(8, i, "user", f"t{i}") for i in range(300)] + [(40, i, "user", f"t{i}") for i in range(150)]
    rows += [(c, 0, "user", "t0") for c in range(100, 400)]  # one conversation repeated under many ids
    assert _got(spark.createDataFrame(rows, SCHEMA), most=20) == _brute(rows)


def test_other_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = _random_rows(3)
    clash = {c: F.lit("clash") for c in ("base", "conv", "name", "parent", "depth", "members", "ends", "digest", "bytes", "saved", "a.b")}
    assert _got(spark.createDataFrame(rows, SCHEMA).withColumns(clash)) == _brute(rows)
    assert _got(spark.createDataFrame([], SCHEMA)) == Counter()
    assert _got(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == Counter()
