"""The prefix trie against brute force over all prefixes: shared turns, long and turnless conversations, copies, nulls and ties."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from weekgrain.llm import catalog, prefix_trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, d int, name string, n_convs int, base string"


def digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows, group=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, totals = set(), {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(totals[k][0] for k in kids[p]) or (not kids[p]), saved + sum(totals[k][1] for k in kids[p]))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(seqs[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out.add((min(members[p]), len(p), up, len(members[p]), len(kids[p]), int(totals[p][0]), totals[p][1], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, n, most, kinds):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c * 3 - 20, t, rng.choice(["user", None, ""]) if t % 2 else "bot", f"é{rng.randrange(kinds)}" * (t % 3 + 1)) for t in range(rng.randrange(1, most))]
    return rows


ODD = [
    (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (1, 0, None, "tie"), (2, 5, None, None), (3, 1, "", ""), (None, 1, "user", "lost"), (None, None, None, None),
    (-7, 0, "user", "below"), (-5, 0, "user", "base below"), (-5, 1, "bot", "x"), (9_000_000_000, 0, "user", "second"), (10, 0, "user", "a"), (10, 1, "bot", "b"), (10, 2, "user", "c" * 3000),
    (11, 0, "user", "a"), (12, 0, "user", "z"), (13, 0, "u", "sera"), (14, 0, "us", "era"), (15, 0, "user", "a"), (15, 1, "bot", "b"),
]
COPIES = [(c, t, "user", f"turn {t}") for c in range(100, 400) for t in range(6)] + [(c, 6, "user", f"own {c}") for c in range(100, 160)]
LONG = [(5, t, "user", str(t % 7)) for t in range(700)] + [(6, t, "user", str(t % 7)) for t in range(650)] + [(7, t, "user", str(t % 7 + (t > 500))) for t in range(600)] + [(8, 0, "user", "0")]


@pytest.mark.parametrize("rows", [ODD, made(1, 90, 14, 2), made(2, 60, 5, 1), COPIES, LONG + ODD], ids=["odd", "shared", "alike", "copies", "long"])
def test_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(4)
    got = prefix_trie.trie(df).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows)


def test_whole_table_and_sql_twin(spark):
    got = sorted(map(tuple, catalog.op13_prefix_trie(spark, SF).collect()), key=lambda r: r[:2])
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(con.execute(catalog.SQL["op13_prefix_trie"]).fetchall(), key=lambda r: r[:2]) == got


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(none).count() == 0
    # one turn, which is not among the first h of the absent base: only the root is left
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(c, 0, "user", "gone")]
    got = prefix_trie.trie(spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}
