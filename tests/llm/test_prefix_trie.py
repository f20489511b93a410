import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from tidemark.llm import prefix_trie as pt
from tidemark.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, depth int, at string, key string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5  # the remainder takes the sign of c, as in SQL
        new = tuple(turns.get(c - base, [])[:h] + turns[c][h:])
        for d in range(len(new) + 1):
            members[new[:d]].append(c)
        ends[new].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def trie(df, **more):
    out = pt.prefix_trie(df, **more)
    assert out.schema.simpleString() == "struct<" + pt.SCHEMA.replace(", ", ",").replace(" long", ":bigint").replace(" string", ":string") + ">"
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, out.collect()))


def test_decomposed_sums_equal_plain_ones():
    rng = random.Random(1)
    for n in [1, 2, 3, 50, 400]:
        for reach in (1, 3, n):  # a chain, narrow trees, and bushes
            parent = [-1] + [max(0, i - rng.randint(1, reach)) for i in range(1, n)]
            own, values = [rng.randint(1, 5) for _ in range(n)], [[rng.randint(0, 9) for _ in range(n)] for _ in range(2)]
            want = [list(v) for v in (own, *values)]
            for i in range(n - 1, 0, -1):
                for s in want:
                    s[parent[i]] += s[i]
            assert pt.decompose(parent, list(want[0]), values) == want[1:]


def test_a_chain_takes_a_halving_for_each_round():
    n = 30_000
    parent, w = [i - 1 for i in range(n)], list(range(n, 0, -1))
    assert pt.decompose(parent, w, [[1] * n])[0] == list(range(n, 0, -1))


def rows_of(spark, sf):
    return [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]


def test_conversations_match_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = brute(rows_of(spark, sf))
    assert trie(df) == want
    assert trie(df, local=20) == want  # split by joins first


def test_the_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    got = QUERIES["op12_prefix_trie"](spark, sf)
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op12_prefix_trie']})").fetchall(), key=key)


def fixture():
    rng = random.Random(5)
    rows = []
    for c in range(-6, 60):
        rows += [(c, t if t % 4 else None if t == 0 else t, rng.choice(["user", "assistant"]), rng.choice("ab")) for t in range(rng.choice([1, 1, 2, 5, 12]))]
    rows += [(100, 1, None, None), (100, 1, None, None), (100, None, "", ""), (100, None, "user", None), (101, 5, "u", "é" * 3), (None, 1, "u", "x"), (104, 1, "u", "no family here, and few turns")]
    rows += [(200, t, "user", "on and on") for t in range(120)] + [(201, t, "user", "on and on") for t in range(90)]  # deep
    rows += [(1000 + 5 * c, t, "user", "same" if t < 2 else str(c % 3)) for c in range(80) for t in range(4)]  # copies
    rows += [(2000 + 5 * c, 0, "user", f"first {c}") for c in range(90)]  # a wide root
    return rows


def test_edges_in_one_task_and_split(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, "at", "key") for r in rows], SCHEMA)
    want = brute(rows)
    assert trie(df) == want
    assert trie(df, local=60) == want
    assert trie(df.limit(0)) == []
    assert trie(df.where("conv_id is null")) == []
    assert trie(df.where("conv_id = 104")) == brute([r for r in rows if r[0] == 104])


def test_lists_of_members_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 10)
    members = [(c % 3, 1, c * 7 - 50) for c in range(200)]
    got = pt.member_digests(spark.createDataFrame(members, "conv_id long, depth long, c long").repartition(4)).collect()
    want = {k: hashlib.sha256(",".join(map(str, sorted(c for q, _, c in members if q == k))).encode()).hexdigest() for k in range(3)}
    assert {r.conv_id: r.ends_sha256 for r in got} == want and len(got) == 3
