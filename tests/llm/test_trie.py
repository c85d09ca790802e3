"""The prefix trie and the running sums against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from larkspur.llm import scan, trie
from larkspur.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + v[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = (len(members[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0) + sum(saved[k] for k in kids[n])
    ends = {n: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)) for n, m in members.items()}
    key = lambda r: (r[0], r[1])
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()), key=key)


def same(spark, rows):
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == brute(rows)


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    same(spark, [tuple(r) for r in df.collect()])


def test_random_tries(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "d e f"])) for c in range(120) for t in range(rng.randrange(1, 7))]
    same(spark, rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "u", "x y"), (0, 1, "u", "x y"), (0, 1, None, "x y"), (None, 0, "u", "lost"), (7, None, "", ""), (25, 3, "u", ""), (41, 0, "u", "only"), (41, None, "u", "x" * 100_000), (60, 0, None, None)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"d": F.lit("x"), "rank": F.lit(None).cast("int"), "_part": F.lit(1), "one": F.lit(2)})
    assert sorted(map(tuple, trie.conversation_trie(df).select(COLUMNS).collect()), key=lambda r: (r[0], r[1])) == brute(rows)
    assert trie.conversation_trie(df.limit(0)).count() == 0


def test_long_conversations_and_many_copies(spark):
    """More than a block of turns, so that ranks have two levels; copies whose ids fill several pieces."""
    line = [("u", f"turn {i % 50}") for i in range(9000)]
    rows = [(0, i, *x) for i, x in enumerate(line)]
    rows += [(c, i, *x) for c, n in ((20, 5000), (40, 64), (60, 63), (80, 65), (1, 200)) for i, x in enumerate(line[:n])]
    rows += [(100, i, *x) for i, x in enumerate([*line[:4500], ("u", "turns off"), *line[:80]])]
    rows += [(1_000_000 + 20 * c, 0, "u", "hello there") for c in range(12_000)]
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS)).select(*COLUMNS, "preorder", "subtree_end").collect()
    nodes = {(r.conv_id, r.depth): r for r in got}
    assert len(nodes) == len(got) == sorted(r.preorder for r in got)[-1]
    hello = next(r for r in got if r.n_convs == 12_000)
    assert hello.saved_tokens == 2 * 11_999 and hello.ends_sha256 == hashlib.sha256(",".join(str(1_000_000 + 20 * c) for c in range(12_000)).encode()).hexdigest()
    root = next(r for r in got if r.depth == 0)
    assert root.preorder == 1 and root.subtree_end == len(got) and root.n_convs == 12_007
    for r in got:
        if r.depth and r.parent_conv_id is not None:
            up = nodes[r.parent_conv_id, r.depth - 1]
            assert up.preorder < r.preorder <= r.subtree_end <= up.subtree_end
    assert sum(r.n_children for r in got) == len(got) - 1 and root.n_leaves == sum(r.n_children == 0 for r in got)


def test_running(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 9]), i, rng.randrange(1 << 40)) for i in range(5000)]
    df = spark.createDataFrame(rows, "seg long, at long, v long").withColumn("w", F.col("v"))
    got = scan.running(df, ["at"], Scratch(spark, "t"), sums=("v",), xors=("w",), segment="seg").collect()
    sums, xors, want = defaultdict(int), defaultdict(int), {}
    for seg, at, v in sorted(rows):
        sums[seg] += v
        xors[seg] ^= v
        want[at] = (sums[seg], xors[seg])
    assert {r["at"]: (r.v_run, r.w_run) for r in got} == want
