"""The prefix trie against one of nested tuples."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie


def plain(convs):
    """Node rows of {conversation: [(role, text), ...]}."""
    members, ends = collections.defaultdict(set), collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table(spark, rows):
    """Rows (conv, turn, role, text) with further columns of clashing names."""
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", F.lit(1).alias("pos"), F.lit(2).alias("key"), F.lit(3).alias("n"), F.lit("x").alias("conv"), F.lit(0).alias("size"))


def conversations(rows):
    """Turns in order; equal ones by the hash of role and text, as documented."""
    out = collections.defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in out.items()}


def drawn(seed, n=120, alphabet="ab", depth=7):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(alphabet) * rng.randint(0, 2)) for c in range(n) for t in range(rng.randint(1, depth))]
    return rows + [(7, None, None, None), (8, 0, "user", "a"), (8, 0, "user", "a"), (9, 1, None, "é€"), (None, 0, "user", "lost"), (-5, 3, "user", "b")]


@pytest.mark.parametrize(("segment", "shard"), [(256, 1 << 17), (2, 5), (1, 1)])
def test_trie(spark, segment, shard):
    """Segments and shards of any size give one trie."""
    rows = drawn(segment)
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows), shard_turns=shard, segment=segment)) == plain(conversations(rows))


def test_long_equal_and_hot_conversations(spark):
    """Thousands of turns in one conversation and a copy of it, and one first turn for most."""
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(300)] + [(c, 0, "user", "turn 0") for c in range(3, 400)] + [(5, 1, "user", "")]
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows), shard_turns=50, segment=64)) == plain(conversations(rows))


def test_rare_turns_are_joined(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARE_BITS", 3)
    rows = drawn(3, alphabet="abcdefgh")
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows))) == plain(conversations(rows))


def test_rebuilt(spark):
    """The query's conversations, among them turnless ones and such whose first turns' owner is absent or short."""
    rng = random.Random(5)
    rows = [(c, t, "user", rng.choice("xyz")) for c in range(60) if c % 7 for t in range(rng.choice([1, 2, 12]))]
    own = conversations(rows)
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    assert any(not x for x in want.values())
    turns, convs = prefix_trie.rebuilt(*prefix_trie.placed(prefix_trie.encoded(table(spark, rows))))
    assert rows_of(prefix_trie.trie(turns, convs)) == plain(want)


def test_trie_empty(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_median_order(n):
    order = list(prefix_trie.median_order(n))
    assert sorted(order) == list(range(n)) and (not n or order[0] == n // 2)


def test_medians_balance_the_tree():
    tree = prefix_trie.TernaryTree()
    for k in prefix_trie.median_order(1023):
        tree.insert([k], [1], 1, k)

    def height(k):
        return 0 if k < 0 else 1 + max(height(tree.lo[k]), height(tree.hi[k]))

    assert height(tree.eq[0]) == 10 and tree.totals({0})[0][0] == 1023
