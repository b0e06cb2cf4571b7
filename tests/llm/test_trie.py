"""The prefix trie against a plain dictionary of paths."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from claimcheck.llm import trie
from claimcheck.llm.queries import op12_prefix_trie

CONV = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> list[tuple]:
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if built[c] == p).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def conversations(seed: int = 2) -> list[tuple]:
    rnd = random.Random(seed)
    said = [("user", "hello"), ("user", "héllo €"), ("assistant", "a"), ("assistant", ""), (None, None), ("", None), ("us", "erhello")]
    rows = []
    for c in [*range(-12, 60), 10**15, 10**15 + 3]:
        if c % 11 == 4:
            continue
        for k in range(rnd.choice((1, 2, 4, 9, 12, 40 if c == 7 else 3))):
            rows.append((c, rnd.choice((k, k, k, None, 3)), *rnd.choice(said[: rnd.choice((2, 7))])))
    rows += [(200, 0, "user", "x" * 300_000), (200, 1, "user", "é" * 10), (201, 0, "user", "x" * 300_000), rows[5], rows[5], (None, 0, "user", "lost")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [1, 7, 4096])
def test_trie_equals_a_dictionary_of_paths(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", shard)
    rows = conversations()
    turns = trie.numbered_turns(spark.createDataFrame([(*r, 1, "x") for r in rows], CONV + ", node int, pos string"))
    got = sorted(map(tuple, trie.prefix_trie(trie.with_shared_openings(turns, 5, 9)).collect()))
    assert got == brute(rows) and len(got) > 150


def test_equal_conversations_are_one_path(spark):
    rows = [(c * 5, k, "user", f"t{k}") for c in range(300) for k in range(20)]
    got = trie.prefix_trie(trie.with_shared_openings(trie.numbered_turns(spark.createDataFrame(rows, CONV)), 5, 9)).collect()
    assert len(got) == 21 and {r.n_convs for r in got} == {300} and {r.n_leaves for r in got} == {1}
    assert sorted(map(tuple, got)) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    # 8 and 9 rebuild to the first turns of the absent 5
    rows = [(8, 0, "user", "a"), (9, 0, "user", "a")]
    turns = trie.with_shared_openings(trie.numbered_turns(spark.createDataFrame(rows, CONV)), 5, 9)
    assert sorted(map(tuple, trie.prefix_trie(turns).collect())) == brute(rows)


def test_no_conversations(spark):
    turns = trie.numbered_turns(spark.createDataFrame([], CONV))
    assert trie.prefix_trie(trie.with_shared_openings(turns, 5, 9)).collect() == []


def test_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op12_prefix_trie(spark, "/root/testdata/sf0.001")
    assert all(t in ("bigint", "string") for _, t in found.dtypes)
    assert sorted(map(tuple, found.collect())) == brute(rows)
