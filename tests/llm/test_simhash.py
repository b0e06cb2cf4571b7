"""SimHash groups against all pairs, dense balls of fingerprints included."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from claimcheck.llm import queries, simhash
from claimcheck.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_print(text: str | None) -> int:
    """The contract word by word, with regular expressions and Python integers only."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_roots(prints: list[int]) -> list[int]:
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def brute_groups(rows: list[tuple]) -> list[tuple]:
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_roots(prints)
    least: dict = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    return sorted(((r[0], f"{p:016x}", least.get(root)) for r, p, root in zip(rows, prints, roots, strict=True)), key=str)


def texts(seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéÉA.") for _ in range(rnd.randint(1, 6)))
    base = [[word() for _ in range(n)] for n in (2, 3, 40, 150, 400)]
    rows = []
    for k in range(200):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 5, 30))):
            words[rnd.randrange(len(words))] = word()
        rows.append((k + 10, rnd.choice((" ", "\n", " \t")).join(words)))
    rows += [(300, None), (301, ""), (302, " \n\x0b"), (303, "one"), (304, "ONE"), (305, " "), (306, "b c d " * 40_000), (3, rows[7][1]), (4, "x y z"), (4, "x y q")]
    return [*rows, rows[5], (None, rows[6][1]), (None, "alone alone alone alone")]


@pytest.mark.parametrize("most", [3, 512])
def test_groups_equal_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    docs = spark.createDataFrame(texts(), "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1), "bucket": F.lit(None).cast("int")})
    assert sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=str) == brute_groups(texts())


@pytest.mark.parametrize("most", [2, 8, 512])
def test_links_of_dense_balls(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rnd = random.Random(most)
    prints = {rnd.getrandbits(64) for _ in range(60)} | {0, 1, 2**63, 2**64 - 1}
    for bits in (range(64), range(32), range(60, 64), range(14, 18)):
        centre = rnd.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rnd.sample(list(bits), rnd.randint(0, 4))) for _ in range(120)}
    prints = sorted(prints)
    signed = [x - (x >> 63 << 64) for x in prints]
    found = components(simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    root = {r.node: r.root for r in found}
    least: dict = {}
    roots = brute_roots(prints)
    for x, r in zip(signed, roots, strict=True):
        least[r] = min(x, least.get(r, x))
    assert [root.get(x, x) for x in signed] == [least[r] for r in roots]


def test_links_at_three_bits_only(spark):
    signed = [0, 0b111 << 30, 0b1111 << 10]
    found = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long")).distinct().collect()
    assert {(min(r), max(r)) for r in found} == {(0, 0b111 << 30)}


def test_no_documents(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op11_simhash(spark, SF)
    assert found.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == brute_groups(rows)


def test_buckets_are_not_broadcast_by_their_guessed_size(spark, monkeypatch):
    """Each fingerprint becomes about 34 rows, which Spark's guess of the size does not know; no side of that is sent to the driver."""
    plans, write = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    rows = [(k, f"some words of text {k // 2}") for k in range(60)]
    out = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]
    assert sorted(map(tuple, out.collect()), key=str) == brute_groups(rows)
