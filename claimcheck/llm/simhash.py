"""Near copies by SimHash: fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import stored
from claimcheck.llm.components import components

#: Fingerprints that meet in a bucket of at most so many are compared with each other; a larger bucket is refined first.
MOST = 512
#: Buckets up to this size are compared across a whole batch at once, larger ones one by one.
SMALL = 16
#: Shingles of one text that are held at a time.
RUN = 1 << 16


class SimHash(NamedTuple):
    """Shingles of `size` words, hashed with `seed`; fingerprints link at up to `distance` differing bits (3 at most)."""

    size: int = 3
    seed: int = 42
    distance: int = 3


def fingerprint(text: bytes | None, how: SimHash) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if it is set in over half the hashes of its shingles, repeats included.

    bytes.lower() changes A-Z only and bytes.split() splits at 0x20 and 0x09-0x0D only, as the word rule asks.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - how.size + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    hashed, seed, counts = xxhash.xxh64_intdigest, how.seed, np.zeros(64, np.int64)
    for k in range(0, n, RUN):
        part = [hashed(joined[a:b], seed) for a, b in zip(starts[k : k + RUN], ends[k : k + RUN], strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fp) for each row of docs (doc_id, text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [fingerprint(t.as_py(), how) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(batches, "doc_id long, fp long")


def _refined(rows: DataFrame, width: int) -> DataFrame:
    """(bucket, fp, at) -> a row for each value near one of the two segments of `width` bits that begin at bit `at`.

    Fingerprints that differ in up to 3 of these 2 * width bits differ in at most one bit of one of the two segments. So
    each puts itself under its segment's value and under the values that have one set bit less: two that differ in one
    bit meet under the value without it. `at` becomes the other segment, the bits that the new bucket says nothing of.
    """
    at = [F.col("at") + k * width for k in (0, 1)]

    def segment(k: int) -> Column:
        return F.call_function("shiftrightunsigned", F.col("fp"), at[k]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def near(k: int) -> Column:
        one = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j))
        less = F.transform(F.filter(one, lambda b: segment(k).bitwiseAND(b) != 0), lambda b: segment(k) - b)
        return F.transform(F.concat(F.array(segment(k)), less), lambda v: F.struct(F.xxhash64("bucket", at[k], v).alias("bucket"), at[1 - k].alias("at")))

    return rows.select("fp", F.explode(F.concat(near(0), near(1))).alias("b")).select("b.bucket", "fp", "b.at")


def _groups(x: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the least position that it reaches by links, in blocks of rows so that no full matrix is held."""
    label = np.arange(len(x))
    step = max(1, (1 << 22) // len(x))
    while True:
        before = label.copy()
        for k in range(0, len(x), step):
            near = np.bitwise_count(x[k : k + step, None] ^ x[None, :]) <= distance
            label[k : k + step] = np.where(near, label[None, :], len(x)).min(axis=1)
        label = np.minimum(label, label[label])
        if np.array_equal(before, label):
            return label


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp), sorted -> pairs that connect what is connected by links within a bucket."""

    def solve(bucket: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[start, len(x)])
        a, b = [], []
        alive = np.flatnonzero(np.repeat(size <= SMALL, size))
        for step in range(1, SMALL):
            alive = alive[alive + step < len(x)]
            alive = alive[bucket[alive] == bucket[alive + step]]
            near = alive[np.bitwise_count(x[alive] ^ x[alive + step]) <= distance]
            a.append(x[near])
            b.append(x[near + step])
        for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
            group = x[s : s + n]
            label = _groups(group, distance)
            moved = label != np.arange(n)
            a.append(group[label[moved]])
            b.append(group[moved])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    held = (np.empty(0, np.int64), np.empty(0, np.uint64))
    for batch in batches:
        bucket = np.r_[held[0], batch.column(0).to_numpy()]
        x = np.r_[held[1], batch.column(1).to_numpy().view(np.uint64)]
        if not len(bucket):
            continue
        last = int(np.searchsorted(bucket, bucket[-1]))
        held = (bucket[last:], x[last:])
        if last:
            yield from solve(bucket[:last], x[:last])
    if len(held[0]):
        yield from solve(*held)


def hamming_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """fps (fp), distinct longs -> (a, b): pairs through which all fingerprints of a component are connected.

    Multi-index hashing: a table for each half of the fingerprint holds it under that half's value; each fingerprint asks
    a table for the values in a small Hamming ball around its half, and complete distances are verified. Buckets are
    counted first. One with over MOST members, as a large group of near copies makes, is not compared whole: its members
    are dealt anew by balls around segments of the bits that it leaves open, 16, 8 and at last 4 wide, which ends with
    buckets whose size has a fixed bound. No pair is lost by that, and each bucket gives out a forest, not its pairs.

    Rows and sizes are merged: Spark sizes both by the bytes of a few columns before the rows are multiplied, and would
    broadcast a table of tens of millions of buckets.
    """
    if not 0 <= distance <= 3:
        raise ValueError("halves with balls of radius 1 find distances up to 3")
    rows = _refined(fps.select(F.lit(0).cast("long").alias("bucket"), "fp", F.lit(0).alias("at")), 32)
    out = None
    for width in (16, 8, 4, 0):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        met = stored(rows.join(sizes.hint("merge"), "bucket"))
        whole = met.where(F.col("n") <= MOST) if width else met
        pairs = whole.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(lambda it: _links(it, distance), "a long, b long")
        out = pairs if out is None else out.union(pairs)
        over = met.where(F.col("n") > MOST).select("bucket", "fp", "at")
        if not width or over.isEmpty():
            return out
        rows = _refined(over.distinct(), width)
    return out


def simhash_groups(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text); other columns are ignored.

    component_id is the least doc_id that links reach. Texts that are null, empty or without words have the fingerprint
    zero, which links like any other; texts with fewer words than a shingle have one shingle, all their words. Long texts
    are hashed whole, in runs. Rows with a repeated id are judged one by one; a null id takes part and is ignored when the
    least id is taken (null if there is no other). No documents give no rows.
    """
    found = stored(fingerprints(docs, how))
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    roots = components(hamming_links(nodes.select("fp"), how.distance))
    named = nodes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_print = named.join(least.hint("merge"), "root").select("fp", "component_id")
    return found.join(of_print.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
