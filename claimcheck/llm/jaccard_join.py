"""Exact self-join of texts on the Jaccard similarity of their word shingles, with set-relation skipping."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import WORD, discard, release, stored
from claimcheck.llm.components import components

#: Shingles are counted within runs of so many; a shingle in two documents of one run is reported to the global count.
RUN = 1 << 21
#: At most so many of the most frequent shingles get a place in the order by their count (1.5 MB are broadcast).
COUNTED = 1 << 17
#: All other shingles are told apart as common, in so many sets or more, or rare: counts by the upper 32 bits of the hash, gathered
#: in so many ranges and kept as one bit for each 16 values (32 MB are broadcast). A rare shingle taken for common only stands further back.
COMMON, RANGES = 4, 256
FOLD = 16
#: An inverted list up to this length is joined pair by pair; the members of a longer one meet in blocks.
SHORT_LIST = 32
#: Inverted lists are made in so many turns, each of a part of the shingles, so that only that part's shuffle files lie on disk.
LIST_TURNS = 2
#: A block of sets holds about so many sets and so many shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 18
#: Width of a class of set sizes, a little over 4/3 so that linked sets are in the same or neighbouring classes.
CLASS_WIDTH = 1.001
#: Sets are made and sent to their blocks in so many turns that one turn holds at most this part of the shingles of all rows on disk.
TURN = 4
#: Bits of the filter that keeps texts from being read as sets when nothing asks for them (1 MB; full, it keeps none out).
FILTER_BITS = 1 << 23


class Similarity(NamedTuple):
    """Sets link when 100 * intersection >= percent * union; shingles are `size` words."""

    size: int = 5
    percent: int = 75


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of the whole sequence if it has fewer words; else empty.

    bytes.lower() changes A-Z only and bytes.split() splits at 0x20 and 0x09-0x0D only, as the word rule asks.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total += hashes[k : len(hashes) - width + 1 + k] * np.uint64(xxhash.xxh3_64_intdigest(bytes([k])) | 1)
    total ^= total >> np.uint64(32)
    total *= np.uint64(xxhash.xxh3_64_intdigest(b"mix") | 1)
    total ^= total >> np.uint64(29)
    return np.unique(total)


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, rows (token, seen) for shingles that two different sets of a run share, and the run's buckets.

    A shingle's bucket is the upper half of its hash. The buckets of a run are a row for each range of them: how many it has under
    each value of their middle 8 bits, and of each, in order, the lower 16 bits. A bucket comes once for each set, COMMON times at most.
    """
    cache, run, held, nodes = _WordHashes(), [], 0, set()
    names = ["doc_id", "print", "n", "node", "token", "seen", "range", "of_middle", "low"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def rows(**known) -> pa.RecordBatch:
        n = len(next(iter(known.values())))
        return pa.RecordBatch.from_arrays([pa.array(known[c], k) if c in known else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def shared() -> Iterator[pa.RecordBatch]:
        if not run:
            return
        all_ = np.sort(np.concatenate(run))
        start = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]])
        seen = np.diff(np.r_[start, len(all_)])
        yield rows(token=all_[start[seen > 1]].view(np.int64), seen=seen[seen > 1])
        bucket = (all_[np.r_[np.full(min(COMMON, len(all_)), True), all_[COMMON:] != all_[:-COMMON]]] >> np.uint64(32)).astype(np.uint32)
        middle = np.bincount(bucket >> np.uint32(16), minlength=1 << 16).astype(np.uint32).reshape(RANGES, -1)
        low = np.split(bucket.astype(np.uint16), np.cumsum(middle.sum(axis=1))[:-1])
        full = [k for k in range(RANGES) if len(low[k])]
        yield rows(range=full, of_middle=[middle[k].tobytes() for k in full], low=[low[k].tobytes() for k in full])

    for batch in batches:
        sizes, keys = [], []
        for text in batch.column(1):
            hashes = shingle_set(text.as_py(), size, cache)
            sizes.append(len(hashes))
            keys.append(_node(hashes) if len(hashes) else None)
            if len(hashes) and keys[-1] not in nodes:
                nodes.add(keys[-1])
                run.append(hashes)
                held += len(hashes)
            if held >= RUN:
                yield from shared()
                run, held, nodes = [], 0, set()
        yield rows(doc_id=batch.column(0), print=batch.column(2), n=sizes, node=keys)
    yield from shared()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, of_middle, low), those of a range together -> (range, bits): a bit for each FOLD buckets, set if one is common.

    One count of 8 bits is held for each bucket of one range, however many runs there are.
    """
    at, times = None, None

    def folded() -> pa.RecordBatch:
        bits = np.packbits((times >= COMMON).reshape(-1, FOLD).any(axis=1), bitorder="little")
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["range", "bits"])

    for batch in batches:
        for now, of_middle, low in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if now != at:
                if at is not None:
                    yield folded()
                at, times = now, np.zeros((1 << 32) // RANGES, np.uint8)
            middle = np.frombuffer(of_middle, np.uint32)
            bucket = np.repeat(np.arange(len(middle), dtype=np.uint32) << np.uint32(16), middle) + np.frombuffer(low, np.uint16)
            for _ in range(COMMON):  # sorted: in each round the first of what is left of a bucket counts
                if not len(bucket):
                    break
                first = np.r_[True, bucket[1:] != bucket[:-1]]
                times[bucket[first]] = np.minimum(times[bucket[first]] + 1, COMMON)
                bucket = bucket[~first]
    if at is not None:
        yield folded()


def _prefixes(batches: Iterator[pa.RecordBatch], how: Similarity, token: np.ndarray, seen: np.ndarray, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The prefix of each set in the order (count, common or rare, hash): its part for short lists, its part for blocks, and its most frequent shingle.

    A set goes out once from each task, however many copies the task reads.
    """
    cache, done = _WordHashes(), set()
    for batch in batches:
        out: list[tuple] = []
        for text in batch.column(1):
            hashes = shingle_set(text.as_py(), how.size, cache)
            n = len(hashes)
            if not n or (node := _node(hashes)) in done:
                continue
            if len(done) > 1_000_000:
                done.clear()
            done.add(node)
            signed = hashes.view(np.int64)
            times = np.zeros(n, np.int64)
            if len(token):
                at = np.minimum(np.searchsorted(token, signed), len(token) - 1)
                times = np.where(token[at] == signed, seen[at], 0)
            place = (hashes >> np.uint64(32)) // np.uint64(FOLD)
            order = np.lexsort((signed, common[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1, times))
            first = order[: n - -(-how.percent * n // 100) + 1]
            long = times[first] > SHORT_LIST
            out.append((node, n, signed[first[~long]], signed[first[long]], int(signed[order[-1]]) if long.any() else None))
        columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["node", "n", "rare", "frequent", "home"])


def _short_lists(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    """Inverted lists (token, n, node, at), sorted -> pairs with the shared tokens, or the members of a list that is not short.

    A list is sorted by set size, so the partners of a set are the block of positions behind it that the size bound leaves;
    a pair stays open only while the tokens after the shared one can still reach the needed overlap.
    """
    names = ["a", "b", "na", "nb", "shared", "open"]
    held, streaming = None, None

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, n, node, at = rows
        found = []
        for step in range(1, SHORT_LIST):
            same = np.flatnonzero(token[:-step] == token[step:]) if len(token) > step else np.empty(0, int)
            if not len(same):
                break
            near = same[100 * n[same] >= how.percent * n[same + step]]
            if len(near):
                na, nb = n[near], n[near + step]
                need = -(-how.percent * (na + nb) // (100 + how.percent))
                room = 1 + np.minimum(na - 1 - at[near], nb - 1 - at[near + step]) >= need
                found.append((node[near], node[near + step], na, nb, room))
        if found:
            a, b, na, nb, room = (np.concatenate(x) for x in zip(*found, strict=True))
            swap = a > b
            a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
            order = np.lexsort((b, a))
            a, b, na, nb, room = a[order], b[order], na[order], nb[order], room[order]
            start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            count = np.diff(np.r_[start, len(a)])
            yield pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(na[start], pa.int32()), pa.array(nb[start], pa.int32()), pa.array(count, pa.int32()), pa.array(np.logical_or.reduceat(room, start))], names)

    def members(rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(rows.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[2]), pa.array(rows[1], pa.int32()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.bool_())], names)

    def batch_of(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        """Gives out what is complete; keeps the last list in `held` while it may go on."""
        nonlocal held, streaming
        new = np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[2, 1:] != rows[2, :-1])]
        rows = rows[:, new]
        start = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        length = np.repeat(np.diff(np.r_[start, rows.shape[1]]), np.diff(np.r_[start, rows.shape[1]]))
        tail = rows[0] == rows[0, -1]
        over = (length > SHORT_LIST) | (rows[0] == streaming if streaming is not None else False)
        streaming = rows[0, -1] if over[-1] else None
        keep = tail & ~over if not last else np.zeros_like(tail)
        if over.any():
            yield members(rows[:, over])
        yield from pairs(rows[:, ~over & ~keep])
        held = rows[:, keep] if keep.any() else None

    for batch in batches:
        if batch.num_rows:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            yield from batch_of(rows if held is None else np.concatenate([held, rows], axis=1), False)
    if held is not None:
        yield from batch_of(held, True)


def _gather(first: np.ndarray, last: np.ndarray, postings: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """All postings of some tokens, one after the other."""
    length = last[tokens] - first[tokens]
    shift = np.repeat(first[tokens] - np.r_[0, np.cumsum(length)[:-1]], length)
    return postings[np.arange(length.sum()) + shift] if len(length) else postings[:0]


def overlap_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among sets, as a spanning forest of positions.

    The overlaps of a set with all others are counted along the inverted lists. If a set is close to the one before it,
    its overlaps are derived from that one's: lists of the shingles that only one of the two has are taken off or added.
    """
    n = np.array([len(x) for x in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((owner, tokens))
    postings, last = owner[order], np.cumsum(np.bincount(tokens))
    first = np.r_[0, last[:-1]]
    own = np.split(tokens, np.cumsum(n)[:-1])
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, counts = [], None
    for i, mine in enumerate(own):
        if counts is not None and 2 * counts[i] > n[i] and 2 * counts[i] > n[i - 1]:
            gone, come = np.setdiff1d(own[i - 1], mine, assume_unique=True), np.setdiff1d(mine, own[i - 1], assume_unique=True)
            counts = counts - np.bincount(_gather(first, last, postings, gone), minlength=len(sets)) + np.bincount(_gather(first, last, postings, come), minlength=len(sets))
        else:
            counts = np.bincount(_gather(first, last, postings, mine), minlength=len(sets))
        for j in np.flatnonzero(100 * counts >= percent * (n[i] + n - counts)):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, int(j)))
    return links


def _needed_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(F.lit(percent) * n / F.lit(100)) + 1


def jaccard_groups(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """(doc_id, print, n_shingles, root, component_id) for each row of docs (doc_id, text).

    print is the text's hash; root is the same for all rows of a component and null for rows without shingles.

    Equal sets become one node. Shingles are put into one order, frequent ones last; a linked pair shares shingles of
    both prefixes in it. Short inverted lists give pairs, which must share as many prefix shingles as a linked pair does;
    the sets of pairs with a common partner meet in one block, so that a set is sent there once and not for each pair.
    Documents of longer lists are laid into blocks of similar sets, and each pair of blocks that
    share such a list is joined whole in one task, set by set, each set's answers derived from those of the set before.
    Only a spanning forest of links leaves a task, so a group of copies never becomes a list of pairs. Blocks meet in
    turns, and the sets of a turn are gone from disk before the next.

    Null and empty texts, and texts without words, have no shingles and form components of their own. Rows with a
    repeated id are judged one by one; a null id takes part, and is ignored when the least id of a component is taken
    (null if there is no other). Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    counted = stored(docs.mapInArrow(lambda it: _count(it, how.size), "doc_id long, print long, n int, node long, token long, seen int, range int, of_middle binary, low binary"))
    base = stored(counted.where("n is not null").select("doc_id", "print", "n", "node"))
    nodes = base.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    top = counted.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen > 3").orderBy(F.desc("seen"), "token").limit(COUNTED).toPandas().sort_values("token")
    token, seen = (spark.sparkContext.broadcast(top[c].to_numpy(np.int64)) for c in ("token", "seen"))
    runs = counted.where("range is not null").select("range", "of_middle", "low")
    common = np.zeros((RANGES, (1 << 32) // RANGES // FOLD // 8), np.uint8)
    for at, bits in runs.repartition("range").sortWithinPartitions("range").mapInArrow(_common, "range int, bits binary").toPandas().itertuples(index=False):
        common[at] = np.frombuffer(bits, np.uint8)
    common = spark.sparkContext.broadcast(common.ravel())
    discard(counted)

    prefixes = stored(docs.mapInArrow(lambda it: _prefixes(it, how, token.value, seen.value, common.value), "node long, n int, rare array<long>, frequent array<long>, home long"))
    entries = prefixes.select("node", "n", F.posexplode("rare").alias("at", "token")).select("token", "n", "node", "at")
    parts = []
    for k in range(LIST_TURNS):
        lists = entries.where(F.pmod("token", F.lit(LIST_TURNS)) == k).repartition("token").sortWithinPartitions("token", "n", "node")
        parts.append(stored(lists.mapInArrow(lambda it: _short_lists(it, how), "a long, b long, na int, nb int, shared int, open boolean")))
        release(spark)
    met = reduce(DataFrame.union, parts)
    summed = met.where("nb is not null").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"), F.max("open").alias("open"))
    need = _needed_overlap(F.col("na"), F.col("nb"), how.percent)
    room = F.least(_prefix_length(F.col("na"), how.percent) - F.col("na") + need, _prefix_length(F.col("nb"), how.percent) - F.col("nb") + need)
    pairs = stored(summed.where(F.col("open") & (F.col("shared") >= room)).select("a", "b", "na", "nb"))

    longer = met.where("nb is null").select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("na").alias("n"), F.lit(None).cast("long").alias("home"))
    frequent = stored(prefixes.select(F.explode("frequent").alias("token"), "node", "n", "home").union(longer).distinct())
    discard(met)
    discard(prefixes)
    members = frequent.groupBy("node").agg(F.coalesce(F.max("home"), F.min("token")).alias("home"), F.max("n").alias("n"))
    members = members.withColumn("size_class", F.floor(F.log(F.col("n")) / F.lit(CLASS_WIDTH * float(np.log(100 / how.percent)))))
    members = stored(_in_blocks(members, "home", "size_class"))
    lying = frequent.select("token", "node").join(members, "node").select("token", "block", "size_class").distinct()
    other = lying.select("token", F.col("block").alias("block_b"), F.col("size_class").alias("class_b"))
    meetings = (
        lying.join(other, "token").where("block <= block_b and abs(size_class - class_b) <= 1").select("block", "block_b").distinct()
        .select(F.xxhash64("block", "block_b").alias("meeting"), F.explode(F.array_distinct(F.array("block", "block_b"))).alias("block"))
    )
    met_in_blocks = meetings.join(members.select("node", "n", "block"), "block").select("meeting", "node", "n")

    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("home"), F.col("na").alias("n")).union(pairs.select("b", "a", "nb"))
    paired = ends.groupBy("node").agg(F.least(F.col("node"), F.min("home")).alias("home"), F.max("n").alias("n"))
    paired = stored(_in_blocks(paired, "home"))
    of = lambda x: paired.select(F.col("node").alias(x), F.col("block").alias(f"block_{x}"))
    met_in_pairs = (
        pairs.join(of("a"), "a").join(of("b"), "b")
        .select(F.xxhash64(F.lit("pair"), F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("meeting"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("na").alias("n")), F.struct(F.col("b").alias("node"), F.col("nb").alias("n")))).alias("x"))
        .select("meeting", "x.node", "x.n").distinct()
    )
    sent = stored(met_in_blocks.union(met_in_pairs))
    turns = max(1, -(-TURN * _total(sent) // max(1, _total(base))))
    links = []
    for k in range(turns):
        links.append(stored(_links(docs, nodes, sent.where(F.pmod(F.xxhash64("meeting"), F.lit(turns)) == k), how)))
        release(spark)
    roots = components(reduce(DataFrame.union, links))
    named = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "root").select("node", "root", "component_id")
    return base.join(of_node, "node", "left").select(
        "doc_id", "print", F.col("n").cast("long").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def jaccard_join(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs, by jaccard_groups."""
    return jaccard_groups(docs, how).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """docs with one row of each component: that with the least doc_id, null last; of rows equal in id and text one.

    Rows without words belong to no group and stay.
    """
    groups = jaccard_groups(docs, how).where("root is not null")
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.print").alias("_print"))
    worded = F.coalesce(F.rlike("text", F.lit(WORD)), F.lit(False))
    keyed = docs.where(worded).withColumn("_own", F.xxhash64("text"))
    rows = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_print")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_own"]).drop("_own").union(docs.where(~worded))


def _sets(batches: Iterator[pa.RecordBatch], size: int, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of documents that the filter lets through; a set once from each batch."""
    cache = _WordHashes()
    for batch in batches:
        bit = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
        through = np.flatnonzero((asked[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
        sets = {_node(x): x.view(np.int64) for x in (shingle_set(batch.column(1)[int(k)].as_py(), size, cache) for k in through) if len(x)}
        yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.list_(pa.int64()))], ["node", "shingles"])


def _total(sets: DataFrame) -> int:
    return sets.agg(F.sum("n")).first()[0] or 0


def _in_blocks(members: DataFrame, *keys: str) -> DataFrame:
    """(node, n, keys) -> a block for each: members of equal keys together, about BLOCK_SETS sets or BLOCK_SHINGLES shingles in one block."""
    parts = members.groupBy(*keys).agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    return members.join(parts, [*keys]).select("node", "n", *keys[1:], F.xxhash64(*keys, F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))


def _links(docs: DataFrame, nodes: DataFrame, sent: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) among the sets that meet: each set is made once from its text and sent to each of its meetings (meeting, node, n)."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    wanted = sent.select("node").distinct().join(nodes, "node").select(bit.alias("bit"))
    bits = wanted.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    asked = np.zeros(FILTER_BITS // 64, np.int64)
    asked[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    asked = spark.sparkContext.broadcast(asked.view(np.uint64))
    sets = docs.select("doc_id", "text", bit.alias("bit")).mapInArrow(lambda it: _sets(it, how.size, asked.value), "node long, shingles array<long>")
    sets = sets.join(sent.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    gathered = sent.join(sets, "node").select("meeting", "node", "n", "shingles").repartition("meeting").sortWithinPartitions("meeting", "n", "node")
    return gathered.mapInArrow(lambda it: _meet(it, how.percent), "a long, b long")


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (meeting, node, n, shingles), sorted -> the links among the sets of each meeting. The sets of one meeting are held."""
    at, nodes, sets = None, [], []

    def joined() -> pa.RecordBatch:
        found = overlap_links(sets, percent) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[pair[k]] for pair in found], pa.int64()) for k in range(2)], ["a", "b"])

    for batch in batches:
        shingles = batch.column(3)
        for k, (meeting, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if meeting != at:
                if sets:
                    yield joined()
                at, nodes, sets = meeting, [], []
            nodes.append(node)
            sets.append(np.array(shingles[k].values.to_numpy(zero_copy_only=False)))
    if sets:
        yield joined()
