"""Prefix trie of conversations, built shard by shard from vertical bitmaps and merged by the hash of the path."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.llm.common import stored
from claimcheck.operators.tree import subtree_sums

#: A shard is a run of conversations, by id, of at most so many; a shard is also closed once it holds so many turns.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 18
ROOT = bytes(16)
PART = "node binary, parent binary, depth int, n_convs long, conv_id long, n_bytes long, first_end long, ends string"
_KINDS = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_NAMES = [column.split()[0] for column in PART.split(", ")]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> (conv_id, pos, turn_key, n_bytes), pos from 0 by turn, null first.

    turn_key is a 128-bit hash of role and text, so texts are not shuffled; n_bytes is the text's length in UTF-8. A null
    role or text counts as empty. Turns with one number are in the order of their keys, and each repeated row is a turn.
    Rows without conv_id belong to no conversation and are left out. The keys of one conversation meet in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "turn_key", "n_bytes")


def with_shared_openings(turns: DataFrame, group: int, openings: int) -> DataFrame:
    """numbered turns -> those of conversations that open like the first of their group of ids, by numbered_turns.

    Conversation c gets the first h turns of conversation c - c % group (all if it has fewer, none if it is absent), then
    its own turns after its first h; h is crc32 of the decimal c, modulo openings. % takes the sign of c, as in SQL. A
    conversation that is left without turns has one row with null pos.
    """
    convs = turns.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"))
    convs = convs.withColumns({"base": F.col("c") - F.col("c") % group, "h": F.crc32(F.col("c").cast("string").cast("binary")) % openings})
    lengths = convs.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = turns.join(convs.select(F.col("c").alias("conv_id"), "h", "m"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn_key", "n_bytes")
    heads = turns.where(F.col("pos") < openings - 1).withColumnRenamed("conv_id", "base")
    shared = convs.select("c", "base", "h").join(heads, "base").where("pos < h").select(F.col("c").alias("conv_id"), "pos", "turn_key", "n_bytes")
    none = convs.where("m + greatest(n - h, 0) = 0").select(F.col("c").alias("conv_id"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(None).cast("long").alias("n_bytes"))
    return own.unionByName(shared).unionByName(none)


def shard_nodes(ids: list[int], keys: list[list[bytes]], sizes: list[list[int]]) -> Iterator[tuple]:
    """The nodes (PART) of one shard's trie, depth first; ids ascend, keys and sizes hold each conversation's turns.

    The index has a bitset of conversations for each (position, turn) and one of those that end at each depth. A node is
    the bitset of its members; its children are its intersections with the postings at the next position, taken for the
    lowest member that no child holds yet.
    """
    postings: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    for i, mine in enumerate(keys):
        for at in enumerate(mine):
            postings[at] = postings.get(at, 0) | 1 << i
        ending[len(mine)] = ending.get(len(mine), 0) | 1 << i
    stack = [((1 << len(ids)) - 1, 0, ROOT, None, 0)]
    while stack:
        members, depth, node, parent, n_bytes = stack.pop()
        ended = members & ending.get(depth, 0)
        done, rest = [], ended
        while rest:
            low = rest & -rest
            done.append(ids[low.bit_length() - 1])
            rest ^= low
        least = ids[(members & -members).bit_length() - 1]
        yield node, parent, depth, members.bit_count(), least, n_bytes, done[0] if done else None, ",".join(map(str, done)) if done else None
        rest = members ^ ended
        while rest:
            low = (rest & -rest).bit_length() - 1
            key = keys[low][depth]
            child = members & postings[depth, key]
            rest &= ~child
            stack.append((child, depth + 1, hashlib.blake2b(node + key, digest_size=16).digest(), node, sizes[low][depth]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn_key, n_bytes), sorted by conversation and position -> nodes of runs of conversations."""
    ids: list[int] = []
    keys: list[list[bytes]] = []
    sizes: list[list[int]] = []
    turns = 0

    def close() -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in shard_nodes(ids, keys, sizes):
            rows.append(row)
            if len(rows) == 20_000:
                yield pack(rows)
                rows = []
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    for batch in batches:
        for conv, key, n_bytes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if not ids or ids[-1] != conv:
                if len(ids) >= SHARD_CONVERSATIONS or turns >= SHARD_TURNS:
                    yield from close()
                    ids, keys, sizes, turns = [], [], [], 0
                ids.append(conv)
                keys.append([])
                sizes.append([])
            if key is not None:
                keys[-1].append(key)
                sizes[-1].append(n_bytes)
                turns += 1
    if ids:
        yield from close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ends), sorted by node and first id -> (node, ends_sha256); lists are hashed piece by piece, never joined."""
    node, state = None, None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for other, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if other == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = other, hashlib.sha256()
            state.update(ends.encode())
        yield _digest_rows(out)
    if state is not None:
        yield _digest_rows([(node, state.hexdigest())])


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """turns (conv_id, pos, turn_key, n_bytes) -> one row for each distinct sequence of first turns, the root included.

    Columns: conv_id (least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, (n_convs - 1) * n_bytes of each node's last turn) and ends_sha256 (ids that end there, ascending,
    comma-joined). A row with null pos stands for a conversation without turns. No rows give no trie, not even a root.

    Conversations are dealt out by ranges of ids, so shards follow each other and a node's end lists are joined in order.
    Nodes of different shards are the same if the hashes of their paths are; counts and minima combine map-side. Sums over
    subtrees take log2(depth) rounds. What meets in one task: a shard, the turn hashes of one conversation, and, one after
    the other, a row for each shard in which conversations end at one node, since their digest is one hash.
    """
    dealt = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "turn_key", "n_bytes")
    parts = stored(dealt.mapInArrow(_shards, PART))
    merged = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"),
    )
    merged = stored(merged)
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(merged.join(children, "node", "left").fillna(0, ["n_children"]))
    own = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    sums = subtree_sums(own, "node", "parent", ["n_leaves", "saved_tokens"])
    ends = parts.where("ends is not null").select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end")
    digests = ends.select("node", "ends").mapInArrow(_digests, "node binary, ends_sha256 string")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, "node").join(digests, "node", "left").join(above, "parent", "left")
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
