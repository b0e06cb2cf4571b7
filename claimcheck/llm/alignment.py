"""Alignment of two tokenizers over the corpus, with counts of linked id pairs behind minimal perfect hashes."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import stored

#: Distinct pairs of a shard, which has a hash function of its own, about; pairs whose keys and counts are held at a time.
SHARD, SLICE = 1 << 16, 1 << 22
#: So many count vectors of a shard are summed at each step of the tree.
FAN = 16
#: A task remembers the alignment of so many pieces of text, and so many characters of them, before it starts anew.
PIECES, PIECE_CHARS = 1 << 19, 1 << 23
#: Texts are worked on in runs of so many characters.
RUN = 1 << 21

# The pattern that splits text for the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"
#: Two white spaces in a row may be cut differently when a text is taken apart: the usual ones, and where there are others any two.
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_OTHER = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ANY_DOUBLE = re.compile(r"[\s]\s")
#: Characters whose class may differ between versions of Unicode.
_UNUSUAL = re.compile("[^\x00-ӿ‐-‧€]")


class Tokenizers(NamedTuple):
    """Where the two vocabularies are: a byte-level BPE as JSON and a piece BPE with byte fallback."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary:
    """Both tokenizers with the bytes and lengths of their tokens."""

    _loaded: dict[Tokenizers, Vocabulary] = {}

    @classmethod
    def of(cls, names: Tokenizers) -> Vocabulary:
        """Loaded once in each Python process."""
        if names not in cls._loaded:
            cls._loaded[names] = cls(names)
        return cls._loaded[names]

    def __init__(self, names: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(names.a)
        self.plain.encode_special_tokens = True
        with open(names.a, encoding="utf-8") as f:
            saved = json.load(f)
        # byte-level vocabularies write a byte as itself where it is printable, else as the next free code point from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
        special = {t["content"] for t in saved["added_tokens"]}
        entries = {bytes(byte[c] for c in token): i for token, i in saved["model"]["vocab"].items() if token not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in saved["model"]["merges"]]
        ranked = all(saved["model"]["vocab"]["".join(m)] == 256 + k for k, m in enumerate(merges)) and all(bytes([c]) in entries for c in range(256))
        # ids that are merge ranks allow the faster library, which gives the same ids
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=entries, special_tokens={}) if ranked else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=names.b)
        self.a_bytes = [b""] * self.plain.get_vocab_size()
        for token, i in entries.items():
            self.a_bytes[i] = token
        self.n_b = self.pieces.get_piece_size()
        self.b_bytes = []
        for i in range(self.n_b):
            piece = self.pieces.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.space = self.pieces.piece_to_id(SPACE)
        # texts come apart before a space or a line end only if no piece has one behind something else
        inner = re.compile(f"[^{SPACE}]{SPACE}|.\n|\n.")
        self.separable = not any(inner.search(self.pieces.id_to_piece(i)) for i in range(self.n_b))
        self.a_len = np.array([len(x) for x in self.a_bytes])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        self.written = np.array([f"{i}{end}" for end in (",", "|") for i in range(len(self.a_bytes))] + [f"{i}{end}" for end in (",", ";") for i in range(self.n_b)], dtype=object)

    def cut(self, text: str) -> list[str] | None:
        """Pieces of " " + text that both tokenizers treat apart, each without its leading space; None if it has to stay whole."""
        if not self.separable or text[0].isspace() or text[-1] == " " or any(d in text for d in _DOUBLE):
            return None
        if _OTHER.search(text) and _ANY_DOUBLE.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        if self.fast is None:
            return _flat([x.ids for x in self.plain.encode_batch(texts, add_special_tokens=False)])
        encode, unusual = self.fast.encode_ordinary, _UNUSUAL.search
        if not unusual("".join(texts)):
            return _flat(list(map(encode, texts)))
        return _flat([self.plain.encode(t, add_special_tokens=False).ids if unusual(t) else encode(t) for t in texts])

    def encode_pieces(self, whole: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_a of pieces by cut, of `sizes` bytes, in longer stretches: where one ends and the next begins no token goes on.

        That holds where no two white spaces meet, so pieces that end with one are encoded alone.
        """
        alone = np.fromiter((w[-1].isspace() for w in whole), bool, len(whole))
        if self.fast is None or alone.all() or _UNUSUAL.search("".join(whole)):
            return self.encode_a(whole)
        kept = [w for w, x in zip(whole, alone, strict=True) if not x] if alone.any() else whole
        flat = _flat([self.fast.encode_ordinary("".join(kept[k : k + 1000])) for k in range(0, len(kept), 1000)])[1]
        ends = np.cumsum(sizes[~alone])
        n = np.diff(np.r_[0, np.searchsorted(np.cumsum(self.a_len[flat]), ends) + 1])
        if not alone.any():
            return n, flat
        n_alone, flat_alone = self.encode_a([w for w, x in zip(whole, alone, strict=True) if x])
        both = np.zeros(len(whole), np.int64)
        both[~alone], both[alone] = n, n_alone
        of = np.repeat(alone, both)
        ids = np.empty(len(of), np.int64)
        ids[~of], ids[of] = flat, flat_alone
        return both, ids

    def encode_b(self, texts: list[str], spaced: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_a, with the space that the tokenizer puts in front of each text; where not spaced, without it."""
        found = self.pieces.encode(texts, num_threads=1)
        return _flat(found if all(spaced) else [ids if s or ids[0] != self.space else ids[1:] for s, ids in zip(spaced, found, strict=True)])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return n, np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))


class Aligned(NamedTuple):
    """Alignments of some texts: sizes, the linked pairs of each in order, and its groups as text."""

    right: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: list[str]


def _spelled(token_bytes: list[bytes], token_len: np.ndarray, n: np.ndarray, ids: np.ndarray, want: list[bytes], size: np.ndarray) -> np.ndarray:
    """Whether the tokens of each text spell it: all at once, or one by one if anything differs."""
    ends = np.cumsum(n)
    spelled = np.r_[0, np.cumsum(token_len[ids])][ends]
    if np.array_equal(spelled, np.cumsum(size)) and b"".join(map(token_bytes.__getitem__, ids.tolist())) == b"".join(want):
        return np.ones(len(want), bool)
    stops = np.r_[0, ends].tolist()
    return np.array([b"".join(map(token_bytes.__getitem__, ids[s:e].tolist())) == w for s, e, w in zip(stops, stops[1:], want, strict=False)], bool)


def align(v: Vocabulary, texts: list[str], spaced: list[bool], with_groups: bool, pieces: bool = False) -> Aligned:
    """Alignments of texts, put behind a space where spaced. right is false where the tokens do not spell the text.

    pieces: the texts are pieces by Vocabulary.cut.

    Between two neighbouring token ends one A and one B token overlap: each such stretch is a link. Ends of both cut groups.
    """
    whole = [" " + t if s else t for t, s in zip(texts, spaced, strict=True)]
    want = [w.encode() for w in whole]
    size = np.fromiter(map(len, want), np.int64, len(want))
    (n_a, a), (n_b, b) = v.encode_pieces(whole, size) if pieces else v.encode_a(whole), v.encode_b(texts, spaced)
    right = _spelled(v.a_bytes, v.a_len, n_a, a, want, size) & _spelled(v.b_bytes, v.b_len, n_b, b, want, size)
    if not right.all():
        a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
        n_a, n_b, size = (np.where(right, x, 0) for x in (n_a, n_b, size))
    end_a, end_b, end = np.cumsum(v.a_len[a]), np.cumsum(v.b_len[b]), np.cumsum(size)
    cuts = np.sort(np.r_[end_a, end_b], kind="stable")
    twice = np.r_[False, cuts[1:] == cuts[:-1]]
    both, cuts = cuts[twice], cuts[~twice]
    pairs = a[np.searchsorted(end_a, cuts)] * v.n_b + b[np.searchsorted(end_b, cuts)]
    n_links = np.bincount(np.searchsorted(end, cuts), minlength=len(texts))
    n_groups = np.bincount(np.searchsorted(end, both), minlength=len(texts))
    groups: list[str] = []
    if with_groups:
        group = np.r_[np.searchsorted(both, end_a), np.searchsorted(both, end_b)]
        last = np.isin(np.r_[end_a, end_b], both)
        code = np.r_[a + len(v.a_bytes) * last[: len(a)], 2 * len(v.a_bytes) + b + v.n_b * last[len(a) :]]
        order = np.argsort(2 * group + (np.arange(len(group)) >= len(a)), kind="stable")
        parts = v.written[code[order]].tolist()
        stops = np.r_[0, np.cumsum(n_a + n_b)].tolist()
        groups = ["".join(parts[s:e])[:-1] for s, e in zip(stops, stops[1:], strict=False)]
    return Aligned(right, n_a, n_b, n_groups, n_links, pairs, groups)


class _Pieces:
    """Alignments of the pieces seen by a task, with numbers for gathering; `score` adds columns made from the pairs."""

    def __init__(self, v: Vocabulary, with_groups: bool, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        self.v, self.with_groups, self.score = v, with_groups, score
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.empty((1024, 7), np.int64)
        self.pairs: list[np.ndarray] = []
        self.chars = 0

    def full(self) -> bool:
        return len(self.at) > PIECES or self.chars > PIECE_CHARS

    def rows(self, texts: list[str], spaced: list[bool], pieces: bool = False) -> tuple[np.ndarray, Aligned]:
        """(right, n_a, n_b, n_groups, n_links, n_best, count_sum) of each text, and the alignment itself."""
        found = align(self.v, texts, spaced, self.with_groups, pieces)
        more = self.score(found.pairs, found.n_links) if self.score else np.zeros((len(texts), 2), np.int64)
        return np.column_stack([found.right, found.n_a, found.n_b, found.n_groups, found.n_links, more]), found

    def learn(self, new: list[str]) -> None:
        rows, found = self.rows(new, [p[0] != "\n" for p in new], pieces=True)
        first = len(self.at)
        self.at.update(zip(new, range(first, first + len(new)), strict=True))
        while len(self.numbers) < first + len(new):
            self.numbers = np.concatenate([self.numbers, np.empty_like(self.numbers)])
        self.numbers[first : first + len(new)] = rows
        self.groups += found.groups
        self.pairs.append(found.pairs)
        self.chars += sum(map(len, new))


def _runs(texts: list[str | None]) -> Iterator[list[int]]:
    """Positions of the texts, in runs of about RUN characters."""
    run, held = [], 0
    for k, text in enumerate(texts):
        run.append(k)
        held += len(text or "")
        if held >= RUN:
            yield run
            run, held = [], 0
    if run:
        yield run


def _walk(texts: list[str | None], memory: _Pieces) -> Iterator[tuple[list[int], list[list[str] | None], list[str]]]:
    """For each run: its positions, the known pieces of each text (None if it is whole or has no tokens), whole texts."""
    for run in _runs(texts):
        pieces: list[list[str] | None] = []
        whole: list[str] = []
        for k in run:
            text = texts[k]
            cut = memory.v.cut(text) if text and SPACE not in text else None
            pieces.append(cut)
            if cut is None:
                whole.append(text if text and SPACE not in text else "")
        new = set().union(*(p for p in pieces if p is not None)).difference(memory.at)
        if new:
            memory.learn(list(new))
        yield run, pieces, whole


def _count_pairs(batches: Iterator[pa.RecordBatch], names: Tokenizers) -> Iterator[pa.RecordBatch]:
    """Documents -> (pair, n), the links of each distinct pair in what a task has read up to a point."""
    memory = _Pieces(Vocabulary.of(names), with_groups=False)
    seen = np.zeros(0, np.int64)
    loose: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        times = np.zeros(len(memory.at), np.int64)
        times[: len(seen)] = seen
        links = memory.numbers[: len(times), 4]
        codes = np.concatenate([*memory.pairs, *loose]) if memory.pairs or loose else np.empty(0, np.int64)
        weights = np.r_[np.repeat(times, links), np.ones(sum(map(len, loose)), np.int64)]
        pair, place = np.unique(codes[weights > 0], return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, place, weights[weights > 0])
        return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    for batch in batches:
        for _, pieces, whole in _walk(batch.column(0).to_pylist(), memory):
            parts = [np.fromiter(map(memory.at.__getitem__, p), np.int64, len(p)) for p in pieces if p is not None]
            parts = [p for p in parts if memory.numbers[p, 0].all()]
            now = np.bincount(np.concatenate(parts) if parts else np.empty(0, np.int64), minlength=len(memory.at))
            now[: len(seen)] += seen
            seen = now
            kept = [t for t in whole if t]
            if kept:
                loose.append(align(memory.v, kept, [True] * len(kept), False).pairs)
            if memory.full() or sum(map(len, loose)) > PIECE_CHARS:
                yield summed()
                memory.clear()
                seen, loose = np.zeros(0, np.int64), []
    yield summed()


_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def hash_longs(x: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the eight bytes of each number, as Spark's xxhash64 has it for longs with seed 42."""

    def turn(y: np.ndarray, bits: int) -> np.ndarray:
        return y << np.uint64(bits) | y >> np.uint64(64 - bits)

    p1, p2, p3, p4, p5 = _PRIMES
    with np.errstate(over="ignore"):
        h = (np.uint64(seed) + p5 + np.uint64(8)) ^ turn(x.astype(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)


class PerfectHash:
    """A minimal perfect hash of distinct longs: levels of bits, each set where exactly one of the keys left over falls.

    A key's number is the count of set bits before its own. About 3.5 bits a key. A long that is not a key gets a number
    of some key or none, so whoever asks has to compare keys.
    """

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.words = np.frombuffer(bits, np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            at = (hash_longs(keys, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(bits).tobytes() if bits else b"")

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level has a bit."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + (hash_longs(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left, start = left[~hit], start + size
        return out


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(hash_longs(pairs, 42).view(np.int64), shards)


def _built(group: pa.Table) -> pa.Table:
    """The distinct pairs of a shard -> its hash, and the pairs in the order of their numbers for verification."""
    keys = group.column("pair").to_numpy()
    made = PerfectHash.build(keys)
    ordered = np.empty(len(keys), np.int64)
    ordered[made.numbers(keys)] = keys
    shard = group.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int64()), "sizes": pa.array([made.sizes], pa.list_(pa.int64())), "bits": pa.array([made.words.tobytes()], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary())})


def _vectors(batches: Iterator[pa.RecordBatch], shards: int, hashes: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, n, task) -> for each shard at hand the dense vector of counts of what the task has read."""
    made = {s: PerfectHash(*x) for s, x in hashes.items()}
    sums = {s: np.zeros(int(h.before[-1]), np.int64) for s, h in made.items()}
    task = 0
    for batch in batches:
        pair, n, tasks = (batch.column(k).to_numpy() for k in range(3))
        if not len(pair):
            continue
        task, shard = int(tasks[0]), _shard_of(pair, shards)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            s = int(shard[part[0]])
            if s in made:
                np.add.at(sums[s], made[s].numbers(pair[part]), n[part])
    some = [s for s, x in sums.items() if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([task] * len(some), pa.int64()), pa.array([sums[s].tobytes() for s in some], pa.binary())], ["shard", "part", "counts"])


def _summed(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in group.column("counts")], axis=0)
    return pa.table({"shard": group.column("shard")[:1], "part": group.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def pair_table(docs: DataFrame, names: Tokenizers) -> tuple[DataFrame, int]:
    """((shard, sizes, bits, keys, counts), number of shards) of all id pairs linked anywhere in docs (text)."""
    spark = docs.sparkSession
    partial = stored(docs.select("text").mapInArrow(lambda it: _count_pairs(it, names), "pair long, n long"))
    distinct = stored(partial.select("pair").distinct())
    shards = max(1, -(-distinct.count() // SHARD))
    hashes = stored(
        distinct.withColumn("shard", F.pmod(F.xxhash64("pair"), F.lit(shards)).cast("long"))
        .groupBy("shard").applyInArrow(_built, "shard long, sizes array<long>, bits binary, keys binary")
    )
    numbered = partial.withColumn("task", F.spark_partition_id().cast("long"))
    tasks, out = partial.rdd.getNumPartitions(), None
    for first, last in _slices(shards):
        here = {r.shard: (list(r.sizes), bytes(r.bits)) for r in hashes.where(F.col("shard").between(first, last)).select("shard", "sizes", "bits").collect()}
        held = spark.sparkContext.broadcast(here)
        vectors = numbered.mapInArrow(lambda it, held=held: _vectors(it, shards, held.value), "shard long, part long, counts binary")
        parts = tasks
        while parts > 1:
            parts = -(-parts // FAN)
            vectors = vectors.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("shard", "part").applyInArrow(_summed, "shard long, part long, counts binary")
        out = vectors if out is None else out.union(vectors)
    return stored(hashes.join(out.select("shard", "counts"), "shard")), shards


def _slices(shards: int) -> list[tuple[int, int]]:
    """Ranges of shards that together hold about SLICE pairs."""
    step = max(1, SLICE // SHARD)
    return [(s, min(s + step, shards) - 1) for s in range(0, shards, step)]


def _best(batches: Iterator[pa.RecordBatch], n_b: int) -> Iterator[pa.RecordBatch]:
    """Shards -> the highest count of each B id in what the task has read."""
    best = np.zeros(n_b, np.int64)
    for batch in batches:
        for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
            np.maximum.at(best, np.frombuffer(keys.as_py(), np.int64) % n_b, np.frombuffer(counts.as_py(), np.int64))
    some = np.flatnonzero(best)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(best[some], pa.int64())], ["b", "best"])


class _Lookup:
    """Counts of the pairs of some shards; a pair of another shard has count 0."""

    def __init__(self, shards: int, rows: list[tuple], best: np.ndarray, n_b: int):
        self.shards, self.best, self.n_b = shards, best, n_b
        self.of = {s: (PerfectHash(sizes, bits), np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)) for s, sizes, bits, keys, counts in rows}

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(pairs), np.int64), _shard_of(pairs, self.shards)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            held = self.of.get(int(shard[part[0]])) if len(part) else None
            if held is not None:
                number = held[0].numbers(pairs[part])
                known = (number >= 0) & (held[1][number] == pairs[part])
                out[part[known]] = held[2][number[known]]
        return out

    def score(self, pairs: np.ndarray, n_links: np.ndarray) -> np.ndarray:
        """(n_best, count_sum) of texts with so many links each."""
        unique, place = np.unique(pairs, return_inverse=True)
        counts = self.counts(unique)
        top = ((counts > 0) & (counts == self.best[unique % self.n_b]))[place]
        ends = np.cumsum(n_links)
        sums = [np.r_[0, np.cumsum(x)] for x in (top.astype(np.int64), counts[place])]
        return np.column_stack([s[ends] - s[ends - n_links] for s in sums])


def _measured(batches: Iterator[pa.RecordBatch], names: Tokenizers, lookup: Callable[[], _Lookup], last: bool) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text, n_best, count_sum) -> the same with sums of this slice added; at last with all columns."""
    memory = _Pieces(Vocabulary.of(names), last, lookup().score)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        numbers, digest = np.zeros((len(texts), 7), np.int64), [""] * len(texts)
        for run, pieces, whole in _walk(texts, memory):
            loose = iter(())
            if any(whole):
                rows, found = memory.rows([t or "a" for t in whole], [True] * len(whole))
                loose = zip(whole, rows, found.groups if last else whole, strict=True)
            for k, cut in zip(run, pieces, strict=True):
                if cut is None:
                    text, row, groups = next(loose, ("", None, ""))
                    if text and row[0]:
                        numbers[k], digest[k] = row, hashlib.sha256(groups.encode()).hexdigest()
                    continue
                at = [memory.at[p] for p in cut]
                rows = memory.numbers[at]
                if rows[:, 0].all():
                    numbers[k] = rows.sum(axis=0)
                    if last:
                        digest[k] = hashlib.sha256(";".join([memory.groups[i] for i in at]).encode()).hexdigest()
            if memory.full():
                memory.clear()
        n_best, count_sum = (pa.array(batch.column(2 + k).to_numpy() + numbers[:, 5 + k], pa.int64()) for k in (0, 1))
        if last:
            columns = [pa.array(numbers[:, k], pa.int64()) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, n_best, count_sum, pa.array(digest, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_best, count_sum], ["doc_id", "text", "n_best", "count_sum"])


def alignment_stats(docs: DataFrame, names: Tokenizers = Tokenizers()) -> DataFrame:
    """One row for each row of docs (doc_id, text): how its A and B tokens align and how common its links are.

    Columns: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Texts that are null or empty, or that a
    tokenizer does not spell back byte by byte, have zeros and an empty string, and their links count nowhere. Texts are
    read whole; those that come apart at spaces and line ends are aligned piece by piece, each distinct piece once in a
    task, which gives the same tokens. Rows with null or repeated ids are judged one by one; other columns are ignored.

    A first pass counts the linked pairs of each task. The distinct pairs, dealt into shards by hash, get a minimal perfect
    hash for each shard; the counts become dense vectors indexed by it, which a tree of sums makes one vector a shard. The
    second pass aligns the documents again and looks counts up, comparing keys. Pairs are bounded by the product of both
    vocabularies; they are held in slices of about SLICE of them, so a second pass over all documents follows for each
    slice beyond the first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table, shards = pair_table(docs, names)
    n_b = Vocabulary.of(names).n_b
    best = np.zeros(n_b, np.int64)
    found = table.select("keys", "counts").mapInArrow(lambda it: _best(it, n_b), "b long, best long").groupBy("b").agg(F.max("best").alias("best")).toPandas()
    best[found["b"].to_numpy(np.int64)] = found["best"].to_numpy(np.int64)
    at_hand = docs.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    slices = _slices(shards)
    for first, last in slices:
        rows = [(r.shard, list(r.sizes), bytes(r.bits), bytes(r["keys"]), bytes(r.counts)) for r in table.where(F.col("shard").between(first, last)).collect()]
        held = spark.sparkContext.broadcast((shards, rows, best, n_b))
        end = (first, last) == slices[-1]
        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" if end else "doc_id long, text string, n_best long, count_sum long"
        at_hand = at_hand.mapInArrow(lambda it, held=held, end=end: _measured(it, names, lambda: _Lookup(*held.value), end), schema)
        if not end:
            at_hand = stored(at_hand)
    return at_hand
