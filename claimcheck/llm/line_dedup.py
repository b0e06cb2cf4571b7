"""Removal of passages that a document shares, line for line, with an earlier document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import cut

#: A common block of lines is deleted from the later document if it has at least so many words.
MIN_WORDS = 50


def _fingerprints(lines: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]


def block_ends(n_words: list[int], min_words: int) -> list[int]:
    """For each line, the end of the shortest run of lines from it on that has min_words words; 0 if there is none."""
    ends, end, total = [], 0, 0
    for start, own in enumerate(n_words):
        while end < len(n_words) and total < min_words:
            total += n_words[end]
            end += 1
        ends.append(end if total >= min_words else 0)
        total -= own
        if end <= start:
            end, total = start + 1, 0
    return ends


def _run_hashes(prints: list[int], n_words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(hash, start, end) of each line with as many following lines as make up min_words words."""
    return [
        (xxhash.xxh3_64_intdigest(b"".join(p.to_bytes(8, "big", signed=True) for p in prints[start:end])) - (1 << 63), start, end)
        for start, end in enumerate(block_ends(n_words, min_words))
        if end and n_words[start]
    ]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (sorted by their first) in which the second increases too."""
    import bisect

    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tops, y)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[at], piles[at] = y, k
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines: equal ends first, then lines unique in both as anchors, then what lies between.

    Where no line is unique in both, the k-th occurrences of a line are paired.
    """
    aligned, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            aligned.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            aligned.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: list[dict[int, list[int]]] = [{}, {}]
        for found, lines, start, end in ((where[0], a, a0, a1), (where[1], b, b0, b1)):
            for k in range(start, end):
                found.setdefault(lines[k], []).append(k)
        common = [(x, where[1][line]) for line, x in where[0].items() if line in where[1]]
        anchors = [(x[0], y[0]) for x, y in common if len(x) == len(y) == 1] or [p for x, y in common for p in zip(x, y, strict=False)]
        if not anchors:
            continue
        chain = _increasing(sorted(anchors))
        aligned += chain
        marks = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        open_ += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(marks, marks[1:], strict=False) if x2 > x + 1 and y2 > y + 1]
    return sorted(aligned)


def common_blocks(earlier: list[int], later: list[int], n_words: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Positions of the later document's lines in aligned common blocks of at least min_words words.

    The alignment runs again over what is left until it finds no such block; passages that lie in another order, or
    twice, are so found as well. What no alignment keeps together is compared run by run at the end.
    """
    left, deleted = list(range(len(later))), set()
    while True:
        chain = patience(earlier, [later[k] for k in left])
        found, block = set(), []
        for x, y in [*chain, (-9, -9)]:
            if block and (x != block[-1][0] + 1 or y != block[-1][1] + 1 or left[y] != left[block[-1][1]] + 1):
                if sum(n_words[left[k]] for _, k in block) >= min_words:
                    found.update(left[k] for _, k in block)
                block = []
            block.append((x, y))
        if not found:
            break
        deleted |= found
        left = [k for k in left if k not in found]
    known = {line: [] for line in earlier}
    for k, line in enumerate(earlier):
        known[line].append(k)
    ends = block_ends(n_words, min_words)
    for start, end in enumerate(ends):
        if end and not deleted.issuperset(range(start, end)):
            run = later[start:end]
            for k in known.get(run[0], ()):
                if earlier[k : k + len(run)] == run:
                    while end < len(later) and k + end - start < len(earlier) and later[end] == earlier[k + end - start]:
                        end += 1
                    deleted.update(range(start, end))
                    break
    return sorted(deleted)


def _read(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """A row for each document with its lines' hashes and word counts and the hashes of its runs of lines."""
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for doc_id, print_, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
            n_words = [len(x.split()) for x in lines]
            if sum(n_words) < min_words:
                continue
            prints = _fingerprints(lines)
            for column, value in zip(columns, (doc_id.as_py(), print_.as_py(), prints, n_words, list({r[0] for r in _run_hashes(prints, n_words, min_words)})), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "print", "lines", "n_words", "runs"])


def _align(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        deleted = [common_blocks(*(x.as_py() for x in row), min_words) for row in zip(batch.column("earlier"), batch.column("later"), batch.column("n_words"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(deleted, pa.list_(pa.int32()))], ["doc_id", "print", "at"])


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, print, at): for documents that lose lines, the positions of these lines, from 0; print is the text's hash.

    A lone line is often common, so the rare hash that leads two documents together is that of a line with the lines
    after it, as many as make up min_words words. Every document that holds such a run is aligned with the first
    document that holds it: as many pairs as there are repeated runs at most, and none within the group. A common block of
    at least min_words words always has such a run.
    """
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")
    read = cut(keyed.mapInArrow(lambda it: _read(it, min_words), "doc_id long, print long, lines array<long>, n_words array<int>, runs array<long>").dropDuplicates(["doc_id", "print"]))
    runs = read.select("doc_id", "print", F.explode("runs").alias("run"))
    first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    pairs = runs.join(first.select("run", "first"), "run").where("doc_id > first.doc_id").select("doc_id", "print", F.col("first.doc_id").alias("first_id"), F.col("first.print").alias("first_print")).distinct()
    firsts = read.select(F.col("doc_id").alias("first_id"), F.col("print").alias("first_print"), F.col("lines").alias("earlier"))
    both = pairs.join(firsts, ["first_id", "first_print"]).join(read.select("doc_id", "print", F.col("lines").alias("later"), "n_words"), ["doc_id", "print"])
    aligned = both.select("doc_id", "print", "earlier", "later", "n_words").mapInArrow(lambda it: _align(it, min_words), "doc_id long, print long, at array<int>")
    lines = aligned.select("doc_id", "print", F.explode("at").alias("at")).distinct()
    return lines.groupBy("doc_id", "print").agg(F.sort_array(F.collect_list("at")).alias("at"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text that is left, and n_lines, n_deleted (lines) and words_deleted.

    Of two documents the one with the greater doc_id is the later. Rows without doc_id have no place in that order and
    stay as they are; rows of one doc_id are not held against each other. A null text stays null and an empty one empty.
    A document may be left with an empty text; dropping it is the caller's matter. Columns of docs named like the added
    ones are replaced; all others stay.
    """
    lost = deleted_lines(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias("_lost_id"), F.col("print").alias("_print"), F.col("at").alias("_at"))
    lines = F.split("text", "\n")
    gone = F.filter(lines, lambda line, k: F.array_contains(F.col("_at"), k))
    count = F.size(F.array_remove(F.split(F.array_join(gone, "\n"), r"[\x20\x09-\x0D]+"), ""))
    joined = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("_lost_id")) & (F.xxhash64("text") == F.col("_print")), "left")
    kept = F.filter(lines, lambda line, k: ~F.array_contains(F.col("_at"), k))
    return joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "n_deleted": F.when(F.col("_at").isNull(), 0).otherwise(F.size("_at")).cast("long"),
            "words_deleted": F.when(F.col("_at").isNotNull(), count).otherwise(0).cast("long"),
            "text": F.when(F.col("_at").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        }
    ).drop("_lost_id", "_print", "_at")
