"""Removal of benchmark passages: which documents hold word windows of benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.llm.common import cut

# Fixed value: what separates words once A-Z are lower-cased; words hold 0-9, a-z and all beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of a window, and of the shingles that look for it.
WINDOW, SHINGLE = 13, 5
#: The benchmark's shingles are broadcast up to this number (about 40 MB). More of them are joined by a shuffle, behind a
#: broadcast table of at most so many masks of 64 bits, which few words that begin no shingle pass.
BROADCAST_SHINGLES, MASKS = 500_000, 1 << 20


def _tokens(text: Column) -> Column:
    """The words with their case, in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _lower(text: Column) -> Column:
    """Lower case of all scripts, for hashes. What a capital sigma becomes depends on what follows it, so it is replaced first."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def _gram_hash(array: str, at: Column, size: int) -> Column:
    """Hash of the words at..at+size-1 of an array of words that _lower() has been over; equal words have equal hashes."""
    return F.xxhash64(*(F.get(F.col(array), at + k) for k in range(size)))


def _slot_and_bit(hash_: Column) -> tuple[Column, Column]:
    """The mask a hash belongs to, and its bit there."""
    return F.pmod(hash_, F.lit(MASKS)).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hash_, 32), F.lit(64)).cast("int")).alias("bit")


def _likely(placed: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of placed whose hash has its bit in the masks of hashes: all that are among them, and few others."""
    masks = hashes.select(*_slot_and_bit(F.col("hash"))).groupBy("slot").agg(F.bit_or("bit").alias("mask"))
    slot, bit = _slot_and_bit(F.col("hash"))
    return placed.withColumn("slot", slot).join(F.broadcast(masks), "slot").where(F.col("mask").bitwiseAND(bit) != 0)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, window, size, at, width, hash, gram): the shingles of each window, at their place in it.

    An item's windows are its runs of WINDOW words; fewer words are one window, and a window of fewer than SHINGLE words
    one shingle. Equal windows of one item count once. Items without words have none.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    windows = items.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda k: F.slice("w", k, size))).alias("w"))
    windows = windows.withColumn("text", _ascii_lower(F.array_join("w", " "))).dropDuplicates(["item", "text"])
    width = F.least(F.col("size"), F.lit(SHINGLE))
    shingles = windows.select(
        "item", F.xxhash64("item", "text").alias("window"), "size", width.alias("width"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - width + 1), lambda k: F.slice("w", k, width))).alias("at", "s"),
    )
    lower = F.transform("s", _lower)
    hashed = F.lit(None).cast("long")
    for n in range(1, SHINGLE + 1):
        hashed = F.when(F.col("width") == n, F.xxhash64(*(F.get(lower, F.lit(k)) for k in range(n)))).otherwise(hashed)
    return shingles.select("item", "window", "size", "width", "at", hashed.alias("hash"), _ascii_lower(F.array_join("s", " ")).alias("gram"))


def shingle_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, print, pos, width, gram): every place of a document that has a benchmark shingle.

    The words of a text are looked up in one pass over it, without a shuffle while the shingles can be broadcast. With more
    shingles the places that the masks let through are shuffled, with their own words only.
    """
    widths = [r[0] for r in windows.select("width").distinct().collect()]
    keys = windows.select("width", "hash", "gram").distinct()
    small = keys.count() <= BROADCAST_SHINGLES
    found = None
    read = docs.select("doc", "print", _tokens(F.col("text")).alias("raw"), F.array_remove(F.split(_lower(F.coalesce("text", F.lit(""))), BETWEEN), "").alias("low"))
    for width in sorted(widths):
        own = keys.where(F.col("width") == width).select("hash", "gram")
        placed = read.select("doc", "print", "raw", "low", F.posexplode("low").alias("pos", "_word")).where(F.col("pos") <= F.size("low") - width)
        placed = placed.withColumn("hash", _gram_hash("low", F.col("pos"), width))
        here = _ascii_lower(F.array_join(F.slice("raw", F.col("pos") + 1, width), " "))
        if small:
            hit = placed.join(F.broadcast(own), "hash").where(here == F.col("gram"))
        else:
            hit = _likely(placed, own).select("doc", "print", "pos", "hash", here.alias("gram")).join(own, ["hash", "gram"])
        hit = hit.select("doc", "print", "pos", F.lit(width).alias("width"), "gram")
        found = hit if found is None else found.union(hit)
    return found


def item_occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, print, item, start, size): every occurrence of a window of an item in a document.

    Containment must be whole, so the necessary prefix of a window in the order of rarity is its rarest shingle: only
    where a document has that one is the window a candidate, at the place the shingle's position gives. A candidate
    stands if every shingle of the window is found at its own position.
    """
    windows = cut(benchmark_windows(benchmark))
    if windows.isEmpty():
        return docs.select("doc", "print", F.lit("").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("size")).limit(0)
    matches = cut(shingle_matches(docs, windows))
    counts = matches.groupBy("width", "gram").agg(F.count("*").alias("n"))
    # a window with a shingle that no document has cannot occur
    whole = windows.join(counts, ["width", "gram"]).withColumn("here", F.count("*").over(W.partitionBy("window"))).where(F.col("here") == F.col("size") - F.col("width") + 1)
    rarest = whole.groupBy("window").agg(F.min(F.struct("n", "gram", "at")).alias("r"), F.first("item").alias("item"), F.first("size").alias("size"), F.first("width").alias("width"))
    prefix = rarest.select("window", "item", "size", "width", F.col("r.gram").alias("gram"), F.col("r.at").alias("at"))
    candidates = matches.join(prefix, ["width", "gram"]).select("doc", "print", "window", "item", "size", "width", (F.col("pos") - F.col("at")).alias("start")).where("start >= 0").distinct()
    parts = candidates.join(windows.select("window", "at", "gram"), "window").withColumn("pos", F.col("start") + F.col("at"))
    there = matches.withColumnsRenamed({"doc": "_doc", "print": "_print"})
    verified = parts.join(there, parts["doc"].eqNullSafe(there["_doc"]) & (parts["print"] == there["_print"]) & (parts["pos"] == there["pos"]) & (parts["width"] == there["width"]) & (parts["gram"] == there["gram"]), "left_semi")
    return (
        verified.groupBy("doc", "print", "window", "start").agg(F.count("*").alias("n"), F.first("item").alias("item"), F.first("size").alias("size"), F.first("width").alias("width"))
        .where(F.col("n") == F.col("size") - F.col("width") + 1).select("doc", "print", "item", "start", "size")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    Null and empty texts have no words and are clean. Rows with equal ids are told apart by their texts; null ids take
    part. A null item_id counts for n_hit and is left out of the items. Added columns replace those of the same name.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"), "text")
    found = item_occurrences(keyed, benchmark).distinct()
    before = W.partitionBy("doc", "print").orderBy("start", "size").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    spans = found.groupBy("doc", "print", "start").agg(F.max("size").alias("size"))
    spans = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))))
    hits = spans.groupBy("doc", "print").agg(F.sum("new").alias("_hit"))
    items = found.where("item is not null").groupBy("doc", "print").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    both = hits.withColumnsRenamed({"doc": "_doc", "print": "_print"})
    items = items.withColumnsRenamed({"doc": "_d", "print": "_p"})
    both = both.join(items, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_print") == F.col("_p")), "left").drop("_d", "_p")
    joined = docs.withColumns({"_here": F.xxhash64("text"), "n_words": _n_tokens(F.col("text")).cast("long")}).join(both, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_here") == F.col("_print")), "left")
    joined = joined.withColumns(
        {
            "n_hit": F.coalesce("_hit", F.lit(0)).cast("long"),
            "n_items": F.when(F.col("_items").isNull(), 0).otherwise(F.size("_items")).cast("long"),
            "items_sha256": F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256),
        }
    )
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("_here", "_doc", "_print", "_hit", "_items")
