"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.llm.common import n_words

#: Sources, in order, weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source's size.
MOST_EPOCHS = 3
#: Sampling keys are summed in so many ranges before only the range at the budget's end is put in order.
RANGES = 1024
#: A quality label's weight in the sampling; documents without label weigh 1.
QUALITY = {1: 2.0, 0: 0.5}


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target. One row a source is all that meets in one task here.

    Sources in code-point order, null last, weigh 1, 2, 3 and so on again. All sizes together are shared out by weight;
    no target exceeds MOST_EPOCHS times its source's size, and what is cut off goes to the others by weight, until none
    is above: the level (what is left for a unit of weight) is the one at which the sources cut off are just those whose
    bound per weight lies below it.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    ranked = ranked.withColumn("bound", F.lit(float(MOST_EPOCHS)) * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    everything = W.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return ranked.select("source", "source_size", F.least(F.col("bound"), F.col("level") * F.col("weight")).alias("target"))


def sampling_key(doc_id: Column, quality: Column, seed: int) -> Column:
    """An exponential variate with rate `quality`, the same in every run; the least keys make the sample."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(16**13 + 1))
    return -F.log(uniform) / quality


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the words of the text, in place of columns that mixing adds."""
    return docs.drop("size", "source_size", "target", "taken").withColumn("size", n_words(F.col("text")))


def mix_sized(docs: DataFrame, quality: Column | None = None, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, size, ...) -> the same rows with source_size, target and taken.

    A source's target is made of as many complete epochs as fit, in which each document counts once; what remains is
    filled with documents in the order of their sampling keys, as far as that brings the sum nearer to the target. Sums
    are taken by ranges of the key first, so only the documents of one range of a source are put in order together.

    Documents of size 0 are never taken; a null source is a source; a null doc_id has a key of its own like any other,
    rows with equal ids are ordered by size. A null quality counts as 1.
    """
    weight = F.coalesce(quality, F.lit(1.0)) if quality is not None else F.lit(1.0)
    sized = docs.withColumn("_key", sampling_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), weight, seed))
    sized = sized.withColumn("_range", F.floor(F.lit(RANGES) * (1 - F.exp(-F.col("_key")))).cast("int"))
    sized = sized.withColumns({"_name": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    ranges = sized.groupBy("source", "_range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    placed = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)))
    placed = placed.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.select(
        F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none"), "_range", "source_size", "target", "epochs", "rest", "before",
        F.when(F.col("before") + F.col("range_size") <= F.col("rest"), "whole").when(F.col("before") > F.col("rest"), "none").otherwise("part").alias("how"),
    )
    found = sized.join(placed, ["_name", "_none", "_range"])
    split = W.partitionBy("_name", "_none", "_range", F.when(F.col("how") != "part", F.xxhash64("_key"))).orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.col("before") + F.coalesce(F.sum("size").over(split), F.lit(0))
    more = F.when(F.col("how") == "whole", 1).when(F.col("how") == "none", 0).when(2 * earlier + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)
    return found.withColumn("taken", ((F.col("epochs") + more) * F.col("size")).cast("long")).drop("_key", "_range", "_name", "_none", "epochs", "rest", "before", "how")


def label_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with _quality: the weight of the document's quality label, the best if it has several, or null."""
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_label"))
    weight = F.lit(None).cast("double")
    for label, value in QUALITY.items():
        weight = F.when(F.col("_label") == label, value).otherwise(weight)
    return docs.join(best, F.col("doc_id") == F.col("_labelled"), "left").withColumn("_quality", weight).drop("_labelled", "_label")


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same rows with size, source_size, target and taken, by mix_sized.

    Null and empty texts have size 0. The mix is made of rows without texts, which are dealt out once, when the numbers
    of words taken return to them; of rows that are equal in id, source and text any may be the one taken once more.
    Columns named like the added ones are replaced. labels (doc_id, quality) weigh the sampling.
    """
    known = [F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text"]
    docs = sized(docs).withColumns({"_row": F.xxhash64(F.lit(0), *known), "_row2": F.xxhash64(F.lit(1), *known)})
    rows = docs.select("doc_id", "source", "size", "_row", "_row2")
    mixed = mix_sized(rows, seed=seed) if labels is None else mix_sized(label_quality(rows, labels), F.col("_quality"), seed)
    least = F.min("taken").alias("_least")
    taken = mixed.groupBy("_row", "_row2").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), least, F.sum("taken").alias("_all"), F.count("*").alias("_n"))
    nth = F.row_number().over(W.partitionBy("_row", "_row2").orderBy("size"))
    found = docs.withColumn("_nth", nth).join(taken, ["_row", "_row2"])
    more = (F.col("_all") - F.col("_n") * F.col("_least") >= F.col("_nth") * F.col("size")) & (F.col("size") > 0)
    found = found.withColumn("taken", F.col("_least") + F.when(more, F.col("size")).otherwise(0))
    return found.drop("_row", "_row2", "_nth", "_least", "_all", "_n")
