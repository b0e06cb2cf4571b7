"""The findings table and its roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.session import cut_lineage

COLUMNS = ["check", "sev", "card", "path", "msg"]


def finding(df: DataFrame, check, sev, path, msg, *extra: str) -> DataFrame:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return df.select(
        col(check).alias("check"),
        col(sev).alias("sev"),
        F.col("card"),
        col(path).alias("path"),
        col(msg).alias("msg"),
        *extra,
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*COLUMNS) for p in parts])


def numbered(df: DataFrame, order: list, name: str = "id") -> DataFrame:
    """The rows with their position, from 1, in an order that no single task sorts.

    Ranges of the order go to tasks, each sorts its own, and the counts of the ranges before it, one number for each
    range, are added. Rows that tie in the order share it out in any way; an order by all columns makes reruns agree.
    Finding the ranges reads the rows once more, so they are written before.
    """
    laid = cut_lineage(df).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = cut_lineage(laid).withColumn("_range", F.shiftright("_at", 33))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = laid.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = laid.join(F.broadcast(ranges.drop("_n")), "_range")
    return out.select((F.col("_before") + within + 1).alias(name), *(c for c in df.columns if c != name))


def with_ids(findings: DataFrame) -> DataFrame:
    """Findings with dense ids, by check, card, path, message and severity."""
    return numbered(findings, ["check", "card", "path", "msg", "sev"])


def report_rows(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """Findings in the order of the report: its cards, and within a card the gravest first, then by check."""
    rows = findings.join(scores.select("card", "score", "priority"), "card").withColumn("rank", by_key(lx.SEVERITY_RANK, F.col("sev"), 9))
    order = [F.desc("priority"), F.desc("score"), F.col("card"), F.col("rank"), F.col("check"), F.col("path"), F.col("msg")]
    return numbered(rows, order, "row").select("row", *COLUMNS)


def by_key(table: dict, key: Column, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and by check in one pass (grouping sets), plus cards touched."""
    per = (
        findings.groupingSets([["sev"], ["check"], []], "sev", "check")
        .agg(F.count("*").alias("n"))
        .select(
            F.when(F.col("sev").isNotNull(), "sev")
            .when(F.col("check").isNotNull(), "check")
            .otherwise("total")
            .alias("facet"),
            F.coalesce("sev", "check", F.lit("all")).alias("value"),
            "n",
        )
    )
    cards = findings.agg(F.countDistinct("card").alias("n")).select(
        F.lit("cards").alias("facet"), F.lit("with findings").alias("value"), "n"
    )
    return per.unionByName(cards)


def severity_pivot(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy("check").pivot("sev", list(lx.SEVERITY_WEIGHT)).count().na.fill(0)
    )


def card_scores(findings: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """Weighted score per card; priority cards are flagged, not joined away."""
    out = findings.groupBy("card").agg(
        F.sum(by_key(lx.SEVERITY_WEIGHT, F.col("sev"), 0)).alias("score"),
        F.count("*").alias("n"),
        F.min(by_key(lx.SEVERITY_RANK, F.col("sev"), 9)).alias("worst_rank"),
    )
    if priority is None:
        return out.withColumn("priority", F.lit(False))
    flags = priority.select("card").distinct().withColumn("priority", F.lit(True))
    return out.join(flags, "card", "left").withColumn(
        "priority", F.coalesce("priority", F.lit(False))
    )


def report_order(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Report order: priority cards first, then score; ``top`` is the report's own top-k."""
    out = scores.orderBy(F.desc("priority"), F.desc("score"), "card")
    return out.limit(top) if top else out
