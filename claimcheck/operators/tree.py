"""Tree operators: sums along and below, intervals, paths, branches by marks and by heads, variant scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimcheck.session import cut_lineage


def _doubled(nodes: DataFrame, key: str, parent: str, more: list, grow) -> DataFrame:
    """Pointer doubling over (_k, _p, *more): ``grow`` makes the next state until no row has a pointer _p.

    After round i a pointer leads 2**i links up, so a tree of height h takes about log2(h) rounds. Every round is
    checkpointed. A pointer to a key that is not there ends. Pointers that stay open longer than the number of rows
    allows run in a circle.
    """
    state = cut_lineage(nodes.select(F.col(key).alias("_k"), F.col(parent).alias("_p"), *more))
    for _ in range(state.count().bit_length() + 1):
        if state.where("_p is not null").isEmpty():
            return state
        state = cut_lineage(grow(state))
    raise ValueError("parent links form a cycle")


def subtree_sums(nodes: DataFrame, key: str, parent: str, values: Sequence[str]) -> DataFrame:
    """(key, *values): each value summed over the node and all its descendants.

    Round i adds to each node what the nodes exactly 2**i below it have gathered, so no row is made for a pair of a node
    and its ancestor. Sums over many children combine map-side.
    """

    def grow(state: DataFrame) -> DataFrame:
        above = state.where("_p is not null")
        arriving = above.groupBy("_p").agg(*[F.sum(v).alias(f"_{v}") for v in values]).withColumnRenamed("_p", "_k")
        up = state.where("_p is not null").select(F.col("_k").alias("_p"), F.col("_p").alias("_next"))
        moved = above.join(up, "_p", "left").select("_k", F.col("_next").alias("_p"), *values)
        both = state.where("_p is null").unionByName(moved).join(arriving, "_k", "left")
        return both.select("_k", "_p", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])

    done = _doubled(nodes, key, parent, [F.col(v).cast("long").alias(v) for v in values], grow)
    return done.select(F.col("_k").alias(key), *values)


def path_sums(nodes: DataFrame, key: str, parent: str, values: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """(key, *values, *texts): values summed, texts joined, from the root down to the node itself."""
    grown = [*values, *texts]

    def grow(state: DataFrame) -> DataFrame:
        up = state.select(F.col("_k").alias("_p"), F.col("_p").alias("_next"), *[F.col(v).alias(f"_{v}") for v in grown])
        sums = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        joined = [F.concat(F.coalesce(f"_{t}", F.lit("")), t).alias(t) for t in texts]
        moved = state.where("_p is not null").join(up, "_p", "left").select("_k", F.col("_next").alias("_p"), *sums, *joined)
        return state.where("_p is null").unionByName(moved)

    done = _doubled(nodes, key, parent, [*[F.col(v).cast("long").alias(v) for v in values], *texts], grow)
    return done.select(F.col("_k").alias(key), *grown)


def nearest_mark(nodes: DataFrame, key: str, parent: str, mark: str) -> DataFrame:
    """(key, mark_of, mark): the nearest node, itself included, whose ``mark`` is not null; null where there is none above.

    Pointers stop at the first mark, so a branch within a branch keeps its own.
    """
    own = F.when(F.col(mark).isNotNull(), F.struct(F.col(key).alias("mark_of"), F.col(mark).alias("mark"))).alias("_m")
    nodes = nodes.withColumn(parent, F.when(F.col(mark).isNull(), F.col(parent)))

    def grow(state: DataFrame) -> DataFrame:
        up = state.select(F.col("_k").alias("_p"), F.col("_p").alias("_next"), F.col("_m").alias("_got"))
        moved = state.where("_p is not null").join(up, "_p", "left").select("_k", F.when(F.col("_got").isNull(), F.col("_next")).alias("_p"), F.col("_got").alias("_m"))
        return state.where("_p is null").unionByName(moved)

    done = _doubled(nodes, key, parent, [own], grow)
    return done.select(F.col("_k").alias(key), "_m.mark_of", "_m.mark")


def _steps(person: DataFrame, *more) -> DataFrame:
    """(card, parent_card, path, depth, *more): path is the last step of the card's path, depth 1 below another card."""
    step = F.concat(F.lit("/u"), F.col("union_idx").cast("string"), F.lit("c"), F.col("child_idx").cast("string"))
    top = F.col("parent_card").isNull()
    return person.select("card", "parent_card", F.when(top, F.lit("root")).otherwise(step).alias("path"), F.when(top, 0).otherwise(1).alias("depth"), *more)


def with_paths(person: DataFrame) -> DataFrame:
    """(card, path, depth): path is root/u0c1/... The paths themselves are as long as the tree is deep."""
    return path_sums(_steps(person), "card", "parent_card", ["depth"], ["path"]).select("card", "path", F.col("depth").cast("int").alias("depth"))


def descendant_counts(person: DataFrame) -> DataFrame:
    """(card, depth, descendants) of every card."""
    return tree_intervals(person).select("card", "depth", (F.col("size") - 1).alias("descendants"))


def earlier_sum(
    df: DataFrame, group: str, order: list[str], value: str, name: str, block: int = 4096
) -> DataFrame:
    """Exclusive running sum of ``value`` per group, in two levels.

    ``order`` ends in a dense-ish integer; rows are summed within blocks of it and the block
    totals are summed per group, so one big group is still spread over many tasks.
    """
    *lead, last = order
    df = df.withColumn("_block", F.floor(F.col(last) / block))
    keys = [group, *lead, "_block"]
    inner = W.partitionBy(*keys).orderBy(last).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(group).orderBy(*lead, "_block").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("_t"))
        .withColumn("_before", F.coalesce(F.sum("_t").over(outer), F.lit(0)))
        .drop("_t")
    )
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(totals, keys)
        .withColumn(name, F.col("_in") + F.col("_before"))
        .drop("_in", "_before", "_block")
    )


def _spans(person: DataFrame, texts: Sequence[str] = ()) -> DataFrame:
    """tree_intervals with ``path``, if texts asks for it, from the same pass down the tree."""
    person = cut_lineage(person.select("card", "parent_card", "union_idx", "child_idx"))
    there = person.select(F.col("card").alias("parent_card"))
    person = person.join(there, "parent_card", "left_semi").unionByName(person.join(there, "parent_card", "left_anti").withColumn("parent_card", F.lit(None).cast(dict(person.dtypes)["parent_card"])))
    sizes = subtree_sums(person.withColumn("size", F.lit(1)), "card", "parent_card", ["size"])
    top = F.col("parent_card").isNull()
    placed = person.join(sizes, "card").withColumns(
        {"_above": F.coalesce(F.col("parent_card").cast("string"), F.lit("root")), "_union": F.when(top, 0).otherwise(F.col("union_idx")), "_child": F.when(top, F.col("card")).otherwise(F.col("child_idx"))}
    )
    offsets = earlier_sum(placed, "_above", ["_union", "_child"], "size", "before")
    starts = cut_lineage(_steps(offsets, "size", (F.col("before") + F.when(top, 0).otherwise(1)).alias("enter")))
    enters = path_sums(starts, "card", "parent_card", ["enter", "depth"], texts)
    return enters.join(starts.select("card", "size"), "card").select("card", *texts, F.col("depth").cast("int").alias("depth"), "size", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def tree_intervals(person: DataFrame) -> DataFrame:
    """(card, depth, size, enter, leave): the pre-order number of each card and of the last card below it.

    A card's interval lies within the intervals of all cards above it and apart from all others, so what lies below
    it is a comparison of numbers. A card comes after its parent and after the whole subtrees of its earlier siblings;
    several trees follow each other by card. A parent that is not in the table counts as none.
    """
    return _spans(person)


def preorder(person: DataFrame) -> DataFrame:
    """(card, path, depth, descendants, idx): idx is the pre-order number, root = 0, without a global sort."""
    return _spans(person, ["path"]).select("card", "path", "depth", (F.col("size") - 1).alias("descendants"), F.col("enter").alias("idx"))


def branch_filter(spans: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of ``spans`` (by tree_intervals) of the chosen branches and of the direct line above each head.

    A card lies in a branch where more heads' intervals have begun than ended, and above a head where heads begin within
    its own interval. Both are differences of running sums over the pre-order, taken by blocks; intervals of heads may
    contain each other, and no row is made for a pair of a head and a card.
    """
    found = spans.join(heads.select("card").distinct(), "card", "left_semi")
    changes = found.select(F.col("enter"), F.lit(1).alias("net"), F.lit(1).alias("heads")).unionByName(
        found.select((F.col("leave") + 1).alias("enter"), F.lit(-1).alias("net"), F.lit(0).alias("heads"))
    )
    changes = changes.groupBy("enter").agg(F.sum("net").alias("net"), F.sum("heads").alias("heads"))
    line = spans.select("enter", "leave").join(changes, "enter", "left").fillna(0, ["net", "heads"]).withColumn("one", F.lit(0))
    line = earlier_sum(earlier_sum(line, "one", ["enter"], "net", "open"), "one", ["enter"], "heads", "begun")
    upto = line.select(F.col("enter").alias("leave"), (F.col("begun") + F.col("heads")).alias("by_end"))
    kept = line.join(upto, "leave").where((F.col("open") + F.col("net") > 0) | (F.col("by_end") > F.col("begun")))
    return spans.join(kept.select("enter"), "enter", "left_semi")


def branches(person: DataFrame) -> DataFrame:
    """(card, head, branch): the nearest card above, itself included, that carries a navigation anchor."""
    return nearest_mark(person, "card", "parent_card", "anchor").select("card", F.col("mark_of").alias("head"), F.col("mark").alias("branch"))


def anchor_rules(person: DataFrame, required: DataFrame) -> DataFrame:
    """(anchor, cards, verdict) of each anchor that is required or that a card carries.

    ``required`` is (anchor). An anchor has to stand on one card: 'missing' on none, 'ambiguous' on several, as a
    branch that it names then has no single head; 'unknown' is an anchor that nothing requires.
    """
    carried = person.where("anchor is not null").groupBy("anchor").agg(F.count("*").alias("cards"))
    asked = required.select("anchor").distinct().withColumn("asked", F.lit(True))
    both = asked.join(carried, "anchor", "full_outer").withColumn("cards", F.coalesce("cards", F.lit(0)))
    verdict = F.when(F.col("asked").isNull(), "unknown").when(F.col("cards") == 0, "missing").when(F.col("cards") > 1, "ambiguous").otherwise("ok")
    return both.select("anchor", "cards", verdict.alias("verdict"))


def variant_tree(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Flatten recursive JSON documents (unions[].c[] nested to any depth).

    One round per level over all documents at once; a document never leaves its row, so many
    documents spread over the cluster.
    """
    level = docs.select(
        F.col(key).alias("doc"),
        F.lit("root").alias("path"),
        F.lit(None).cast("string").alias("parent_path"),
        F.parse_json(F.col(column)).alias("node"),
    )
    out = None
    while True:
        level = cut_lineage(level)
        if level.limit(1).count() == 0:
            break
        rows = level.select(
            "doc",
            "path",
            "parent_path",
            F.try_variant_get("node", "$.name", "string").alias("name"),
            F.try_variant_get("node", "$.years", "string").alias("years"),
        )
        out = rows if out is None else out.unionByName(rows)
        unions = level.select(
            "doc",
            "path",
            F.posexplode(F.try_variant_get("node", "$.unions", "array<variant>")).alias("u", "un"),
        )
        level = unions.select(
            "doc",
            "path",
            "u",
            F.posexplode(F.try_variant_get("un", "$.c", "array<variant>")).alias("c", "node"),
        ).select(
            "doc",
            F.format_string("%s/u%dc%d", "path", "u", "c").alias("path"),
            F.col("path").alias("parent_path"),
            "node",
        )
    return out if out is not None else docs.sparkSession.createDataFrame(
        [], "doc string, path string, parent_path string, name string, years string"
    )
