"""Rules over life spans, dated events and the family tree (no prose)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimcheck.functions import dates as dt
from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx
from claimcheck.functions import text as tx
from claimcheck.operators.findings import COLUMNS, by_key


def emit(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """Rows of findings from ``(condition, check, sev, path, msg)`` rules in one pass."""

    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    cells = [
        F.when(
            cond,
            F.struct(
                col(check).alias("check"),
                col(sev).alias("sev"),
                col(path).alias("path"),
                col(msg).alias("msg"),
            ),
        )
        for cond, check, sev, path, msg in rules
    ]
    hits = F.filter(F.array(*cells), lambda c: c.isNotNull())
    return df.select("card", F.inline(hits)).select(*COLUMNS)


def s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def pin_path(pos="pos", suffix: str = "") -> Column:
    return F.concat(F.lit("pl["), s(pos), F.lit("]" + suffix))


def spans(person: DataFrame) -> DataFrame:
    return person.select(
        "card", "years", dt.birth_year(F.col("years")).alias("b"), dt.death_year(F.col("years")).alias("d_")
    )


def dated(event: DataFrame) -> DataFrame:
    """Events with their first written date ``dd`` and the year it or the row gives."""
    return event.withColumn("dd", dt.first_date(F.coalesce("d", F.lit("")))).withColumn(
        "yr", F.coalesce("dd.y", "y")
    )


def event_vs_span(person: DataFrame, event: DataFrame) -> DataFrame:
    df = dated(event).where(~F.col("x") & F.col("yr").isNotNull()).join(spans(person), "card")
    yr, b, d = F.col("yr"), F.col("b"), F.col("d_")
    return emit(
        df,
        [
            (yr < b, "C5", "high", pin_path(), F.concat("t", F.lit(" dated "), s(yr), F.lit(", before the birth year "), s(b))),
            ((yr > d) & (F.col("t") != "burial"), "C5", "high", pin_path(), F.concat("t", F.lit(" dated "), s(yr), F.lit(", after the death year "), s(d))),
        ],
    )


def pin_notes(person: DataFrame, event: DataFrame) -> DataFrame:
    """Event rules that need only the event row and its card's life span."""
    df = dated(event).join(spans(person), "card")
    c, t, x, y, y2, b, d = (F.col(n) for n in ["c", "t", "x", "y", "y2", "b", "d_"])
    w, w_fr = F.coalesce("w", F.lit("")), F.coalesce("w_fr", F.lit(""))
    flat = rx.matches(tx.norm(w), lx.FLAT_DOCUMENT_READING)
    hedged = tx.is_hedged(w, F.lit("en")) | tx.is_hedged(w_fr, F.lit("fr"))
    dy = F.col("dd.y")
    in_span = (dy >= y) & (dy <= y2)
    span = F.concat(s(y), F.lit("–"), s(y2))
    rules = [
        ((c != "doc") | x, (w == "") | (w_fr == ""), "high", pin_path(), F.concat("c", F.when(x, "/alt").otherwise(""), F.lit(" pin has no bilingual note"))),
        ((c == "doc") & ~x, hedged, "high", pin_path(suffix=".w"), F.lit("[doc] pin whose own note hedges")),
        (c != "doc", flat & ~tx.is_hedged(w, F.lit("en")), "med", pin_path(suffix=".w"), F.concat(F.lit("["), "c", F.lit("] pin whose note asserts a document reading flatly"))),
        (t == "birth", y != b, "high", pin_path(), F.concat(F.lit("birth pin year "), s(y), F.lit(" ≠ dates line "), "years")),
        ((t == "death") & ~x, y.isNotNull() & d.isNull(), "high", pin_path(), F.concat(F.lit("death pin publishes "), s(y), F.lit(" but the dates line carries no death year ("), "years", F.lit(")"))),
        ((t == "death") & ~x, y != d, "high", pin_path(), F.concat(F.lit("death pin year "), s(y), F.lit(" ≠ dates line "), "years")),
        (dy != y, ~F.coalesce(in_span, F.lit(False)), "high", pin_path(), F.concat(F.lit("pin date "), "d", F.lit(" lies outside the pin's own "), F.when(y2.isNotNull(), F.concat(F.lit("span "), span)).otherwise(F.concat(F.lit("year "), s(y))))),
        (y2 < y, F.lit(True), "high", pin_path(), F.concat(F.lit("pin span reversed "), span)),
        (y2 - y > 15, rx.matches(F.concat(w, w_fr), lx.UNSOURCED_SPAN), "high", pin_path(), F.concat("c", F.lit(" span "), span, F.lit(" while its own note says the later years are unsourced"))),
        (~t.isin("burial", "death"), y > d, "med", pin_path(), F.concat("t", F.lit(" pin dated "), s(y), F.lit(", after the death year "), s(d))),
    ]
    return emit(df, [(a & b_, "C3", sev, path, msg) for a, b_, sev, path, msg in rules])


def _jdn(dd: str = "dd") -> Column:
    return dt.jdn(F.col(f"{dd}.y"), F.col(f"{dd}.m"), F.col(f"{dd}.d"))


def event_order(event: DataFrame) -> DataFrame:
    """Birth, baptism, death, burial out of order.

    Types are first reduced to their latest and earliest date per card (at most four rows), so
    no two events of a card are ever paired directly: each event that comes too early is set
    against the latest event of a lower type, and each further event that comes too late
    against the earliest event of a higher type.
    """
    rank = by_key(lx.LIFE_ORDER, F.col("t"), None).cast("int")
    ev = (
        dated(event.where(F.col("t").isin(*lx.LIFE_ORDER) & ~F.col("x")))
        .where(F.col("dd").isNotNull())
        .select("card", "pos", "t", "d", rank.alias("rank"), _jdn().alias("j"))
    )
    point = F.struct("j", "pos", "d")
    per = ev.groupBy("card", "t", "rank").agg(F.max(point).alias("last"), F.min(point).alias("first"))
    ends = per.select(
        "card",
        F.col("t").alias("ot"),
        F.col("rank").alias("orank"),
        "last",
        "first",
    )
    both = ev.join(ends, "card")
    low = both.where((F.col("orank") < F.col("rank")) & (F.col("last.j") > F.col("j"))).select(
        "card",
        F.col("ot").alias("a_t"), F.col("last.pos").alias("a_pos"), F.col("last.d").alias("a_d"),
        F.col("t").alias("b_t"), F.col("pos").alias("b_pos"), F.col("d").alias("b_d"),
    )
    own_last = per.select("card", "t", F.col("last.pos").alias("last_pos"))
    high = (
        both.where((F.col("orank") > F.col("rank")) & (F.col("first.j") < F.col("j")))
        .join(own_last, ["card", "t"])
        .where(F.col("pos") != F.col("last_pos"))
        .select(
            "card",
            F.col("t").alias("a_t"), F.col("pos").alias("a_pos"), F.col("d").alias("a_d"),
            F.col("ot").alias("b_t"), F.col("first.pos").alias("b_pos"), F.col("first.d").alias("b_d"),
        )
    )
    out = low.unionByName(high)
    return out.select(
        F.lit("C5").alias("check"),
        F.lit("high").alias("sev"),
        "card",
        F.concat(pin_path("a_pos"), F.lit(" vs "), pin_path("b_pos")).alias("path"),
        F.concat("a_t", F.lit(" ("), "a_d", F.lit(") falls after "), "b_t", F.lit(" ("), "b_d", F.lit(")")).alias("msg"),
    )


def gap_days(event: DataFrame) -> DataFrame:
    """Baptism against birth, burial against death: first dated row of each type."""
    ev = dated(event.where(F.col("t").isin(*lx.LIFE_ORDER))).where(F.col("dd").isNotNull())
    row = F.struct("pos", "d", _jdn().alias("j"))
    first = ev.groupBy("card").agg(
        *[F.min(F.when(F.col("t") == t, row)).alias(t) for t in lx.LIFE_ORDER]
    )

    def rules(a, b, verb, limit, noun):
        gap = F.col(f"{b}.j") - F.col(f"{a}.j")
        path = pin_path(F.col(f"{b}.pos"))
        ad, bd = F.col(f"{a}.d"), F.col(f"{b}.d")
        return [
            (gap < 0, "C5", "high", path, F.concat(F.lit(f"{verb} "), bd, F.lit(f" — before the {noun} "), ad)),
            (gap > limit, "C5", "med", path, F.concat(F.lit(f"{verb} "), s(gap), F.lit(f" days after {noun} ("), ad, F.lit(" → "), bd, F.lit(")"))),
        ]

    return emit(
        first,
        rules("birth", "baptism", "baptised", 120, "birth")
        + rules("death", "burial", "buried", 60, "death"),
    )


def parent_child(person: DataFrame, union_: DataFrame) -> DataFrame:
    """Each child edge against its parent's and the partner's years."""
    kids = person.where(F.col("parent_card").isNotNull()).select(
        F.col("card").alias("kid"),
        F.col("parent_card").alias("card"),
        "union_idx",
        "child_idx",
        F.concat_ws(" ", "name", "years").alias("who"),
        dt.birth_year(F.col("years")).alias("cb"),
    )
    parents = spans(person).select("card", F.col("b").alias("pb"), F.col("d_").alias("pd"))
    partner = union_.select(
        "card", "union_idx", "s", dt.birth_year(F.col("sy")).alias("sb"), dt.death_year(F.col("sy")).alias("sd")
    )
    df = (
        kids.where(F.col("cb").isNotNull())
        .join(parents, "card")
        .join(partner, ["card", "union_idx"], "left")
    )
    cb, pb, pd, sb, sd = (F.col(c) for c in ["cb", "pb", "pd", "sb", "sd"])
    path = F.format_string("unions[%d].c[%d]", "union_idx", "child_idx")
    lit = F.lit
    return emit(
        df,
        [
            (cb <= pb, "C5", "high", path, F.concat(lit("child "), "who", lit(" is born "), s(cb), lit(", not after the parent's "), s(pb))),
            ((cb > pb) & (cb - pb < 14), "C5", "high", path, F.concat(lit("parent would be "), s(cb - pb), lit(" at the birth of "), "who")),
            (cb > pd + 1, "C5", "high", path, F.concat(lit("child "), "who", lit(" born "), s(cb), lit(", "), s(cb - pd), lit(" years after the parent's death ("), s(pd), lit(")"))),
            (cb - sb < 14, "C5", "high", path, F.concat("s", lit(" would be "), s(cb - sb), lit(" at the birth of "), "who")),
            (cb - sb > 50, "C5", "med", path, F.concat("s", lit(" would be "), s(cb - sb), lit(" at the birth of "), "who")),
            (cb > sd, "C5", "high", path, F.concat("s", lit(" died "), s(sd), lit(", before the birth of "), "who", lit(" ("), s(cb), lit(")"))),
        ],
    )


def reversed_years(person: DataFrame) -> DataFrame:
    return emit(
        spans(person),
        [(F.col("d_") < F.col("b"), "C4", "high", "years", F.concat(F.lit("dates line reversed: "), "years"))],
    )


def claim_index(person: DataFrame, event: DataFrame) -> DataFrame:
    """One row per published fact: the dates line of each card and each event."""
    lines = person.select(
        F.col("card").alias("person"), F.lit("years").alias("fact"), F.col("years").alias("value"),
        F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("string").alias("cert"),
        F.lit("years").alias("where"),
    )
    rows = event.select(
        F.col("card").alias("person"), F.col("t").alias("fact"),
        F.coalesce("d", s("y"), F.lit("")).alias("value"),
        F.col("k").cast("bigint").alias("place"), F.col("c").alias("cert"),
        pin_path().alias("where"),
    )
    return lines.unionByName(rows)


# ------------------------------------------------------------------ trails
def previous_value(
    df: DataFrame, group: str, order: str, value: str, name: str, block: int = 4096
) -> DataFrame:
    """Value of the previous row per group, without one task per group.

    Rows are cut into blocks of the order column; inside a block ``lag`` answers, the first row
    of a block takes the last row of the previous non-empty block.
    """
    df = df.withColumn("_b", F.floor(F.col(order) / block))
    inner = W.partitionBy(group, "_b").orderBy(order)
    outer = W.partitionBy(group).orderBy("_b")
    tail = (
        df.groupBy(group, "_b")
        .agg(F.max(F.struct(order, value)).alias("_l"))
        .withColumn("_carry", F.lag("_l").over(outer))
        .select(group, "_b", F.col(f"_carry.{value}").alias("_carry"))
    )
    return (
        df.withColumn("_n", F.row_number().over(inner))
        .withColumn("_lag", F.lag(value).over(inner))
        .join(tail, [group, "_b"])
        .withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_b", "_n", "_lag", "_carry")
    )


def trail_order(event: DataFrame) -> DataFrame:
    """Rows dated before the row listed just above them."""
    df = previous_value(event.select("card", "pos", "t", "y"), "card", "pos", "y", "prev_y")
    return df.where(F.col("y") < F.col("prev_y"))


def after_death(event: DataFrame) -> DataFrame:
    death = (
        event.where(F.col("t") == "death").groupBy("card").agg(F.min("pos").alias("death_pos"))
    )
    return (
        event.where(~F.col("t").isin("death", "burial") & ~F.col("x"))
        .join(death, "card")
        .where(F.col("pos") > F.col("death_pos"))
        .select("card", "pos", "t", "k", "death_pos")
    )


def home_event(event: DataFrame) -> DataFrame:
    """One home row per card: birth, else baptism, else any, else an alternative."""
    live = ~F.col("x")
    rank = (
        F.when(live & (F.col("t") == "birth"), 0)
        .when(live & (F.col("t") == "baptism"), 1)
        .when(live, 2)
        .otherwise(3)
    )
    return (
        event.groupBy("card")
        .agg(F.min(F.struct(rank.alias("rank"), "pos", "t", "k")).alias("h"))
        .select("card", "h.rank", "h.pos", "h.t", "h.k")
    )


def sole_event(event: DataFrame, types: list[str] | None = None) -> DataFrame:
    types = types or list(lx.LIFE_ORDER)
    return (
        event.where(F.col("t").isin(types) & ~F.col("x"))
        .groupBy("card", "t")
        .agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
        .where(F.col("n") == 1)
        .select("card", "t", "pos")
    )


# ------------------------------------------------------------------ families
def family_counts(person: DataFrame) -> DataFrame:
    """Children, siblings with and without the person, by sex; all from per-parent sums."""
    is_f = (F.col("g") == "f").cast("int")
    per_union = (
        person.where(F.col("parent_card").isNotNull())
        .groupBy(F.col("parent_card").alias("card"), "union_idx")
        .agg(F.count("*").alias("n"), F.sum(is_f).alias("f"))
    )
    kids = per_union.groupBy("card").agg(
        F.sum("n").alias("children"),
        F.sum("f").alias("daughters"),
        F.array_sort(F.collect_set("n")).alias("per_union"),
    )
    sibs = kids.select(
        F.col("card").alias("parent_card"),
        F.col("children").alias("sib_n"),
        F.col("daughters").alias("sib_f"),
    )
    me_f = F.when(F.col("parent_card").isNull(), 0).otherwise((F.col("g") == "f").cast("int"))
    me_m = F.when(F.col("parent_card").isNull(), 0).otherwise((F.col("g") != "f").cast("int"))
    z = F.lit(0).cast("bigint")
    out = (
        person.select("card", "parent_card", "g")
        .join(kids, "card", "left")
        .join(sibs, "parent_card", "left")
    )
    children, daughters = F.coalesce("children", z), F.coalesce("daughters", z)
    sisters_all = F.coalesce("sib_f", z)
    brothers_all = F.coalesce("sib_n", z) - sisters_all
    return out.select(
        "card",
        children.alias("children"),
        (children - daughters).alias("sons"),
        daughters.alias("daughters"),
        brothers_all.alias("brothers_all"),
        (brothers_all - me_m).alias("brothers"),
        sisters_all.alias("sisters_all"),
        (sisters_all - me_f).alias("sisters"),
        "per_union",
    )


def place_join(event: DataFrame, place: DataFrame) -> DataFrame:
    """Event to gazetteer; an unknown key keeps its row."""
    from claimcheck.session import small_side

    return event.join(small_side(place.select("k", "n", "lat", "lon")), "k", "left")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(
        parent.select(F.col(parent_key).alias(key)), key, "left_anti"
    )


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def small_side_of(df: DataFrame) -> DataFrame:
    from claimcheck.session import small_side

    return small_side(df)
