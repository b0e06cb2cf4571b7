"""Everything about a card in one long table, and exact card lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions import dates as dt
from claimcheck.operators.cards import evidence, fields
from claimcheck.session import small_side

SECTIONS = ["family", "field", "pin", "evidence", "anchor", "finding", "change"]


def find_card(person: DataFrame, text: str, years: str | None = None, exact: bool = False) -> DataFrame:
    """The one card whose "name years" contains ``text`` (or whose name is it); else an error."""
    label = F.concat_ws(" ", "name", "years")
    cond = F.col("name") == text if exact else F.contains(F.lower(label), F.lit(text.lower()))
    if years is not None:
        cond = cond & (F.col("years") == years)
    hit = person.where(cond)
    few = hit.select(label.alias("id")).limit(6).collect()
    if len(few) != 1:
        raise LookupError("no card matches" if not few else "ambiguous: " + "; ".join(r["id"] for r in few[:5]))
    return hit


def dossier(t, findings: DataFrame | None = None, diff: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """(card, section, item, text): family, fields, pins, evidence, anchors, findings, changes.

    Long form on purpose: a card with very many rows never becomes one huge value. ``cards``
    restricts every section before it is built.
    """

    def only(df):
        return df if cards is None else df.join(cards.select("card"), "card", "left_semi")

    def rows(df, section: str, item: Column, text: Column):
        return df.select("card", F.lit(section).alias("section"), item.alias("item"), text.alias("text"))

    person = t.person
    brief = person.select("card", F.concat_ws(" ", "name", "years").alias("who"), "years")
    union_ = t.union_
    up = person.where(F.col("parent_card").isNotNull())
    parents = (
        only(up.select("card", "parent_card", "union_idx"))
        .join(brief.select(F.col("card").alias("parent_card"), F.col("who").alias("father"), F.col("years").alias("fy")), "parent_card")
        .join(union_.select(F.col("card").alias("parent_card"), "union_idx", "s", "sy"), ["parent_card", "union_idx"], "left")
    )
    kids = only(
        up.select(
            F.col("parent_card").alias("card"), "union_idx", "child_idx", F.concat_ws(" ", "name", "years").alias("who"), "years"
        )
    )
    slot = F.format_string("union[%d].c[%d]", "union_idx", "child_idx")
    b, d = dt.birth_year(F.col("years")), dt.death_year(F.col("years"))
    ev = only(t.event).join(small_side(t.place.select("k", F.col("n").alias("place"))), "k", "left")
    pin = F.concat(F.lit("pl["), F.col("pos").cast("string"), F.lit("]"))
    years = F.concat_ws("–", F.col("y").cast("string"), F.col("y2").cast("string"))
    parts = [
        rows(parents, "family", F.lit("parents"), F.concat_ws(" × ", "father", F.concat_ws(" ", "s", "sy"))),
        rows(only(union_), "family", F.format_string("union[%d]", "union_idx"), F.concat(F.concat_ws(" ", "s", "sy"), F.when(F.col("div_"), " [divorced]").otherwise(""))),
        rows(kids, "family", slot, F.col("who")),
        rows(only(fields(t)), "field", F.col("path"), F.col("text")),
        rows(ev, "pin", pin, F.concat_ws(" ", "t", F.lit("@"), "place", F.concat(F.lit("c="), "c"), F.when(F.col("x"), "x=ALT"), years, "d")),
        rows(only(evidence(t)), "evidence", F.col("path"), F.left("text", F.lit(400))),
        rows(only(brief), "anchor", F.lit("dates line"), F.format_string("%s (birth %s, death %s)", "years", F.coalesce(b.cast("string"), F.lit("?")), F.coalesce(d.cast("string"), F.lit("?")))),
        rows(parents, "anchor", F.lit("parents"), F.concat(F.lit("father: "), "fy", F.lit("   mother: "), F.coalesce("sy", F.lit("?")))),
        rows(kids, "anchor", slot, F.col("years")),
        rows(only(t.event).where("d IS NOT NULL"), "anchor", pin, F.concat("t", F.lit(": "), "d")),
    ]
    if findings is not None:
        parts.append(rows(only(findings), "finding", F.concat("sev", F.lit("/"), "check", F.lit(" "), "path"), F.col("msg")))
    if diff is not None:
        keyed = only(person.select("card", "card_key")).join(diff.where("field IS NOT NULL"), "card_key")
        parts.append(
            rows(keyed, "change", F.col("field"), F.concat(F.coalesce("before", F.lit("(absent)")), F.lit(" → "), F.coalesce("after", F.lit("(absent)"))))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
