"""Reversions: what keyed fields held before their correction, rebuilt and compared with the corrected base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a card that a reversion may address.
FIELDS = ("name", "years", "g", "note", "note_fr", "mn", "mn_fr", "headline", "headline_fr")


def legacy_key(years: str | Column = "years", name: str | Column = "name") -> Column:
    """The key under which a reversion names a card: years, a bar and the name; an absent part is empty."""
    return F.concat(F.coalesce(years, F.lit("")), F.lit("|"), F.coalesce(name, F.lit("")))


def keyed_fields(person: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(card, legacy_key, path, text) of the fields that cards hold now."""
    cells = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("text")) for f in fields])
    return person.select("card", legacy_key().alias("legacy_key"), F.inline(cells)).where("text is not null")


def resolve_keys(keys: DataFrame, person: DataFrame) -> DataFrame:
    """keys (legacy_key) -> (legacy_key, cards, card): how many cards the key names, and the first of them."""
    asked = keys.select("legacy_key").distinct()
    named = person.select(legacy_key().alias("legacy_key"), "card").join(asked, "legacy_key", "left_semi")
    found = named.groupBy("legacy_key").agg(F.count("*").alias("cards"), F.min("card").alias("card"))
    return asked.join(found, "legacy_key", "left").withColumn("cards", F.coalesce("cards", F.lit(0)))


def earlier_state(fields: DataFrame, legacy: DataFrame, person: DataFrame) -> DataFrame:
    """(legacy_key, path, earlier, now, change): the fields as they were before the corrections, beside the base.

    ``fields`` is (card, legacy_key, path, text); ``legacy`` is (legacy_key, kind, path, value, parent_key). A row of kind
    'value' overrides one field, a null value means that the field was absent; the last of equal rows is the greatest
    value. A row of kind 'phantom' is a card that the base no longer has. change is 'kept' for a field without reversion,
    'reverted', 'same' where the base still holds what was superseded, 'unresolved' where the key names no card (it
    changes nothing) and 'phantom'. A key that several cards share reverts each of them. Fields and reversions meet on
    (key, path) in one shuffle; cards that nothing reverts stay as they are.
    """
    values = legacy.where("kind = 'value'").groupBy("legacy_key", "path").agg(F.max(F.struct(F.lit(1), "value")).alias("v"))
    values = values.select("legacy_key", "path", F.col("v.value").alias("earlier"), F.lit(True).alias("asked"))
    met = fields.select("legacy_key", "path", F.col("text").alias("now")).join(values, ["legacy_key", "path"], "full_outer")
    known = person.select(legacy_key().alias("legacy_key"), F.lit(True).alias("known")).distinct()
    # only a reversion of an absent field has to look for its card
    there = met.where("now is not null").withColumn("known", F.lit(True))
    absent = met.where("now is null").join(known, "legacy_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    asked = F.coalesce("asked", F.lit(False))
    change = F.when(~F.col("known"), "unresolved").when(~asked, "kept").when(F.col("earlier").eqNullSafe(F.col("now")), "same").otherwise("reverted")
    both = there.unionByName(absent).select("legacy_key", "path", F.when(asked, F.col("earlier")).otherwise(F.col("now")).alias("earlier"), "now", change.alias("change"))
    phantom = legacy.where("kind = 'phantom'").select("legacy_key").distinct()
    cut = F.instr("legacy_key", "|")
    cells = F.array(
        F.struct(F.lit("years").alias("path"), F.nullif(F.substring("legacy_key", F.lit(1), cut - 1), F.lit("")).alias("earlier")),
        F.struct(F.lit("name").alias("path"), F.expr("substring(legacy_key, instr(legacy_key, '|') + 1)").alias("earlier")),
    )
    gone = phantom.select("legacy_key", F.inline(cells)).where("earlier is not null")
    return both.unionByName(gone.select("legacy_key", "path", "earlier", F.lit(None).cast("string").alias("now"), F.lit("phantom").alias("change")))


def legacy_rules(fields: DataFrame, legacy: DataFrame, person: DataFrame, provenance: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule, violations, total) of the reversions and of the provenance tags.

    Every key of a reversion names a card; what was superseded stands nowhere in the base; a corrected value is there for
    every reversion of a value; a phantom is in the base no more and hangs below a card that is; banners are bilingual;
    each tag of ``provenance`` (card, tag) stands on exactly as many cards as ``expected`` (tag, n) says.
    """
    state = earlier_state(fields, legacy, person)
    reverted = state.where("change in ('reverted', 'same')")

    def rule(name: str, rows: DataFrame, bad: Column) -> DataFrame:
        return rows.agg(F.lit(name).alias("rule"), F.count_if(bad).alias("violations"), F.count("*").alias("total"))

    phantom = legacy.where("kind = 'phantom'")
    parents = resolve_keys(phantom.where("parent_key is not null").select(F.col("parent_key").alias("legacy_key")), person)
    banner = legacy.where("kind = 'banner'").groupBy("legacy_key").agg(F.max(F.when(~F.endswith("path", F.lit("_fr")), F.col("value"))).alias("en"), F.max(F.when(F.endswith("path", F.lit("_fr")), F.col("value"))).alias("fr"))
    tags = provenance.groupBy("tag").agg(F.countDistinct("card").alias("cards")).join(expected, "tag", "full_outer")
    rules = [
        rule("legacy key resolves", resolve_keys(legacy.where("kind = 'value'"), person), F.col("cards") == 0),
        rule("superseded value is gone", reverted, F.col("change") == "same"),
        rule("corrected value is present", reverted.where("earlier is not null"), F.col("now").isNull()),
        rule("phantom is gone", resolve_keys(phantom, person), F.col("cards") > 0),
        rule("phantom parent resolves", parents, F.col("cards") == 0),
        rule("banner is bilingual", banner, F.coalesce(F.length("en"), F.lit(0)) * F.coalesce(F.length("fr"), F.lit(0)) == 0),
        rule("tag count is exact", tags, ~F.coalesce("cards", F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0)))),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def legacy_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (legacy_changed): whether two versions of the reversions differ as sets of rows."""
    columns = sorted(before.columns)
    a, b = (t.select(*columns).distinct().withColumn("_side", F.lit(k)) for k, t in ((1, before), (2, after)))
    alone = a.unionByName(b).groupBy(*columns).agg(F.sum("_side").alias("_sides")).where("_sides <> 3")
    return alone.agg((F.count("*") > 0).alias("legacy_changed"))
