"""Change data: snapshot diff, compare-and-set edits, appends, merges and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.operators.tree import earlier_sum
from claimcheck.session import cut_lineage, one_long


# ------------------------------------------------------------------ snapshots
def _put(path, value: Column) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.struct(path.alias("field"), value.cast("string").alias("value"))


def _at(prefix: str, pos, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix + "["), F.col(pos).cast("string") if isinstance(pos, str) else pos.cast("string"), F.lit("]" + suffix))


def comparable_fields(t) -> DataFrame:
    """(card_key, field, value) of everything a reader or the map can show.

    Images are compared by length, pins as JSON. Each input table is one pass.
    """
    keys = t.person.select("card", "card_key")
    bios = [
        F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _bio_cell(c)) for c in ("bio", "bio_fr")
    ]
    scalars = F.array(
        *[_put(c, F.col(c)) for c in ["note", "note_fr", "mn", "mn_fr", "name", "years", "g"]],
        _put("profile.headline", F.col("headline")),
        _put("profile.headline_fr", F.col("headline_fr")),
    )
    parts = [t.person.select("card_key", F.inline(F.concat(scalars, *bios)))]

    def melt(df, cells):
        return df.join(keys, "card").select("card_key", F.inline(cells))

    src = F.array(_put(_at("src", "pos", ".l"), F.col("label")), _put(_at("src", "pos", ".u"), F.col("url")), _put(_at("src", "pos", ".q"), F.col("quote")))
    prof = F.array(
        _put(_at("psrc", "pos", ".label"), F.col("label")), _put(_at("psrc", "pos", ".label_fr"), F.col("label_fr")), _put(_at("psrc", "pos", ".url"), F.col("url"))
    )
    parts.append(melt(t.source, F.when(F.col("origin") == "src", src).otherwise(prof)))
    parts.append(
        melt(
            t.doc,
            F.array(
                *[_put(_at("docs", "pos", f".{c}"), F.col(c)) for c in ["cap", "cap_fr", "tr", "tr_fr", "u"]],
                _put(_at("docs", "pos", ".img.len"), F.length(F.coalesce("img", F.lit("")))),
            ),
        )
    )
    parts.append(melt(t.union_, F.array(*[_put(_at("union", "union_idx", f".{c}"), F.col(c)) for c in ["s", "sy", "n", "n_fr"]])))
    pin = F.to_json(F.struct("k", "t", "c", "y", "y2", "d", "x"))
    parts.append(
        melt(t.event, F.array(_put(_at("pl", "pos"), pin), _put(_at("pl", "pos", ".w"), F.col("w")), _put(_at("pl", "pos", ".w_fr"), F.col("w_fr"))))
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull())


def _bio_cell(column: str):
    return lambda text, i: _put(_at(column, i), text)


def latest_by_key(person: DataFrame, order: str = "card") -> tuple[DataFrame, DataFrame]:
    """Last row per card key, and the keys that occurred more than once."""
    per = person.groupBy("card_key").agg(F.max(order).alias(order), F.count("*").alias("n"))
    keep = person.join(per.select("card_key", order), ["card_key", order], "left_semi")
    return keep, per.where("n > 1").select("card_key", "n")


def snapshot_diff(
    before: DataFrame, after: DataFrame, keys_before: DataFrame | None = None, keys_after: DataFrame | None = None
) -> DataFrame:
    """Cards added and removed, and per field the before and after values.

    A key stands for one card here: where several share it, keep the last with ``latest_by_key`` first.
    ``before``/``after`` are (card_key, field, value), read once each: both sides are stacked and
    reduced by field. A card on one side only gives one row, not one per field; the key tables
    save a second pass over the fields when the caller has them.
    """
    side_a = before.select("card_key", "field", F.col("value").alias("a"), F.lit(None).cast("string").alias("b"))
    side_b = after.select("card_key", "field", F.lit(None).cast("string").alias("a"), F.col("value").alias("b"))
    fields = (
        side_a.unionByName(side_b)
        .groupBy("card_key", "field")
        .agg(F.max("a").alias("before"), F.max("b").alias("after"))
        .where(~F.col("before").eqNullSafe(F.col("after")))
    )
    ka = before if keys_before is None else keys_before
    kb = after if keys_after is None else keys_after
    present = (
        ka.select("card_key", F.lit(True).alias("a"), F.lit(False).alias("b"))
        .unionByName(kb.select("card_key", F.lit(False).alias("a"), F.lit(True).alias("b")))
        .groupBy("card_key")
        .agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    )
    null = F.lit(None).cast("string")
    whole = present.where(~(F.col("a") & F.col("b"))).select(
        "card_key", F.when(F.col("b"), "ADDED").otherwise("REMOVED").alias("kind"), null.alias("field"), null.alias("before"), null.alias("after")
    )
    both = present.where(F.col("a") & F.col("b")).select("card_key")
    changed = fields.join(both, "card_key", "left_semi").select("card_key", F.lit("CHANGED").alias("kind"), "field", "before", "after")
    return whole.unionByName(changed)


def diff_totals(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.countDistinct("card_key").alias("cards_changed"), F.count_if(F.col("kind") == "CHANGED").alias("fields_changed"),
        F.count_if(F.col("kind") == "ADDED").alias("added"), F.count_if(F.col("kind") == "REMOVED").alias("removed"),
    )


def map_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Entries of a keyed table whose JSON form differs, including one-sided ones."""

    def packed(df, name):
        return df.select(key, F.to_json(F.struct(*sorted(c for c in df.columns if c != key))).alias(name))

    return packed(before, "before").join(packed(after, "after"), key, "full_outer").where(
        ~F.col("before").eqNullSafe(F.col("after"))
    )


# ------------------------------------------------------------------ compare-and-set
PATHS = (
    r"^(?:bio(?:_fr)?\[\d+\]|(?:profile\.)?headline(?:_fr)?|note|note_fr|mn|mn_fr|name|years|g"
    r"|pl\[\d+\]\.(?:w|w_fr|c|k|t|d|y|y2|x)|union\[\d+\]\.(?:n|n_fr|s|sy)"
    r"|docs\[\d+\]\.(?:cap|cap_fr|tr|tr_fr|u)|src\[\d+\]\.(?:l|u|q)"
    r"|(?:profile\.sources|psrc)\[\d+\]\.(?:label|label_fr|url))$"
)
# Parts of a card that only a card with a profile has.
PROFILE_PARTS = r"^(?:profile\.|bio(?:_fr)?\[|psrc\[|docs\[)"
# What a field holds before any edit counts as an edit at this place.
START = "named_struct('ord', cast(-2147483648 as int), 'seq', -1L)"


def canonical_path(path: Column) -> Column:
    """One spelling for a leaf that edits may address in two ways."""
    path = F.regexp_replace(path, r"^headline(_fr)?$", "profile.headline$1")
    return F.regexp_replace(path, r"^profile\.sources\[", "psrc[")


def _tag(text: Column) -> Column:
    """A text as a key that tells null from every text."""
    return F.coalesce(F.concat(F.lit("="), text), F.lit("null"))


def _next_applied(edits: DataFrame) -> DataFrame:
    """edits with ``next``: the edit of the same field that is applied next if this one is.

    It is the nearest later one without guard, or whose guard is the value that this one leaves.
    """
    later = W.partitionBy("card", "path").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    free = edits.withColumn("free", F.last(F.when(~F.col("guarded"), F.col("at")), ignorenulls=True).over(later))
    gives = free.select("card", "path", "at", _tag(F.col("value")).alias("key"), F.lit(0).alias("want"), "free")
    wants = edits.where("guarded").select("card", "path", "at", _tag(F.col("expect")).alias("key"), F.lit(1).alias("want"), F.lit(None).cast(dict(edits.dtypes)["at"]).alias("free"))
    same = W.partitionBy("card", "path", "key").orderBy(F.desc("at"), "want").rowsBetween(W.unboundedPreceding, -1)
    met = gives.unionByName(wants).withColumn("match", F.last(F.when(F.col("want") == 1, F.col("at")), ignorenulls=True).over(same))
    return met.where("want = 0").select("card", "path", "at", F.least("free", "match").alias("next"))


def _applied(edits: DataFrame) -> DataFrame:
    """(card, path, at) of the edits that are applied: what the pointers of ``_next_applied`` reach from the start.

    Pointers are doubled, so log2(edits of a field) rounds of equi-joins find the chain of a field of any length.
    """
    longest = one_long(edits.groupBy("card", "path").agg(F.count("*").alias("n")), "n")
    hops = cut_lineage(_next_applied(edits))
    reached = hops.where(F.col("at") == F.expr(START)).select("card", "path", "at")
    for _ in range(max(1, longest).bit_length()):
        target = hops.select("card", "path", F.col("at").alias("next"), F.col("next").alias("over"))
        reached = cut_lineage(reached.union(hops.join(reached, ["card", "path", "at"], "left_semi").where("next is not null").select("card", "path", F.col("next").alias("at"))).distinct())
        hops = cut_lineage(hops.where("next is not null").join(target, ["card", "path", "next"]).select("card", "path", "at", F.col("over").alias("next")))
    return reached


def apply_edits(edits: DataFrame, current: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Compare-and-set: every edit's outcome, later edits seeing earlier ones.

    ``edits`` is (card, path, ord, seq, expect, value, why), (ord, seq) unique in a field; ``expect``
    null means the edit is unconditional unless a boolean ``guarded`` column says otherwise: then it
    asks for an absent field. A null value deletes. ``current`` is (card, path, text) and ``cards``
    the known cards. Paths come out in canonical spelling. Elements of lists must be there, and parts
    of a profile need a card that has one.
    """

    def lf(c):
        return F.regexp_replace(c, "\r\n", "\n")

    guarded = F.col("guarded") if "guarded" in edits.columns else F.col("expect").isNotNull()
    e = edits.withColumns({"guarded": guarded, "expect": lf("expect"), "legal": F.col("path").rlike(PATHS), "path": canonical_path(F.col("path"))})
    current = current.select("card", canonical_path(F.col("path")).alias("path"), lf("text").alias("text"))
    cards = cards if cards is not None else current.select("card")
    known = cards.select("card").distinct().withColumn("known", F.lit(True))
    element = F.regexp_extract("path", r"^(\w+(?:\.\w+)?\[\d+\])", 1)
    held = current.select("card", element.alias("parent")).where("parent <> ''").distinct().withColumn("has_parent", F.lit(True))
    profiles = current.where(F.col("path").rlike(PROFILE_PARTS)).select("card").distinct().withColumn("has_profile", F.lit(True))
    e = e.withColumn("parent", F.when(F.col("path").rlike(r"^bio"), "").otherwise(element))
    e = e.join(known, "card", "left").join(held, ["card", "parent"], "left").join(profiles, "card", "left")
    fits = (F.col("parent") == "") | F.coalesce("has_parent", F.lit(False))
    fits = fits & (~F.col("path").rlike(PROFILE_PARTS) | F.coalesce("has_profile", F.lit(False)))
    e = e.withColumns({"known": F.coalesce("known", F.lit(False)), "legal": F.col("legal") & fits})
    good = e.where(F.col("known") & F.col("legal")).select(
        "card", "path", F.struct(F.col("ord").cast("int").alias("ord"), F.col("seq").cast("long").alias("seq")).alias("at"), "ord", "seq", "guarded", "expect", "value", "why"
    )
    start = good.select("card", "path").distinct().join(current, ["card", "path"], "left").select("card", "path", F.expr(START).alias("at"), F.lit(False).alias("guarded"), F.lit(None).cast("string").alias("expect"), F.col("text").alias("value"))
    applied = _applied(start.unionByName(good.select(*start.columns))).withColumn("applied", F.lit(True))
    states = start.unionByName(good, allowMissingColumns=True).join(applied, ["card", "path", "at"], "left")
    before = W.partitionBy("card", "path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    states = states.withColumn("state", F.last(F.when(F.col("applied"), F.struct("value")), ignorenulls=True).over(before)).where(F.col("at") != F.expr(START))
    done = states.select("card", "path", "ord", "seq", F.when(F.col("applied"), "applied").otherwise("expect mismatch").alias("status"), F.col("state.value").alias("before"), "value", "why")
    bad = e.where(~F.col("known") | ~F.col("legal")).select(
        "card", "path", "ord", "seq", F.when(~F.col("known"), "card not found").otherwise("unknown path").alias("status"),
        F.lit(None).cast("string").alias("before"), "value", "why",
    )
    return done.unionByName(bad)


def merged_fields(current: DataFrame, outcome: DataFrame) -> DataFrame:
    """The field table after the applied edits; a null value deletes the field."""
    last = (
        outcome.where(F.col("status") == "applied")
        .groupBy("card", "path")
        .agg(F.max(F.struct("ord", "seq", "value")).alias("l"))
        .select("card", "path", F.lit(True).alias("edited"), F.col("l.value").alias("value"))
    )
    out = current.withColumn("path", canonical_path(F.col("path"))).join(last, ["card", "path"], "full_outer")
    text = F.when(F.coalesce("edited", F.lit(False)), F.col("value")).otherwise(F.col("text"))
    return out.select("card", "path", text.alias("text")).where(F.col("text").isNotNull())


def write_if_clean(outcome: DataFrame, merged: DataFrame, path: str) -> bool:
    """All or nothing: the merged table is written to a new version only when no edit failed."""
    if outcome.where(F.col("status") != "applied").limit(1).count():
        return False
    merged.write.mode("errorifexists").parquet(path)
    return True


def append_sources(source: DataFrame, appends: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append-source edits: rows go to the end of a card's list.

    ``appends`` is (card, seq, label, url, label_fr, to_profile); a profile append to a card
    without a profile is an error row, not an insert.
    """
    has = profiles.select("card").distinct().withColumn("has_profile", F.lit(True))
    a = appends.join(has, "card", "left").withColumn("has_profile", F.coalesce("has_profile", F.lit(False)))
    bad = a.where(F.col("to_profile") & ~F.col("has_profile"))
    rows = a.select("card", "seq", F.lit("src").alias("origin"), "label", "label_fr", "url").unionByName(
        a.where(F.col("to_profile") & F.col("has_profile")).select("card", "seq", F.lit("profile.sources").alias("origin"), "label", "label_fr", "url")
    )
    last = source.groupBy("card", "origin").agg((F.max("pos") + 1).alias("next"))
    rows = rows.withColumn("one", F.lit(1)).withColumn("slot", F.concat_ws("/", F.col("card").cast("string"), "origin"))
    rows = earlier_sum(rows, "slot", ["seq"], "one", "nth")
    new = rows.join(last, ["card", "origin"], "left").select(
        "card", "origin", (F.coalesce("next", F.lit(0)) + F.col("nth")).cast("bigint").alias("pos"), "label", "label_fr", "url", F.lit(None).cast("string").alias("quote")
    )
    return new, bad


def merge_places(place: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gazetteer edits: later values win column by column; unknown keys are errors."""
    cols = [c for c in edits.columns if c not in ("k", "seq")]
    last = edits.groupBy("k").agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))).alias(c) for c in cols]
    ).select("k", *[F.col(f"{c}.v").alias(f"new_{c}") for c in cols])
    out = place.join(last, "k", "left").select(
        *[F.coalesce(f"new_{c}", c).alias(c) if c in cols else F.col(c) for c in place.columns]
    )
    return out, edits.join(place.select("k"), "k", "left_anti")


def edit_history(edits: DataFrame, batches: DataFrame) -> DataFrame:
    """Every edit of the known batches in order, with its reason and kind of change."""
    df = edits.join(batches, "batch")
    change = (
        F.when(F.col("expect").isNotNull(), F.concat(F.lit("- "), "expect", F.lit(" + "), F.coalesce("value", F.lit("null"))))
        .otherwise(F.concat(F.lit("+ "), F.coalesce("value", F.lit("null")), F.lit("   (field did not exist)")))
    )
    return df.select(
        "card", "ord", "batch", "seq", "path", F.coalesce("why", F.lit("(no reason given)")).alias("why"), change.alias("change")
    )
