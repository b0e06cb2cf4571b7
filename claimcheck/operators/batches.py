"""Edit batches of several kinds, judged as a whole, and published as one version of several tables."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.operators.changes import append_sources, apply_edits, merge_places, merged_fields

OUTCOME = "kind string, target string, path string, ord int, seq bigint, status string"


def typed_edits(batches: DataFrame) -> DataFrame:
    """batches (card, ord, seq, edit VARIANT) -> with op, path, key, expect, guarded, value VARIANT, profile_value VARIANT, why.

    An edit without op sets a field. ``expect`` may be absent (no guard), null (the field has to be absent) or a text.
    Values keep their JSON type until the applier of their op reads them.
    """

    def text(name: str):
        return F.try_variant_get("edit", f"$.{name}", "string").alias(name)

    def part(name: str):
        return F.try_variant_get("edit", f"$.{name}", "variant")

    return batches.select(
        "card", "ord", "seq", F.coalesce(text("op"), F.lit("set")).alias("op"), text("path"), text("key"), text("expect"), part("expect").isNotNull().alias("guarded"),
        part("value").alias("value"), part("profileValue").alias("profile_value"), text("why"),
    )


class Applied(NamedTuple):
    """What a batch makes of the tables, and what became of each edit (OUTCOME)."""

    fields: DataFrame
    source: DataFrame
    place: DataFrame
    outcome: DataFrame


def apply_batch(edits: DataFrame, fields: DataFrame, source: DataFrame, place: DataFrame, profiles: DataFrame) -> Applied:
    """Split typed edits by op and apply them: 'set' to fields, 'appendSource' to sources, 'gaz' to places.

    ``fields`` is (card, path, text), ``profiles`` the cards that have a profile. Edits of one op see those before them;
    a set edit does not see a source that the same batch appends. An op that is none of the three is an error, as are an
    append to an unknown card, or with a profile value to a card without profile, and a place that is not there.
    """
    order = F.struct("ord", "seq")
    cards = fields.select("card").distinct()
    sets = edits.where("op = 'set'").withColumn("value", F.try_variant_get("value", "$", "string"))
    done = apply_edits(sets.select("card", "path", "ord", "seq", "expect", "value", "why", "guarded"), fields, cards)
    field_rows = done.select(F.lit("set").alias("kind"), F.col("card").cast("string").alias("target"), "path", F.col("ord").cast("int").alias("ord"), F.col("seq").cast("long").alias("seq"), "status")

    def listed(column: str, name: str):
        return F.try_variant_get(column, f"$.{name}", "string")

    known = cards.withColumn("known", F.lit(True))
    has = profiles.select("card").distinct().withColumn("has_profile", F.lit(True))
    adds = edits.where("op = 'appendSource'").join(known, "card", "left").join(has, "card", "left")
    to_profile = F.col("profile_value").isNotNull()
    status = F.when(F.col("known").isNull(), "card not found").when(to_profile & F.col("has_profile").isNull(), "no profile").otherwise("applied")
    adds = adds.withColumn("status", status)
    add_rows = adds.select(F.lit("appendSource").alias("kind"), F.col("card").cast("string").alias("target"), F.lit("src").alias("path"), F.col("ord").cast("int").alias("ord"), F.col("seq").cast("long").alias("seq"), "status")
    nth = (F.col("ord").cast("long") * F.lit(1 << 32) + F.col("seq")).alias("seq")
    own = adds.where("known").select("card", nth, listed("value", "l").alias("label"), F.lit(None).cast("string").alias("label_fr"), listed("value", "u").alias("url"), F.lit(False).alias("to_profile"), F.lit("src").alias("origin"))
    deep = adds.where(to_profile & F.col("known") & F.col("has_profile")).select(
        "card", nth, listed("profile_value", "label").alias("label"), listed("profile_value", "label_fr").alias("label_fr"), listed("profile_value", "url").alias("url"), F.lit(False).alias("to_profile"), F.lit("profile.sources").alias("origin")
    )
    new = None
    for rows, origin in ((own, "src"), (deep, "profile.sources")):
        made, _ = append_sources(source.where(F.col("origin") == origin).withColumn("origin", F.lit("src")), rows.drop("origin"), profiles)
        made = made.withColumn("origin", F.lit(origin))
        new = made if new is None else new.unionByName(made)

    columns = [c for c in place.columns if c != "k"]
    kinds = dict(place.dtypes)
    merges = edits.where("op = 'gaz'").select(F.col("key").try_cast(kinds["k"]).alias("k"), F.col("key").alias("_key"), order.alias("seq"), *[F.try_variant_get("value", f"$.{c}", kinds[c]).alias(c) for c in columns])
    there = place.select("k", F.lit(True).alias("there"))
    place_rows = merges.join(there, "k", "left").select(
        F.lit("gaz").alias("kind"), F.col("_key").alias("target"), F.lit(None).cast("string").alias("path"), F.col("seq.ord").cast("int").alias("ord"), F.col("seq.seq").cast("long").alias("seq"),
        F.when(F.col("there"), "applied").otherwise("gaz key not found").alias("status"),
    )
    merged, _ = merge_places(place, merges.drop("_key"))
    other = edits.where("op not in ('set', 'appendSource', 'gaz')").select(
        F.col("op").alias("kind"), F.col("card").cast("string").alias("target"), "path", F.col("ord").cast("int").alias("ord"), F.col("seq").cast("long").alias("seq"), F.lit("unknown op").alias("status")
    )
    outcome = field_rows.unionByName(add_rows).unionByName(place_rows).unionByName(other)
    grown = source.unionByName(new.select(*[c for c in source.columns if c in new.columns]), allowMissingColumns=True)
    return Applied(merged_fields(fields, done), grown, merged, outcome)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], outcome: DataFrame | None = None) -> int | None:
    """Make the tables the next version under root, all of them or none; the version's number, or None if an edit failed.

    First the tables go to a folder that no reader knows. Then one row, the manifest, names that folder: readers see all
    tables of a version from the moment its manifest is committed. A run that dies in between leaves an unnamed folder and
    the former version. A version whose manifest is there is never written again; writers have to take turns.
    """
    if outcome is not None and not outcome.where("status <> 'applied'").isEmpty():
        return None
    version = (latest(spark, root) or 0) + 1
    folder = f"{root}/data/{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    manifest = spark.range(1).select(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.array(*map(F.lit, sorted(tables))).alias("tables"))
    manifest.coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/{version}")
    return version


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("version int, folder string, tables array<string>").json(f"{root}/manifests/*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest(spark: SparkSession, root: str) -> int | None:
    """The number of the last version that has a manifest."""
    found = _manifests(spark, root)
    row = found.agg(F.max("version").alias("v")).first() if found is not None else None
    return row.v if row else None


def published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version, the last by default."""
    version = version or latest(spark, root)
    if version is None:
        raise ValueError(f"nothing is published under {root}")
    row = _manifests(spark, root).where(F.col("version") == version).first()
    if row is None or name not in row.tables:
        raise ValueError(f"version {version} has no table {name}")
    return spark.read.parquet(f"{row.folder}/{name}")
