"""Readers for the formats the record set comes in.

Each takes a SparkSession and a path (or a text table) and returns typed rows; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.session import cut_lineage, small_side


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one per file, as (doc, body)."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc"), F.col("value").alias("body")
    )


def gazetteer(docs: DataFrame, key: str, column: str) -> DataFrame:
    """The ``gaz`` map of each document to place rows."""
    entries = F.try_variant_get(F.parse_json(column), "$.gaz", "map<string,variant>")
    rows = docs.select(F.col(key).alias("doc"), F.explode(entries).alias("k", "v"))

    def field(name, kind):
        return F.try_variant_get("v", f"$.{name}", kind)

    return rows.select(
        "doc", "k", field("n", "string").alias("n"), field("n_fr", "string").alias("n_fr"),
        field("c", "string").alias("c"), field("c_fr", "string").alias("c_fr"),
        field("lat", "double").alias("lat"), field("lon", "double").alias("lon"),
        field("k", "string").alias("kind"),
    )


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated catalogue; ``#`` lines are comments, a bad dependents count is 0."""
    raw = spark.read.csv(
        path, sep="\t", comment="#", schema="risk string, dependents string, kind string, url string"
    )
    return raw.select(
        F.substring(F.sha1("url"), 1, 12).alias("id"), "url", "risk", "kind",
        F.coalesce(F.col("dependents").try_cast("int"), F.lit(0)).alias("dependents"),
    )


def capture_state(docs: DataFrame, column: str) -> DataFrame:
    """A capture-state map keyed by id, one row per capture."""
    entries = F.try_variant_get(F.parse_json(column), "$", "map<string,variant>")
    rows = docs.select(F.explode(entries).alias("id", "v"))

    def field(name, kind):
        return F.try_variant_get("v", f"$.{name}", kind).alias(name)

    return rows.select(
        "id", field("ok", "boolean"), field("file", "string"), field("host", "string"),
        field("bytes", "int"), field("fetched", "string"), field("result", "string"),
        field("url", "string"), field("dependents", "int"),
    ).withColumn("fetched", F.col("fetched").try_cast("timestamp"))


def stored_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Stored captures by file name, bytes decoded as UTF-8."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.decode("content", "UTF-8").alias("body"),
    )


def transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """Hand transcriptions, one text file per capture id."""
    rows = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"),
        F.col("value").alias("transcription"),
    )
    return rows.select(F.regexp_replace("file", r"\.txt$", "").alias("id"), "transcription")


def contract_sheets(sheets: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Contract blocks of source sheets (key, text) to (key, excludes, exempt, status).

    Unknown categories and sheets without a known prose name are dropped.
    """
    names = lx.SOURCE_NAMES if names is None else names
    block = F.regexp_extract("text", "```contract\\n([\\s\\S]*?)```", 1)

    def listed(field):
        line = F.trim(F.regexp_extract(block, rf"(?m)^{field}:\s*(.*)$", 1))
        items = F.filter(F.split(line, r"\s*[,|]\s*"), lambda v: v != "")
        return F.when(line.isin("", "(none)"), F.slice(items, 1, 0)).otherwise(items)

    known = F.array(*[F.lit(c) for c in lx.CLAIM_CATEGORIES])
    status = F.regexp_extract("text", r"(?im)^status:\s*(\w+)", 1)
    return sheets.where(F.col("key").isin(list(names))).select(
        "key",
        F.array_intersect(listed("excludes"), known).alias("excludes"),
        listed("exempt").alias("exempt"),
        F.when(status == "", "UNKNOWN").otherwise(status).alias("status"),
        (block != "").alias("has_contract"),
    )


def edit_batches(spark: SparkSession, path: str, order: DataFrame) -> DataFrame:
    """Edit files in batch order; ``order`` is (batch, ord). Files without an order are skipped."""
    raw = spark.read.option("multiLine", True).schema(
        "card string, edits array<struct<op:string,path:string,key:string,expect:string,value:string,why:string>>"
    ).json(path)
    rows = raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("batch"),
        "card",
        F.posexplode("edits").alias("seq", "e"),
    )
    return rows.join(small_side(order), "batch").select("batch", "ord", "card", "seq", "e.*")


def typed_edit_batches(spark: SparkSession, path: str, order: DataFrame) -> DataFrame:
    """Edit files of any op in batch order, as (batch, ord, card, seq, edit VARIANT) for ``typed_edits``.

    Values keep their JSON type, and a null stays apart from what is left out. Files without an order are skipped.
    """
    raw = spark.read.option("multiLine", True).schema("card string, edits array<variant>").json(path)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("batch"), "card", F.posexplode("edits").alias("seq", "edit"))
    return rows.join(small_side(order), "batch").select("batch", "ord", "card", F.col("seq").cast("long").alias("seq"), "edit")


def walk_documents(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """Every member of the objects and arrays of JSON documents, at any depth: (keep..., path, name, node VARIANT).

    ``name`` is the key in an object and null in an array; keys, whatever they are, stand decoded in ``path``. One round per
    level over all documents at once, and only objects and arrays go on to the next. Text that is not JSON has no members.
    """
    tvf = docs.sparkSession.tvf
    level = docs.select(*keep, F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("node"))
    out = None
    while True:
        inside = level.lateralJoin(tvf.variant_explode(F.col("node").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        members = cut_lineage(inside.select(*keep, F.concat("path", step).alias("path"), F.col("key").alias("name"), F.col("value").alias("node")))
        out = members if out is None else out.unionByName(members)
        level = members.where(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)")).drop("name")
        if level.isEmpty():
            return out


def harvest_labels(docs: DataFrame, column: str, *keep: str, name: str = "l") -> DataFrame:
    """Every string under a key ``l`` anywhere in JSON documents, decoded, as (keep..., path, label).

    Other values under the key are no labels; what they hold is walked like the rest.
    """
    found = walk_documents(docs, column, *keep).where(F.col("name") == name).where(F.schema_of_variant("node") == "STRING")
    return found.select(*keep, "path", F.try_variant_get("node", "$", "string").alias("label"))
