"""Coded map layers: outlines and place labels as deltas in thousandths of a degree, zig-zag, base-64 varints.

A digit is a character of ALPHABET; one whose sixth bit is set continues its number with higher bits. Everything is read
and written by built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.text import let
from claimcheck.operators.constraints import Rule
from claimcheck.operators.tree import earlier_sum

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Digits of numbers to the base 32, as SQL reads them; the sixth bit left aside, ALPHABET runs through them twice.
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Digits that continue a number, and those that end one.
MORE, LAST = "[g-z0-9+/]", "[A-Za-f]"
NUMBER = f"{MORE}*{LAST}"
#: Running sums within an array are taken over blocks of so many numbers.
BLOCK = 256


def _value(code: Column) -> Column:
    """The signed integer of one coded number."""
    n = F.conv(F.translate(F.reverse(code), ALPHABET, BASE32 * 2), 32, 10).cast("long")
    return let(n, lambda n: F.when(n % 2 == 1, -F.shiftright(n, 1) - 1).otherwise(F.shiftright(n, 1)))


def _sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs, block by block and then over the blocks' totals."""

    def scan(xs: Column, zero: Column) -> Column:
        start = F.struct(zero.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out")), lambda s: s["out"])

    n = F.floor((F.size(values) + BLOCK - 1) / BLOCK).cast("int")
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: scan(F.slice(values, k * BLOCK + 1, BLOCK), F.lit(0))))
    blocks = F.coalesce(blocks, F.array().cast("array<array<bigint>>"))
    totals = scan(F.transform(blocks, lambda b: F.element_at(b, -1)), F.lit(0))
    before = F.concat(F.array(F.lit(0).cast("long")), totals)
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, past: F.transform(b, lambda x: x + past)))


def decode(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ring, ord, lon, lat) rows of coded outlines, whose rings stand between bars.

    A null or empty outline has no points, an odd last number is left out. A text with another character, or a ring that
    ends inside a number, cannot be read and has none either: see ``unreadable``.
    """
    rings = df.where(~unreadable(F.col(column))).select(key, F.posexplode(F.split(F.col(column), "[|]")).alias("ring", "_code"))
    numbers = rings.select(key, "ring", F.transform(F.regexp_extract_all("_code", F.lit(NUMBER), F.lit(0)), _value).alias("_n"))

    def every_second(first: int) -> Column:
        return F.filter(F.col("_n"), lambda _, i: i % 2 == first)

    sums = numbers.select(key, "ring", _sums(every_second(0)).alias("_x"), _sums(every_second(1)).alias("_y"))
    points = sums.select(key, "ring", F.posexplode(F.slice(F.arrays_zip("_x", "_y"), 1, F.size("_y"))).alias("ord", "_p"))
    return points.select(key, "ring", "ord", (F.col("_p._x") / 1000).alias("lon"), (F.col("_p._y") / 1000).alias("lat"))


def unreadable(code: Column) -> Column:
    """Is there a character that is no digit, or a number without its last digit? True for null, which holds no code."""
    return F.coalesce(~F.rlike(code, F.lit(r"^[A-Za-z0-9+/|]*\z")) | F.rlike(code, F.lit(rf"{MORE}([|]|\z)")), F.lit(True))


def encode_outline(ring: Column | str) -> Column:
    """Inverse of the decoder for one ring, an array of (lon, lat)."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    flat = F.flatten(F.transform(ring, lambda p: F.array(F.rint(p["lon"] * 1000).cast("long"), F.rint(p["lat"] * 1000).cast("long"))))
    zeros = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    steps = F.filter(F.zip_with(flat, F.concat(zeros, flat), lambda a, b: a - b), lambda d: d.isNotNull())
    zigzag = F.transform(steps, lambda d: F.when(d < 0, -2 * d - 1).otherwise(2 * d))

    def code(n: Column) -> Column:
        last = F.ceil(F.length(F.bin(n)) / 5).cast("int") - 1
        digit = lambda k: F.floor(n / F.pow(F.lit(32.0), k)).cast("long") % 32 + F.when(k < last, 32).otherwise(0)
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.lit(ALPHABET), digit(k).cast("int") + 1, F.lit(1))), "")

    return F.array_join(F.transform(zigzag, code), "")


# ------------------------------------------------------------------ place labels
def label_records(layers: DataFrame, key: str, column: str) -> DataFrame:
    """(layer, pos, rec) of layers whose records stand between tabs, in the order of the text."""
    return layers.select(F.col(key).alias("layer"), F.posexplode(F.split(F.col(column), "\t")).alias("pos", "rec"))


def decode_labels(records: DataFrame) -> DataFrame:
    """records (layer, pos, rec) -> (layer, pos, rank, lon, lat, name, cc).

    A record is a digit, two coded numbers, and name and country behind tildes. The numbers are steps from the record
    before it, so places are running sums over a layer, taken by blocks of ``pos``. A record that cannot be read has null
    rank, and steps of 0; missing parts are null.
    """
    at = r"^([0-9])(" + NUMBER + ")(" + NUMBER + r")(?=~|\z)(?:~([^~]*))?(?:~([^~]*))?"

    def part(k: int) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce("rec", F.lit("")), at, k), F.lit(""))

    def step(k: int) -> Column:
        return F.coalesce(F.when(part(k).isNotNull(), _value(part(k))), F.lit(0).cast("long"))

    rows = records.select("layer", "pos", part(1).cast("int").alias("rank"), step(2).alias("dx"), step(3).alias("dy"), part(4).alias("name"), part(5).alias("cc"))
    placed = earlier_sum(earlier_sum(rows, "layer", ["pos"], "dx", "x"), "layer", ["pos"], "dy", "y")
    lon, lat = (F.col("x") + F.col("dx")) / 1000, (F.col("y") + F.col("dy")) / 1000
    return placed.select("layer", "pos", "rank", lon.alias("lon"), lat.alias("lat"), "name", "cc")


def layer_rules(boxes: list[tuple[str, float, float, float]] = (), least: int = 4, rings: int = 1) -> list[Rule]:
    """Rules on tables ``label`` (of decode_labels) and ``outline`` (of decode, with ring keys ``id``)."""
    near = [
        Rule(f"at least {least} labels around {name}", "label", f"abs(lon - ({lon})) < {half} AND abs(lat - ({lat})) < {half}", least)
        for name, lon, lat, half in boxes
    ]
    return [
        Rule("label rank is 0 to 6", "label", "coalesce(rank BETWEEN 0 AND 6, false)"),
        Rule("label has a name and a country", "label", "coalesce(name, '') <> '' AND coalesce(cc, '') <> ''"),
        Rule("label lies on the globe", "label", "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"),
        Rule("outline lies on the globe", "outline", "lat BETWEEN -90 AND 90 AND lon BETWEEN -180.5 AND 180.5"),
        Rule(f"at least {rings} rings", "outline", "struct(id, ring)", rings, distinct=True),
        *near,
    ]


def box_counts(points: DataFrame, boxes: list[tuple[str, float, float, float]]) -> DataFrame:
    """Points strictly inside each (name, lon, lat, half width) box, in one pass."""
    counts = [
        F.count_if((F.abs(F.col("lon") - lon) < d) & (F.abs(F.col("lat") - lat) < d)).alias(f"n{i}")
        for i, (_, lon, lat, d) in enumerate(boxes)
    ]
    row = points.agg(*counts)
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(b[0]).alias("box"), F.col(f"n{i}").alias("points")) for i, b in enumerate(boxes)]))
    )


def extents(points: DataFrame) -> DataFrame:
    ok = F.col("lon").between(-180.5, 180.5) & F.col("lat").between(-90, 90)
    return points.agg(
        F.bool_and(ok).alias("all_valid"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat")
    )
