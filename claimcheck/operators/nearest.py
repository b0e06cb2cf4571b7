"""Pairs of places of a card whose distance comes nearest to a stated one, found without making all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimcheck.functions import geo

#: Widths in degrees of the nested cells that places are laid into; each is a whole multiple of the next.
CELLS = (4.0, 0.25)
CLAIM = ["card", "km", "near"]
#: What rounding may do to a bound, in km.
SLACK_KM = 1e-6


def _cell(lat: Column, lon: Column, width: float) -> Column:
    return F.floor((lat + 90) / width) * F.lit(1 << 20) + F.floor((lon + 180) / width)


def _boxes(spots: DataFrame, level: int, side: str) -> DataFrame:
    """Number of places and the box around them for each cell of a card, columns prefixed by the side."""
    own = ["card", *(f"c{k}" for k in range(level + 1))]
    boxes = spots.groupBy(*own).agg(
        F.count("*").alias("n"), F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lon").alias("w"), F.max("lon").alias("e")
    )
    return boxes.select("card", *(F.col(c).alias(f"{side}_{c}") for c in boxes.columns if c != "card"))


def _apart(low: Column, high: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
    """Least and greatest difference of two numbers out of two ranges."""
    return F.greatest(low2 - high, low - high2, F.lit(0.0)), F.greatest(high2 - low, high - low2)


def _half_sine(degrees: Column) -> Column:
    return F.pow(F.sin(F.radians(degrees) / 2), 2)


def _cosines(low: Column, high: Column) -> tuple[Column, Column]:
    a, b = F.cos(F.radians(low)), F.cos(F.radians(high))
    return F.least(a, b), F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.greatest(a, b))


def box_distances(a: str, b: str) -> tuple[Column, Column]:
    """Bounds in km of the distance from any place in one box to any in another."""
    (sa, ta, wa, ea), (sb, tb, wb, eb) = ([F.col(f"{x}_{c}") for c in "stwe"] for x in (a, b))
    lat_least, lat_most = _apart(sa, ta, sb, tb)
    lon_least, lon_most = _apart(wa, ea, wb, eb)
    (cos_a, cos_a_most), (cos_b, cos_b_most) = _cosines(sa, ta), _cosines(sb, tb)
    # a difference of more than half a turn is shorter the other way round
    turn_least = F.least(_half_sine(lon_least), _half_sine(lon_most))
    turn_most = F.when((lon_least <= 180) & (lon_most >= 180), 1.0).otherwise(F.greatest(_half_sine(lon_least), _half_sine(lon_most)))
    least = _half_sine(lat_least) + cos_a * cos_b * turn_least
    most = _half_sine(lat_most) + cos_a_most * cos_b_most * turn_most
    return tuple(2 * geo.EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))) for h in (least, most))


def _still_open(met: DataFrame, most: int) -> DataFrame:
    """Pairs of cells that can hold one of the `most` nearest pairs of a claim that no pair is surely near to."""
    low, high = box_distances("a", "b")
    n = F.when(F.col("same"), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n"))
    met = met.withColumns({"least": F.greatest(low - F.col("km"), F.col("km") - high, F.lit(0.0)), "greatest": F.greatest(F.col("km") - low, high - F.col("km")), "n": n})
    place = F.row_number().over(W.partitionBy(*CLAIM).orderBy("greatest"))
    # the nearest few by their upper bound hold at least `most` pairs, unless there are fewer cell pairs than that
    best = met.select(*CLAIM, "n", "greatest").withColumn("place", place).where(F.col("place") <= most)
    reach = best.groupBy(*CLAIM).agg(F.sum("n").alias("held"), F.max("greatest").alias("far"), F.min("greatest").alias("sure"))
    bound = F.when(F.col("held") >= most, F.col("far") + SLACK_KM).otherwise(F.lit(float("inf")))
    return met.join(reach, CLAIM).where((F.col("sure") + SLACK_KM > F.col("near")) & (F.col("least") <= bound))


def nearest_pairs(asked: DataFrame, spots: DataFrame, most: int = 5) -> DataFrame:
    """(card, km, near): the pairs of places nearest to each stated distance that no two places of the card are near to.

    asked (card, km, near): a claim is near to a pair when they differ by up to `near`; spots (card, k, n, lat, lon), each place
    once. Cells of places are paired instead of places: where the bounds of a cell pair show a claim to be met it goes,
    and a cell pair too far off to be among the `most` nearest goes. What is left is paired again in smaller cells and at
    last place by place, so the result is exact. near is an array of (gap, s, d), the nearest first; a card with fewer
    than two places, and one with no claim, has no row.
    """
    asked = asked.select(*CLAIM).distinct()
    spots = spots.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    spots = spots.select("card", F.struct("k", "n", "lat", "lon").alias("spot"), "lat", "lon", *(_cell(F.col("lat"), F.col("lon"), width).alias(f"c{k}") for k, width in enumerate(CELLS)))
    kept = asked
    for level in range(len(CELLS)):
        a, b, c = _boxes(spots, level, "a"), _boxes(spots, level, "b"), f"c{level}"
        if level == 0:
            met = kept.join(a, "card").join(b, "card")
        else:
            up = f"c{level - 1}"
            met = kept.join(a.withColumnRenamed(f"a_{up}", "a_up"), ["card", "a_up"]).join(b.withColumnRenamed(f"b_{up}", "b_up"), ["card", "b_up"])
        same = F.col(f"a_{c}") == F.col(f"b_{c}")
        once = (F.col(f"a_{c}") < F.col(f"b_{c}")) | (same & (F.col("a_n") > 1))
        met = met.where(once if level == 0 else once | (F.col("a_up") != F.col("b_up"))).withColumn("same", same)
        kept = _still_open(met, most).select(*CLAIM, F.col(f"a_{c}").alias("a_up"), F.col(f"b_{c}").alias("b_up"))
    last = f"c{len(CELLS) - 1}"
    one, other = (spots.select("card", F.col(last).alias(f"{x}_up"), F.col("spot").alias(x)) for x in "ab")
    met = kept.join(one, ["card", "a_up"]).join(other, ["card", "b_up"]).where((F.col("a_up") != F.col("b_up")) | (F.col("a") < F.col("b")))
    first, second = F.least("a", "b"), F.greatest("a", "b")
    d = geo.haversine_km(first["lat"], first["lon"], second["lat"], second["lon"])
    met = met.select(*CLAIM, F.struct(F.abs(d - F.col("km")).alias("gap"), F.concat(first["n"], F.lit("→"), second["n"]).alias("s"), d.alias("d")).alias("pair"))
    place = F.row_number().over(W.partitionBy(*CLAIM).orderBy("pair"))
    nearest = met.withColumn("place", place).where(F.col("place") <= most).groupBy(*CLAIM).agg(F.sort_array(F.collect_list("pair")).alias("pairs"))
    return nearest.where(F.get("pairs", F.lit(0))["gap"] > F.col("near")).select("card", "km", F.col("pairs").alias("near"))
