"""Dates, day numbers, life spans and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx
from claimcheck.functions import text as tx


def idiv(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


_MONTHS = {
    **{m[:4].lower(): i + 1 for i, m in enumerate(lx.MONTHS_EN)},
    **{tx.deaccent_str(m)[:4]: i + 1 for i, m in enumerate(lx.MONTHS_FR)},
}
_MONTHS3 = {k[:3]: v for k, v in _MONTHS.items() if k[:3] != "jui"}


def _month(raw: Column) -> Column:
    word = F.lower(tx.deaccent(F.regexp_extract(raw, r"(\p{L}{3,})", 1)))

    def lookup(table, key):
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), key)

    return F.coalesce(
        lookup(_MONTHS, F.substring(word, 1, 4)), lookup(_MONTHS3, F.substring(word, 1, 3))
    )


def find_dates(c: Column) -> Column:
    """``array<struct<y,m,d,raw,pos>>`` of every explicit date, in text order."""
    hits = rx.matches_with_pos(tx.norm(c), lx.DATE)
    return F.transform(hits, lambda h: _parts(h["raw"], h["pos"]))


def _parts(raw: Column, pos: Column) -> Column:
    day = F.coalesce(
        F.regexp_extract(raw, r"^(\d{1,2})", 1).try_cast("int"),
        F.regexp_extract(raw, r"\s(\d{1,2}),?\s", 1).try_cast("int"),
    )
    year = F.regexp_extract(raw, r"(\d{3,4})$", 1).cast("int")
    return F.named_struct(
        F.lit("y"), year, F.lit("m"), _month(raw), F.lit("d"), day, F.lit("raw"), raw, F.lit("pos"), pos
    )


def date_set(c: Column) -> Column:
    """Dates without offsets (cheaper where only the values count)."""
    raws = rx.all_matches(tx.norm(c), lx.DATE)
    return F.transform(raws, lambda r: _parts(r, F.lit(0)))


def first_date(c: Column) -> Column:
    raw = rx.first_match(tx.norm(c), lx.DATE)
    return F.when(raw != "", _parts(raw, F.lit(0)))


def find_years(c: Column) -> Column:
    return F.transform(rx.all_matches(tx.norm(c), lx.YEAR), lambda y: y.cast("int"))


def year_set(c: Column) -> Column:
    """Years plus the second half of ranges and decades, sorted and distinct."""
    t = tx.norm(c)
    ranges = F.transform(
        rx.all_matches(t, lx.YEAR_RANGE, 0),
        lambda m: F.concat(
            F.substring(m, 1, 2), F.regexp_extract(m, r"(\d{2})$", 1)
        ).cast("int"),
    )
    decades = F.transform(
        rx.all_matches(t, lx.DECADE, 0), lambda m: F.regexp_extract(m, r"(\d{4})", 1).cast("int")
    )
    return F.array_sort(F.array_distinct(F.concat(find_years(c), ranges, decades)))


def bare_numbers(c: Column) -> Column:
    """Small numbers that are neither clock times nor act numbers, sorted and distinct."""
    t = tx.norm(c)
    for i, p in enumerate(lx.CLOCK_TIMES):
        t = rx.replace(t, p, " ", ignore_case=i > 0)
    found = rx.all_matches(t, lx.BARE_NUMBER)
    return F.array_sort(
        F.array_distinct(
            F.transform(found, lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int"))
        )
    )


def jdn(y: Column, m: Column, d: Column) -> Column:
    """Gregorian day number; the day is added on, so 30 February simply overflows."""
    return F.unix_date(F.make_date(y, m, F.lit(1))) + d + 2440587


def jdn_julian(y: Column, m: Column, d: Column) -> Column:
    yy = y + F.when(m <= 2, 4799).otherwise(4800)
    return jdn(y, m, d) + idiv(yy, 100) - idiv(yy, 400) - 38


def in_julian_era(y: Column, m: Column) -> Column:
    return (y < 1682) | ((y == 1682) & (m <= 2))


def weekday(day_number: Column) -> Column:
    names = F.array(*[F.lit(n) for n in lx.WEEKDAYS])
    return F.element_at(names, (F.pmod(day_number, F.lit(7)) + 1).cast("int"))


def full_years(b: Column, e: Column) -> Column:
    """Completed years from struct ``b`` to struct ``e`` (fields y, m, d)."""
    early = (e["m"] < b["m"]) | ((e["m"] == b["m"]) & (e["d"] < b["d"]))
    return e["y"] - b["y"] - F.when(early, 1).otherwise(0)


_DIED_ONLY = rx.java(r"^d\.\s*\d{4}\z")
_DIED = rx.java(r"^(?:\d{4}\s*[–—-]\s*|d\.\s*)(\d{4})\z")
_EXACT = rx.java(r"^(?:\d{4}\s*[–—-]\s*(?:\d{4}|\?)|[bd]\.\s*\d{4})\z")
_CIRCA = rx.java(r"^c\.?\s*\d{4}")


def birth_year(years: Column) -> Column:
    """Birth year of a dates line: its first four digits, unless it is ``d. 1890``."""
    t = tx.norm(years)
    return F.when(~t.rlike(_DIED_ONLY), F.regexp_extract(t, r"(\d{4})", 1).try_cast("int"))


def death_year(years: Column) -> Column:
    return F.regexp_extract(tx.norm(years), _DIED, 1).try_cast("int")


def life_span(years: Column) -> Column:
    """``struct<b,d,approx,loose>`` from a dates line such as ``1820–1890`` or ``b. 1820``."""
    t = tx.norm(F.coalesce(years, F.lit("")))
    circa = t.rlike(_CIRCA)
    loose = t.rlike(r"\d{4}") & ~circa & ~t.rlike(_EXACT)
    return F.struct(
        birth_year(t).alias("b"), death_year(t).alias("d"), circa.alias("approx"), loose.alias("loose")
    )
