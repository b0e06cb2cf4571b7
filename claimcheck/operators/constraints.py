"""Declared constraints over whole tables: one aggregate per table, unioned into one result."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx


@dataclass(frozen=True)
class Rule:
    """``holds`` is a row condition in SQL; with ``at_least`` the rule is a minimum count of rows
    that satisfy it, otherwise every row must. With ``distinct`` the minimum counts the different
    values of the expression ``holds`` instead."""

    name: str
    table: str
    holds: str
    at_least: int | None = None
    distinct: bool = False


def _filled(c: str) -> str:
    return f"coalesce({c}, '') <> ''"


def _translated(a: str, b: str) -> str:
    return f"NOT ({_filled(a)}) OR {_filled(b)}"


def _one_of(c: str, values: list[str]) -> str:
    return f"{c} IN ({', '.join(repr(v) for v in values)})"


def default_rules() -> list[Rule]:
    named_spouse = r"coalesce(note, '') RLIKE r'(re)?married\s+[A-Z]|\b(wife|husband|spouse)\s+[A-ZÉ]'"
    return [
        Rule("name is not empty", "person", _filled("name")),
        Rule("at least 108 people", "person", "true", 108),
        Rule("sex is f or m", "person", _one_of("g", ["f", "m"])),
        Rule("bio is bilingual, paragraph for paragraph", "person", "size(bio) = size(bio_fr)"),
        Rule("note has its translation", "person", _translated("note", "note_fr")),
        Rule("map note has its translation", "person", _translated("mn", "mn_fr")),
        Rule("note names no spouse", "person", f"NOT ({named_spouse})"),
        Rule("union note has its translation", "union_", _translated("n", "n_fr")),
        Rule("source has a label", "source", _filled("label")),
        Rule("source url is http(s)", "source", f"NOT ({_filled('url')}) OR url RLIKE '^https?://'"),
        Rule("profile source url is https", "source", f"origin <> 'profile.sources' OR NOT ({_filled('url')}) OR url LIKE 'https://%'"),
        Rule("document is captioned in both languages", "doc", f"{_filled('cap')} AND {_filled('cap_fr')}"),
        Rule("document is transcribed in both languages", "doc", f"{_filled('tr')} AND {_filled('tr_fr')}"),
        Rule("document image is embedded", "doc", "img RLIKE '^data:image/(jpeg|png);base64,'"),
        Rule("at least 10 people have documents", "doc", "card", 10, distinct=True),
        Rule("at least 20 documents", "doc", "true", 20),
        Rule("document link is https", "doc", f"NOT ({_filled('u')}) OR u LIKE 'https://%'"),
        Rule("place coordinates are valid", "place", "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"),
        Rule("place names are bilingual", "place", f"{_filled('n')} AND {_filled('n_fr')}"),
        Rule("place contexts are bilingual", "place", "c IS NOT NULL AND c_fr IS NOT NULL"),
        Rule("more than 100 places", "place", "true", 101),
        Rule("at least 380 events", "event", "true", 380),
        Rule("at least 90 people have a place trail", "event", "card", 90, distinct=True),
        Rule("at least 8 event types", "event", "t", 8, distinct=True),
        Rule("event certainty is known", "event", _one_of("c", lx.CERTAINTIES)),
        Rule("event type is known", "event", _one_of("t", lx.EVENT_TYPES)),
        Rule("event year is plausible", "event", "y IS NULL OR (y > 1400 AND y < 2100)"),
        Rule("event span does not run backwards", "event", "y2 IS NULL OR y IS NULL OR y2 >= y"),
        Rule("event note has its translation", "event", _translated("w", "w_fr")),
        Rule("uncertain or conflicting event explains itself", "event", f"(c = 'doc' AND NOT x) OR {_filled('w')}"),
        Rule("at least one disclosed conflict", "event", "x", 1),
        Rule("at least 80 homes are a birth or baptism", "home", _one_of("t", ["birth", "baptism"]), 80),
        Rule("at least 25 home places", "home", "k", 25, distinct=True),
    ]


def portrait_rules(forbidden_tag: str = "you") -> list[Rule]:
    """Rules on ``portrait`` (card, note, img, tag) and ``site`` (synced); where several cards are credited, each needs a picture."""
    credited = "lower(coalesce(note, '')) LIKE '%creator of this website%'"
    return [
        Rule("the maker of the site is credited", "portrait", credited, 1),
        Rule("portrait of the maker is embedded", "portrait", f"NOT ({credited}) OR img RLIKE '^data:image/(jpeg|png|webp);base64,'"),
        Rule("portraits are embedded", "portrait", f"NOT ({_filled('img')}) OR img LIKE 'data:image/%'"),
        Rule(f"no card has the tag {forbidden_tag}", "portrait", f"coalesce(tag, '') <> '{forbidden_tag}'"),
        Rule("sync date is written year-month-day", "site", "synced RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"),
    ]


def _held(rule: Rule) -> Column:
    if rule.distinct:
        return F.count_distinct(F.expr(rule.holds))
    return F.count_if(F.coalesce(F.expr(rule.holds), F.lit(False)))


def check_constraints(tables: dict[str, DataFrame], rules: list[Rule] | None = None) -> DataFrame:
    """(name, scope, violations, total): a missing minimum counts as that many violations."""
    rules = default_rules() if rules is None else rules
    parts = []
    for table in dict.fromkeys(r.table for r in rules):
        mine = [r for r in rules if r.table == table]
        held = [_held(r).alias(f"h{i}") for i, r in enumerate(mine)]
        row = tables[table].agg(F.count("*").alias("total"), *held)
        cells = [
            F.struct(
                F.lit(r.name).alias("name"),
                F.lit(table).alias("scope"),
                (
                    F.col("total") - F.col(f"h{i}")
                    if r.at_least is None
                    else F.greatest(F.lit(r.at_least) - F.col(f"h{i}"), F.lit(0))
                ).alias("violations"),
                F.col("total").alias("total"),
            )
            for i, r in enumerate(mine)
        ]
        parts.append(row.select(F.inline(F.array(*cells))))
    return reduce(lambda a, b: a.unionByName(b), parts)


def root_reach(person: DataFrame, paths: DataFrame) -> DataFrame:
    """(people, roots, descendants): in one whole tree there is one root, and all others descend from it."""
    below = F.count_if(F.col("depth") > 0)
    rows = person.select(F.col("parent_card").isNull().alias("root"), F.lit(None).cast("int").alias("depth")).unionByName(
        paths.select(F.lit(None).cast("boolean").alias("root"), F.col("depth").cast("int").alias("depth"))
    )
    return rows.agg(F.count("root").alias("people"), F.count_if("root").alias("roots"), below.alias("descendants"))


def uncited_people(person: DataFrame, source: DataFrame) -> DataFrame:
    """Everyone needs at least one card source."""
    return person.select("card", "name").join(source.where("origin = 'src'").select("card"), "card", "left_anti")


def undated_trails(event: DataFrame) -> DataFrame:
    """Cards with several stops and no year on any of them."""
    return event.groupBy("card").agg(F.count("*").alias("stops"), F.count("y").alias("dated")).where("stops > 1 AND dated = 0")


def misplaced_at_university(event: DataFrame, place: DataFrame) -> DataFrame:
    """Events at a university place that are neither study nor work."""
    from claimcheck.session import small_side

    uni = place.where(
        (F.col("kind") == "university") | F.lower(F.concat_ws(" ", "n", "c")).rlike(lx.UNIVERSITY)
    ).select("k")
    return event.where(~F.col("t").isin("study", "work")).join(small_side(uni), "k").select("card", "pos", "t", "k")


def duplicate_names(person: DataFrame) -> DataFrame:
    return person.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def home_summary(home: DataFrame) -> DataFrame:
    """How many cards have a home, how many homes are a true birth or baptism, how many places."""
    return home.agg(
        F.count("*").alias("homes"), F.count_if(F.col("t").isin("birth", "baptism")).alias("at_birth"), F.countDistinct("k").alias("places")
    )
