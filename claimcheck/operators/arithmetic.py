"""Rules that compute: weekdays, intervals, ages, distances, family counts, pins against prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions import dates as dt
from claimcheck.functions import geo
from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx
from claimcheck.functions import text as tx
from claimcheck.operators import names as nm
from claimcheck.operators.nearest import nearest_pairs

from claimcheck.operators.structure import emit, family_counts, pin_path, s
from claimcheck.session import cut_lineage, small_side

DATED_KINDS = ["bio", "mapnote", "tooltip", "union", "pin", "doctr", "srcquote", "doccap"]
QUOTED_KINDS = ["doctr", "srcquote"]


def _checked(units: DataFrame) -> DataFrame:
    """English sentences the arithmetic rules read; "[sic" marks the source itself wrong."""
    return units.where(
        (F.col("lang") == "en") & F.col("kind").isin(DATED_KINDS) & ~F.lower("sentence").contains("[sic")
    )


# ------------------------------------------------------------------ weekdays
def weekday_claims(units: DataFrame) -> DataFrame:
    """A weekday next to a full date, in the calendar of its time."""
    t = tx.norm(F.col("sentence"))
    days = r"\b(?:" + "|".join(lx.WEEKDAYS) + r")\b"
    df = _checked(units).where(rx.matches(F.col("sentence"), days) & rx.matches(t, lx.DATE))
    df = df.select(
        "card", "path", t.alias("t"),
        F.explode(rx.matches_with_pos(t, days)).alias("wd"), dt.find_dates(t).alias("dates"),
    )
    end = F.col("wd.pos") + F.length("wd.raw")
    # the date starts at most 3 characters after the weekday or ends at most 12 before it
    cand = F.transform(
        F.col("dates"),
        lambda d: F.struct(
            F.when(d["pos"] >= F.col("wd.pos"), d["pos"] - end)
            .otherwise(F.col("wd.pos") - d["pos"] - F.length(d["raw"]))
            .alias("gap"),
            d["pos"].alias("pos"),
            (d["pos"] >= F.col("wd.pos")).alias("after"),
            d.alias("d"),
        ),
    )
    near = F.array_min(
        F.filter(cand, lambda c: (c["gap"] >= 0) & (c["gap"] <= F.when(c["after"], 3).otherwise(12)))
    )
    ordinal = F.expr("substring(t, wd.pos + length(wd.raw) + 1)").rlike(
        rx.java(r"^\s*(?:the\s+)?\d{1,2}(?:st|nd|rd|th)\b")
    )
    df = df.where(~ordinal).withColumn("near", near).where(F.col("near").isNotNull()).select(
        "card", "path", F.col("wd.raw").alias("said"), "near.d.y", "near.d.m", "near.d.d", "near.d.raw"
    )
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    julian = dt.in_julian_era(y, m)
    df = df.withColumn("greg", dt.weekday(dt.jdn(y, m, d))).withColumn(
        "era", F.when(julian, dt.weekday(dt.jdn_julian(y, m, d))).otherwise(F.col("greg"))
    )
    off_era = F.lower("era") != F.lower("said")
    off_greg = F.lower("greg") != F.lower("said")
    said = F.concat(F.lit('"'), "said", F.lit(" "), "raw", F.lit('" — '))
    return emit(
        df,
        [
            (off_era & off_greg, "C4", "high", F.col("path"), F.concat(said, F.lit("Julian "), "era", F.lit(", Gregorian "), "greg")),
            (off_era & ~off_greg, "C4", "med", F.col("path"), F.concat(said, F.when(dt.in_julian_era(y, m), F.lit("era is Julian; Julian weekday is ")).otherwise("weekday is "), "era")),
        ],
    )


# ------------------------------------------------------------------ intervals
def interval_claims(units: DataFrame) -> DataFrame:
    """"N days/weeks/months/years" that no pair of dates of the sentence bears out.

    Pairs are tested inside the row with a short-circuit; only the first few candidates are
    rendered for the report.
    """
    t = tx.norm(F.col("sentence"))
    df = _checked(units).where(rx.matches(t, lx.INTERVAL))
    df = df.select("card", "path", "kind", t.alias("t"), dt.find_dates(t).alias("dates"), dt.find_years(t).alias("yrs"))
    nd, ny = F.size("dates"), F.size("yrs")
    df = df.where((nd >= 2) | ((nd >= 1) & (ny >= 2)))
    df = df.select("*", F.explode(rx.all_matches(F.col("t"), lx.INTERVAL, 0)).alias("said"))
    words = F.concat_ws(
        "-", F.nullif(rx.first_match(F.col("said"), lx.INTERVAL, 1), F.lit("")), F.nullif(rx.first_match(F.col("said"), lx.INTERVAL, 2), F.lit(""))
    )
    df = df.select(
        "*", tx.number_of(words).alias("num"),
        F.regexp_extract(F.lower("said"), r"(day|week|month|year)s?$", 1).alias("unit"),
    ).where(F.col("num").isNotNull())
    unit, num = F.col("unit"), F.col("num")

    def value(a, b):
        g = dt.jdn(b["y"], b["m"], b["d"]) - dt.jdn(a["y"], a["m"], a["d"])
        j = dt.jdn_julian(b["y"], b["m"], b["d"]) - dt.jdn_julian(a["y"], a["m"], a["d"])
        days = F.when(dt.in_julian_era(a["y"], a["m"]), j).otherwise(g)
        return (
            F.when(unit == "day", days.cast("double"))
            .when(unit == "week", days / 7)
            .when(unit == "month", ((b["y"] - a["y"]) * 12 + (b["m"] - a["m"])).cast("double"))
            .otherwise(dt.full_years(a, b).cast("double"))
        )

    slack = F.when(unit == "day", 1.01).otherwise(0.51)
    by_dates = F.exists(
        F.transform(F.col("dates"), lambda a, i: F.struct(a.alias("a"), i.alias("i"))),
        lambda p: F.exists(
            F.slice(F.col("dates"), p["i"] + 2, F.greatest(nd, F.lit(1))),
            lambda b: F.abs(value(p["a"], b) - num) < slack,
        ),
    )
    # years: some pair lies within one of N, whichever comes first
    by_years = (unit == "year") & F.exists(
        F.transform(F.col("yrs"), lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
        lambda p: F.exists(
            F.slice(F.col("yrs"), p["i"] + 2, F.greatest(ny, F.lit(1))),
            lambda w: F.abs(F.abs(w - p["v"]) - num) <= 1,
        ),
    )
    open_ended = rx.matches(F.col("t"), lx.OPEN_ENDED)
    first = F.col("dates")[0]
    shown = F.transform(
        F.slice(F.col("dates"), 2, 8),
        lambda b: F.concat(first["raw"], F.lit("→"), b["raw"], F.lit("="), F.round(value(first, b)).cast("bigint").cast("string"), F.left(unit, F.lit(1))),
    )
    df = df.where(~by_dates & ~by_years).select(
        "card", "path", "kind", "said", open_ended.alias("open"), F.array_join(F.array_distinct(shown), "; ").alias("shown")
    )
    sev = F.when(F.col("kind").isin(QUOTED_KINDS) | F.col("open"), "review").otherwise("med")
    note = F.when(F.col("open"), " (the other term is off-card — verify)").otherwise("")
    return emit(
        df,
        [(F.lit(True), "C4", sev, F.col("path"), F.concat(F.lit('"'), "said", F.lit('" matches no date pair in the sentence'), note, F.lit("; "), "shown"))],
    )


# ------------------------------------------------------------------ ages
def age_claims(c: Column) -> Column:
    """``array<struct<n,raw,pos,cue,quoted>>`` of age claims in one normalised sentence.

    Patterns are tried in order; a later match overlapping an accepted one is dropped.
    """
    t = tx.norm(c)

    def found(order, pattern, cue):
        one = rx.java(pattern)
        return F.transform(
            rx.matches_with_pos(t, pattern),
            lambda h: F.struct(
                h["raw"].alias("raw"),
                h["pos"].alias("pos"),
                tx.number_of(
                    F.concat_ws(
                        "-",
                        F.nullif(F.regexp_extract(h["raw"], one, 1), F.lit("")),
                        F.nullif(F.regexp_extract(h["raw"], one, 2), F.lit("")),
                    )
                ).alias("n"),
                F.lit(cue).alias("cue"),
            ),
        )

    cands = F.concat(*[found(i, p, cue) for i, (p, cue) in enumerate(lx.AGE_PATTERNS)])
    not_age, thing = rx.java(lx.NOT_AN_AGE), rx.java(lx.NOT_A_PERSON)

    def stands(h):
        after = F.substring(t, h["pos"] + F.length(h["raw"]) + 1, F.lit(22))
        begin = F.greatest(h["pos"] - 40, F.lit(0))
        before = F.substring(t, begin + 1, h["pos"] - begin)
        return h["n"].between(1, 110) & ~after.rlike(not_age) & ~before.rlike(thing)

    kept = F.filter(cands, stands)
    none = F.slice(kept, 1, 0)

    def take(acc, h):
        clash = F.exists(
            acc,
            lambda a: (h["pos"] < a["pos"] + F.length(a["raw"]))
            & (h["pos"] + F.length(h["raw"]) > a["pos"]),
        )
        return F.when(clash, acc).otherwise(F.array_append(acc, h))

    taken = F.aggregate(kept, none, take)

    def final(h):
        pre = F.substring(t, F.lit(1), h["pos"])
        marks = F.length(pre) - F.length(F.translate(pre, '"«»“”', ""))
        post = F.substring(t, h["pos"] + F.length(h["raw"]) + 1, F.length(t))
        quoted = (marks % 2 == 1) | post.rlike('^[^"«»“”]{0,25}["»”]')
        return F.struct(
            h["pos"].alias("pos"), h["n"].alias("n"), h["raw"].alias("raw"), h["cue"].alias("cue"), quoted.alias("quoted")
        )

    return F.array_sort(F.transform(taken, final))


AGE_HINT = "|".join(p for p, _ in lx.AGE_PATTERNS)
_NOT_NAME = r"^(?:" + "|".join(lx.NOT_A_NAME) + r")\b"


def name_runs(c: Column) -> Column:
    """Capitalised runs with offsets, function words and months removed."""
    runs = rx.matches_with_pos(tx.norm(c), lx.NAME_RUN, ignore_case=False)
    bad = rx.java(_NOT_NAME, False)
    return F.filter(runs, lambda r: ~r["raw"].rlike(bad))


def claims(fields: DataFrame) -> DataFrame:
    """One row per age claim with its sentence, nearest preceding name and kin word."""
    base = fields.where((F.col("lang") == "en") & F.col("kind").isin(DATED_KINDS)).where(
        rx.matches(F.col("text"), AGE_HINT)
    )
    units = base.select(
        "card", "path", "kind", "text", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence")
    )
    x = F.col("sentence")
    units = units.where(~F.lower(x).contains("[sic") & rx.matches(x, AGE_HINT))
    df = units.select("*", F.explode(age_claims(x)).alias("c"))
    near = F.element_at(
        F.filter(F.col("names"), lambda r: r["pos"] < F.col("c.pos")), -1
    )
    df = df.withColumn("names", name_runs(x))
    df = df.withColumn("name", F.when(F.exists("names", lambda r: r["pos"] < F.col("c.pos")), near["raw"]))
    start = F.greatest(F.col("c.pos") - 40, F.lit(0))
    window = F.substring(tx.norm(x), start + 1, F.col("c.pos") - start)
    kin = rx.first_match(window, lx.KIN_WORD, 0)
    tail = F.substring(window, F.instr(window, kin) + F.length(kin), F.length(window))
    ok = (kin != "") & (F.length(tail) <= 22) & ~rx.matches(tail, lx.KIN_TAIL_BREAK)
    return df.select(
        "card", "path", "kind", "text", "ord", "sentence",
        "c.n", "c.raw", "c.pos", "c.cue", "c.quoted", "name",
        F.when(ok, F.lower(rx.first_match(window, lx.KIN_WORD, 1))).alias("kin"),
    )


def _point(date: Column, year: Column, fallback: Column | None = None) -> Column:
    """Partial date: the first full date, else the year with month and day open."""
    none = F.lit(None).cast("int")
    full = F.struct(date["y"].alias("y"), date["m"].alias("m"), date["d"].alias("d"))
    only = F.struct(year.alias("y"), none.alias("m"), none.alias("d"))
    return F.when(date.isNotNull(), full).otherwise(F.when(year.isNotNull(), only))


def vitals(person: DataFrame, event: DataFrame) -> DataFrame:
    """Birth and death of every card: first dated row of the type, else the dates line."""
    def first(t):
        return F.min(F.when((F.col("t") == t) & (F.coalesce("d", F.lit("")) != ""), F.struct("pos", "d"))).alias(t)

    rows = event.where(F.col("t").isin("birth", "death")).groupBy("card").agg(first("birth"), first("death"))
    df = person.select("card", "g", "parent_card", "union_idx", "name", "years").join(rows, "card", "left")
    b, d = dt.first_date(F.col("birth.d")), dt.first_date(F.col("death.d"))
    return df.select(
        "card", "g", "parent_card", "union_idx", "name",
        _point(b, dt.birth_year(F.col("years"))).alias("born"),
        _point(d, dt.death_year(F.col("years"))).alias("died"),
    )


def _partner_vitals(union_: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")

    def only(y):
        return F.when(y.isNotNull(), F.struct(y.alias("y"), none.alias("m"), none.alias("d")))

    return union_.where(F.coalesce("s", F.lit("")) != "").select(
        "card", "union_idx", F.col("s").alias("name"),
        only(dt.birth_year(F.col("sy"))).alias("born"), only(dt.death_year(F.col("sy"))).alias("died"),
    )


def _subjects(v: DataFrame, partners: DataFrame) -> DataFrame:
    """All possible age subjects as (skey, born, died, n): equal life dates are one row.

    Keys: S self, U partner of a union, W all partners, C children by sex.
    """
    sex = F.when(F.col("g") == "f", "f").otherwise("m")
    card = F.col("card").cast("string")
    parent = F.col("parent_card").cast("string")
    own = v.select(F.concat(F.lit("S:"), card).alias("skey"), "born", "died")
    kids = v.where(F.col("parent_card").isNotNull()).select(
        F.concat(F.lit("C:"), parent, F.lit(":"), sex).alias("skey"), "born", "died"
    )
    one = partners.select(F.concat(F.lit("U:"), card, F.lit(":"), s("union_idx")).alias("skey"), "born", "died")
    every = partners.select(F.concat(F.lit("W:"), card).alias("skey"), "born", "died")
    rest = own.unionByName(kids).unionByName(one).unionByName(every)
    return rest.groupBy("skey", "born", "died").agg(F.count("*").alias("n"))


def _bearers(v: DataFrame, partners: DataFrame) -> DataFrame:
    """(key, born, died, n): the distinct life dates of everyone a name key may mean."""
    keyed = v.select(F.explode(nm.name_keys(F.col("name"))).alias("key"), "born", "died").unionByName(
        partners.select(F.explode(nm.name_keys(F.col("name"), spouse=True)).alias("key"), "born", "died")
    )
    return keyed.groupBy("key", "born", "died").agg(F.count("*").alias("n"))


def _age(b: Column, e: Column) -> Column:
    def filled(p):
        return F.struct(
            p["y"].alias("y"), F.coalesce(p["m"], F.lit(7)).alias("m"), F.coalesce(p["d"], F.lit(1)).alias("d")
        )

    return dt.full_years(filled(b), filled(e))


def age_check(fields: DataFrame, person: DataFrame, union_: DataFrame, event: DataFrame) -> DataFrame:
    """Age claims that fit no subject and date, and claims whose subject has no birth.

    Subjects (self, kin, bearers of a name) are one table keyed by group and reduced to distinct
    life dates. A claim "n at event e" asks for births in four possible years, so claim and
    subject meet on (group, birth year): a name borne by a third of all people, or a parent with
    very many children, is never enumerated per claim.
    """
    v, partners = cut_lineage(vitals(person, event)), _partner_vitals(union_)
    kin_groups = _subjects(v, partners)
    me = v.select(
        "card", F.col("born").alias("me_born"), F.col("died").alias("me_died"), F.col("g").alias("me_g"),
        "parent_card", F.col("union_idx").alias("me_union"), nm.name_tokens(F.col("name")).alias("me_tok"),
    )
    c = claims(fields).join(me, "card")
    c = c.withColumn("cid", F.concat_ws("/", s("card"), "path", s("ord"), s("pos")))

    # events a claim may be measured at: sentence dates, else years, else those of the paragraph
    none = F.lit(None).cast("int")

    def as_dates(col):
        return F.transform(dt.date_set(F.col(col)), lambda d: F.struct(d["y"].alias("y"), d["m"].alias("m"), d["d"].alias("d")))

    def as_years(col):
        return F.transform(dt.find_years(F.col(col)), lambda y: F.struct(y.alias("y"), none.alias("m"), none.alias("d")))

    c = c.withColumns({"sd": as_dates("sentence"), "sy": as_years("sentence"), "pd": as_dates("text"), "py": as_years("text")})
    evs = F.when(F.size("sd") > 0, F.col("sd")).when(F.size("sy") > 0, F.col("sy")).when(F.size("pd") > 0, F.col("pd")).otherwise(F.col("py"))
    c = c.withColumn("evs", F.array_distinct(evs)).drop("sd", "sy", "pd", "py")
    c = c.withColumn("deadly", rx.matches(F.col("sentence"), lx.DEATH_VERB) | rx.matches(F.col("raw"), r"\b(died|death|buried|burial)\b"))

    # group keys in order of preference
    card, parent = s("card"), s("parent_card")
    kin_key = (
        F.when(F.col("kin") == "father", F.concat(F.lit("S:"), parent))
        .when(F.col("kin") == "mother", F.concat(F.lit("U:"), parent, F.lit(":"), s("me_union")))
        .when(F.col("kin") == "son", F.concat(F.lit("C:"), card, F.lit(":m")))
        .when(F.col("kin") == "daughter", F.concat(F.lit("C:"), card, F.lit(":f")))
        .when(F.col("kin") == "brother", F.concat(F.lit("C:"), parent, F.lit(":m")))
        .when(F.col("kin") == "sister", F.concat(F.lit("C:"), parent, F.lit(":f")))
        .when(F.col("kin").isNotNull(), F.concat(F.lit("W:"), card))
    )
    qtok = nm.name_tokens(F.col("name"))
    own_name = F.col("name").isNotNull() & (F.size(qtok) > 0) & (F.size(F.array_except(qtok, F.col("me_tok"))) == 0)
    self_key = F.concat(F.lit("S:"), card)
    c = cut_lineage(c.withColumn("kin_key", kin_key).withColumn("own_name", own_name))
    same_sex = F.when(F.col("me_g") == "f", "sister").otherwise("brother")

    # only groups some claim asks for, reduced to totals: subjects, births, births with deaths
    def total(groups):
        return groups.groupBy("skey").agg(
            F.sum("n").alias("people"),
            F.sum(F.when(F.col("born").isNotNull(), F.col("n")).otherwise(0)).alias("born_n"),
            F.bool_or(F.col("born").isNotNull() & F.col("died").isNotNull()).alias("full"),
        )

    asked = c.select(F.explode(F.array_compact(F.array("kin_key", self_key))).alias("skey")).distinct()
    kin_groups = cut_lineage(kin_groups.join(asked, "skey", "left_semi"))
    totals = total(kin_groups)
    kin_n = totals.select(F.col("skey").alias("kin_key"), F.col("born_n").alias("kin_born"))
    c = c.join(kin_n, "kin_key", "left")
    minus_me = F.when((F.col("kin") == same_sex) & F.col("me_born").isNotNull(), 1).otherwise(0)
    has_kin = F.coalesce(F.col("kin_born") - minus_me, F.lit(0)) > 0
    mode = (
        F.when(F.col("kin").isNotNull(), F.when(has_kin, "kin").otherwise("self"))
        .when(F.col("name").isNull() | F.col("own_name"), "self")
        .otherwise("name")
    )
    c = c.withColumn("mode", mode)

    # names: exact key first, token containment only where no exact key exists
    c = cut_lineage(c)
    bearers = _bearers(v, partners)
    wanted = c.where(F.col("mode") == "name").select("name").distinct().withColumn("key", tx.fold(F.col("name")))
    direct = bearers.join(wanted.select("key").distinct(), "key", "left_semi")
    found = direct.select("key").distinct()
    exact = wanted.join(found, "key", "left_semi").withColumn("skey", F.concat(F.lit("N:"), "key"))
    loose = wanted.join(found, "key", "left_anti").select("name", nm.token_key(F.col("name")).alias("skey")).where("skey is not null")
    spread = bearers.join(nm.containments(loose, bearers), "key").groupBy("skey", "born", "died").agg(F.sum("n").alias("n"))
    direct = direct.select(F.concat(F.lit("N:"), "key").alias("skey"), "born", "died", "n")
    subjects = cut_lineage(kin_groups.unionByName(direct).unionByName(spread))
    totals = total(subjects)
    name_keys = exact.select("name", "skey").unionByName(loose)
    plain = c.where(F.col("mode") != "name").withColumn("skey", F.when(F.col("mode") == "kin", F.col("kin_key")).otherwise(self_key))
    by_name = c.where(F.col("mode") == "name").join(name_keys, "name", "left")
    keyed = plain.unionByName(by_name)
    # a sibling group must not be answered by the person themself
    keyed = keyed.withColumn(
        "skip", F.when((F.col("mode") == "kin") & (F.col("kin") == same_sex), F.struct(F.col("me_born").alias("born"), F.col("me_died").alias("died")))
    )
    slim = keyed.select("cid", "skey", "n", "evs", "deadly", "skip")

    # probe 1: events of the text, by birth year; probe 2: the subject's own death, by age
    born = subjects.where(F.col("born").isNotNull())
    asks = slim.select("cid", "skey", "n", "skip", F.explode("evs").alias("e")).withColumn(
        "by", F.explode(F.sequence(F.col("e.y") - F.col("n") - 2, F.col("e.y") - F.col("n") + 1))
    )
    hit1 = asks.join(born.withColumnRenamed("n", "people").withColumn("by", F.col("born.y")), ["skey", "by"])
    vague1 = F.col("born.m").isNull() | F.col("e.m").isNull()
    gap1 = F.abs(_age(F.col("born"), F.col("e")) - F.col("n"))
    lived = born.where(F.col("died").isNotNull()).withColumnRenamed("n", "people").withColumn("age", _age(F.col("born"), F.col("died")))
    asks2 = slim.where("deadly").select("cid", "skey", "n", "skip", F.explode(F.sequence(F.col("n") - 1, F.col("n") + 1)).alias("age"))
    hit2 = asks2.join(lived, ["skey", "age"])
    vague2 = F.col("born.m").isNull() | F.col("died.m").isNull()
    gap2 = F.abs(F.col("age") - F.col("n"))
    me_alone = F.coalesce(
        F.col("skip.born").eqNullSafe(F.col("born")) & F.col("skip.died").eqNullSafe(F.col("died")) & (F.col("people") <= 1), F.lit(False)
    ) & F.col("skip").isNotNull()

    def fits(df, gap, vague):
        return df.where((gap <= F.when(vague, 1).otherwise(0)) & ~me_alone).select("cid")

    matched = fits(hit1, gap1, vague1).unionByName(fits(hit2, gap2, vague2)).distinct()

    # can the claim be judged at all, and how many subjects does it have
    per = (
        keyed.select("cid", "skey").join(totals, "skey", "left").groupBy("cid").agg(
            F.sum(F.coalesce("people", F.lit(0))).alias("people"),
            F.sum(F.coalesce("born_n", F.lit(0))).alias("born_n"),
            F.bool_or(F.coalesce("full", F.lit(False))).alias("full"),
        )
    )
    out = c.join(per, "cid").join(matched.withColumn("matched", F.lit(True)), "cid", "left")
    can = (F.col("born_n") > 0) & ((F.size("evs") > 0) | (F.col("deadly") & F.col("full")))
    x = tx.norm(F.col("sentence"))
    start = F.greatest(F.col("pos") - 70, F.lit(0))
    pre = F.substring(x, start + 1, F.col("pos") - start)
    soft = (
        F.col("kind").isin(QUOTED_KINDS) | F.col("quoted")
        | rx.matches(pre, lx.FROM_DOCUMENT[0]) | rx.matches(pre, lx.FROM_DOCUMENT[1])
        | rx.matches(F.col("sentence"), lx.RELATIVE_TIME) | rx.matches(F.col("sentence"), lx.EXPLAINED)
    )
    count = F.when(F.col("mode") == "kin", F.col("born_n") - minus_me).otherwise(F.col("people"))
    sev = F.when(soft, "review").when(count > 3, "med").otherwise("high")
    who = F.coalesce("name", F.lit("card person"))
    said = F.concat(F.lit('"'), F.trim("raw"), F.lit('" (='), s("n"), F.lit(")"))
    check = F.when(F.col("quoted"), "C4q").otherwise("C4")
    tail = F.when(F.col("quoted"), ' (quoted from a document — verify, do not "correct")').otherwise("")
    return emit(
        out,
        [
            (~can, "C4w", "review", F.col("path"), F.concat(F.lit("age claim "), said, F.lit(' — subject "'), who, F.lit('" has no birth date on the tree'))),
            (can & F.col("matched").isNull(), check, sev, F.col("path"), F.concat(F.lit("age "), said, F.lit(" matches no subject/date pairing"), tail)),
        ],
    )


# ------------------------------------------------------------------ distances
def distance_claims(fields: DataFrame, event: DataFrame, place: DataFrame) -> DataFrame:
    """A stated distance that no two places of the card are near to.

    Only cards that state a distance are looked at. Places meet by cells of the map that can hold the stated distance, so
    a card with many places has neither an array of them nor all their pairs.
    """
    text = F.col("text")
    units = fields.where(rx.matches(text, "mile|km|kilom") & rx.matches(text, lx.DISTANCE)).select(
        "card", "path", F.explode(tx.sentences(F.col("text"))).alias("sentence")
    )
    said = rx.all_matches(tx.norm(F.col("sentence")), lx.DISTANCE, 0)
    df = units.select("card", "path", F.explode(said).alias("said"))
    word = F.concat_ws("-", F.nullif(rx.first_match(F.col("said"), lx.DISTANCE, 1), F.lit("")), F.nullif(rx.first_match(F.col("said"), lx.DISTANCE, 2), F.lit("")))
    df = df.withColumn("num", tx.number_of(word)).where(F.col("num").isNotNull())
    km = F.when(F.lower("said").contains("mile"), F.col("num") * lx.KM_PER_MILE).otherwise(F.col("num").cast("double"))
    df = cut_lineage(df.select("card", "path", "said", km.alias("km")))
    asking = df.select("card").distinct()
    named = nm.place_mentions(fields.join(asking, "card", "left_semi"), place, ["card"], "text", ignore_case=False)
    pinned = event.join(asking, "card", "left_semi").select("card", F.col("k"))
    on_card = named.select("card", "k").unionByName(pinned).distinct()
    spots = cut_lineage(on_card.join(small_side(place.where(F.col("lat").isNotNull()).select("k", "n", "lat", "lon")), "k").distinct())
    tolerance = F.greatest(F.col("km") * 0.3, F.lit(1.0))
    df = df.join(nearest_pairs(df.select("card", "km", tolerance.alias("near")), spots), ["card", "km"])
    shown = F.array_join(
        F.transform("near", lambda p: F.concat(p["s"], F.lit("="), F.round(p["d"]).cast("bigint").cast("string"), F.lit("km"))), "; "
    )
    return emit(
        df.withColumn("shown", shown),
        [(F.lit(True), "C8", "high", F.col("path"), F.concat(F.lit('"'), F.trim("said"), F.lit('" disagrees with the gazetteer; nearest '), "shown"))],
    )


# ------------------------------------------------------------------ family counts
def _count_rows(fields: DataFrame) -> DataFrame:
    kinds = ["bio", "mapnote", "tooltip", "union"]
    base = fields.where((F.col("lang") == "en") & F.col("kind").isin(kinds) & rx.matches(F.col("text"), lx.FAMILY_COUNT))
    units = base.select("card", "path", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence"))
    x = tx.norm(F.col("sentence"))
    df = units.select("card", "path", "sentence", x.alias("x"), F.explode(rx.matches_with_pos(x, lx.FAMILY_COUNT)).alias("h"))
    raw = F.col("h.raw")
    word = F.concat_ws("-", F.nullif(rx.first_match(raw, lx.FAMILY_COUNT, 1), F.lit("")), F.nullif(rx.first_match(raw, lx.FAMILY_COUNT, 2), F.lit("")))
    after = F.substring(F.col("x"), F.col("h.pos") + F.length(raw) + 1, F.lit(60))
    df = df.select(
        "card", "path", raw.alias("raw"), tx.number_of(word).alias("n"),
        F.lower(rx.first_match(raw, lx.FAMILY_COUNT, 3)).alias("rel"), "sentence",
        F.nullif(rx.first_match(after, lx.COUNT_OF, 1, ignore_case=False), F.lit("")).alias("of"),
    ).where(F.col("n").isNotNull())
    grown = F.col("rel").isin("women", "men", "boys", "girls")
    return df.where(~grown | rx.matches(F.col("sentence"), lx.GENERATION_CUE))


def _runs(words: Column, most: int = 4) -> Column:
    return F.array_distinct(F.flatten(F.array(*[nm.word_runs(words, k) for k in range(1, most + 1)])))


def reattribute(phrases: DataFrame, person: DataFrame, order: str = "card") -> DataFrame:
    """"of X": the first card whose name contains X, or is contained in X, word by word.

    Names are reduced to their first card before the join, and containment is an equality of
    word runs, so neither side is enumerated.
    """
    first = person.groupBy(F.lower(tx.deaccent(tx.norm("name"))).alias("key")).agg(
        F.min(F.struct(F.col(order).alias("order"), F.col("card").alias("card"))).alias("p")
    )
    q = phrases.select("of").distinct().withColumn("key", tx.fold(F.col("of")))
    runs = first.select("p", F.explode(_runs(F.split("key", " "))).alias("run")).groupBy("run").agg(F.min("p").alias("p"))
    inside = q.join(runs, q.key == runs.run).select("of", "p")
    around = q.select("of", F.explode(_runs(F.split("key", " "))).alias("key")).join(first, "key").select("of", "p")
    return inside.unionByName(around).groupBy("of").agg(F.min("p").alias("p")).select("of", F.col("p.card").alias("target"))


def count_claims(fields: DataFrame, person: DataFrame, order: str = "card") -> DataFrame:
    """Every stated number of relatives with the subject it is about and what the tree draws."""
    rows = _count_rows(fields)
    targets = reattribute(rows.where(F.col("of").isNotNull()), person, order)
    rows = rows.join(targets, "of", "left").where(F.col("of").isNull() | F.col("target").isNotNull())
    rows = rows.withColumn("subject", F.coalesce("target", "card"))
    fam = family_counts(person).withColumnRenamed("card", "subject")
    df = rows.join(fam, "subject")
    col = F.col

    def as_list(*cs):
        return F.array_distinct(F.array(*[col(c).cast("bigint") for c in cs]))

    expected = (
        F.when(col("rel") == "children", F.array_distinct(F.concat(as_list("children"), F.coalesce("per_union", F.array().cast("array<bigint>")))))
        .when(col("rel") == "sons", as_list("sons"))
        .when(col("rel") == "daughters", as_list("daughters"))
        .when(col("rel") == "brothers", as_list("brothers", "brothers_all"))
        .when(col("rel") == "sisters", as_list("sisters", "sisters_all"))
        .when(col("rel") == "women", as_list("sisters_all", "sisters"))
        .when(col("rel") == "girls", as_list("sisters_all"))
        .when(col("rel") == "men", as_list("brothers_all", "brothers"))
        .when(col("rel") == "boys", as_list("brothers_all"))
    )
    return df.select("card", "path", "raw", "n", "rel", "subject", expected.alias("expected"))


def count_mismatch(counts: DataFrame) -> DataFrame:
    label = F.when(F.col("subject") == F.col("card"), "this card").otherwise(F.concat(F.lit("card "), s("subject")))
    drawn = F.array_join(F.transform("expected", lambda v: v.cast("string")), " or ")
    return emit(
        counts,
        [(~F.array_contains("expected", F.col("n").cast("bigint")), "X13", "review", F.col("path"), F.concat(F.lit('"'), F.trim("raw"), F.lit('" — '), label, F.lit(" draws "), drawn, F.lit(" "), "rel"))],
    )


def count_contradiction(counts: DataFrame) -> DataFrame:
    """One card stating two different numbers for the same relation of the same subject."""
    per = counts.groupBy("card", "subject", "rel").agg(
        F.array_sort(F.collect_set("n")).alias("vals"), F.min("path").alias("path")
    )
    vals = F.array_join(F.transform("vals", lambda v: v.cast("string")), " and ")
    other = F.when(F.col("subject") == F.col("card"), "").otherwise(F.concat(F.lit(" for card "), s("subject")))
    return emit(
        per,
        [(F.size("vals") > 1, "X13b", "review", F.col("path"), F.concat(F.lit("this card asserts "), vals, F.lit(" "), "rel", other))],
    )


# ------------------------------------------------------------------ pins against prose
def pin_vs_prose(fields: DataFrame, event: DataFrame, place: DataFrame) -> DataFrame:
    """A certain pin while the prose about that event is in doubt.

    A sentence meets a pin on (card, event type, place it names); a sentence naming no place at
    all meets the card's only pin of that type. Cards that publish an alternative pin of the
    type already disclose the conflict.
    """
    kinds = ["bio", "mapnote", "tooltip", "headline"]
    units = fields.where((F.col("lang") == "en") & F.col("kind").isin(kinds)).select(
        "card", "path", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence")
    )
    x = F.col("sentence")
    doubted = units.select("*", F.explode(F.slice(tx.hedge_hits(x, F.lit("en")), 1, 1)).alias("hedge"))
    typed = F.array_compact(
        F.array(
            *[
                F.when(rx.matches(x, p), F.struct(F.lit(t).alias("t"), (F.instr(tx.norm(x), rx.first_match(tx.norm(x), p)) - 1).alias("at")))
                for t, p in lx.EVENT_VERBS.items()
            ]
        )
    )
    df = doubted.select("card", "path", "ord", "sentence", "hedge", F.inline(typed))
    t2 = tx.norm(x)
    h_at = F.instr(F.lower(tx.deaccent(t2)), F.lower(tx.deaccent(F.col("hedge")))) - 1
    df = df.withColumn("h", h_at)
    seg = F.substring(t2, F.least("h", "at") + 1, F.abs(F.col("h") - F.col("at")))
    df = df.where((F.col("h") < 0) | ((F.abs(F.col("h") - F.col("at")) <= 90) & ~seg.rlike("[;—:]")))
    df = cut_lineage(df.select("card", "path", "ord", "sentence", "hedge", "t"))
    mention = nm.place_mentions(df.select("card", "path", "ord", "sentence").distinct(), place, ["card", "path", "ord"])
    alt = event.where("x").select("card", "t").distinct()
    pins = event.where((F.col("c") == "doc") & ~F.col("x")).join(alt, ["card", "t"], "left_anti").select("card", "t", "k", "pos")
    base = place.select("k", "n").where(F.length(F.split_part("n", F.lit(" ("), F.lit(1))) > 3)
    pins = pins.join(small_side(base), "k")
    named = df.join(mention, ["card", "path", "ord"]).join(pins, ["card", "t", "k"])
    unnamed = df.join(mention.select("card", "path", "ord").distinct(), ["card", "path", "ord"], "left_anti")
    single = (
        event.where(~F.col("x") & F.col("t").isin(*lx.LIFE_ORDER)).groupBy("card", "t").agg(F.count("*").alias("n_t")).where("n_t = 1").drop("n_t")
    )
    sole = unnamed.join(single, ["card", "t"], "left_semi").join(pins, ["card", "t"])
    cols = ["card", "path", "ord", "hedge", "t", "n", "pos"]
    out = named.select(*cols).unionByName(sole.select(*cols))
    return emit(
        out,
        [
            (
                F.lit(True), "C3", "med", F.concat(pin_path(), F.lit(" ↔ "), "path"),
                F.concat(F.lit("[doc] "), "t", F.lit(" pin at "), "n", F.lit(' while the prose about that event hedges ("'), "hedge", F.lit('")')),
            )
        ],
    )


