"""Scalar functions against hand-worked values."""

from __future__ import annotations

import datetime as d

import pytest
from pyspark.sql import functions as F

from claimcheck.functions import dates as dt
from claimcheck.functions import geo
from claimcheck.functions import text as tx
from claimcheck.operators import archive as ac
from claimcheck.operators import arithmetic as ar
from claimcheck.operators import names as nm


@pytest.fixture(scope="module")
def on(spark):
    def run(values, fn):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
        return [r["v"] for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]

    return run


def test_sentences_keep_initials_and_abbreviations(on):
    got = on(
        ["J. Doe met Dr. Who. He left. ", "La date est « fausse. » Elle part.", "Élan. Été chaud", "  ", "b. 1820. Then."],
        tx.sentences,
    )
    assert got[0] == ["J. Doe met Dr. Who.", "He left."]
    assert got[1] == ["La date est « fausse.", "Elle part."]
    assert got[2] == ["Élan.", "Été chaud"]
    assert got[3] == []
    assert got[4] == ["b. 1820.", "Then."]


def test_clauses(on):
    assert on(["One; two — three. Four."], tx.clauses) == [["One", "two", "three.", "Four."]]


def test_number_words(on):
    got = on(["thirty-eight", "12", "Sixty five", "one hundred", "dozen", "twelfth"], tx.number_of)
    assert got == [38, 12, 65, 101, None, 12]
    assert on(["two hundred", "hundred five"], lambda c: tx.number_of(c, strict=True)) == [200, 105]


def test_dates_with_positions(on):
    got = on(["On 3 May 1820, then May 4, 1821 and le 1er août 1822; 30 February 900.", "3 mars 1820"], dt.find_dates)
    assert [(x["y"], x["m"], x["d"], x["pos"]) for x in got[0]] == [(1820, 5, 3, 3), (1821, 5, 4, 20), (1822, 8, 1, 39), (900, 2, 30, 54)]
    assert [(x["y"], x["m"], x["d"]) for x in got[1]] == [(1820, 3, 3)]


def test_months_in_french(on):
    got = on(["2 juin 1900, 3 juillet 1900, 4 décembre 1900, 5 février 1900"], dt.date_set)
    assert [x["m"] for x in got[0]] == [6, 7, 12, 2]


def test_year_ranges_and_bare_numbers(on):
    assert on(["1862–63 and the 1650s"], dt.year_set) == [[1650, 1862, 1863]]
    assert on(["at 10:45, n° 1458, the 3rd of 27"], dt.bare_numbers) == [[3, 27]]


def test_day_numbers(spark):
    rows = [(1820, 5, 3), (2000, 2, 29), (1600, 1, 1), (1970, 1, 1)]
    df = spark.createDataFrame(rows, "y int, m int, d int")
    y, m, day = F.col("y"), F.col("m"), F.col("d")
    got = df.select(dt.jdn(y, m, day).alias("j"), dt.weekday(dt.jdn(y, m, day)).alias("w")).collect()
    for (yy, mm, dd), r in zip(rows, got):
        assert r["j"] == d.date(yy, mm, dd).toordinal() + 1721425
        assert r["w"] == d.date(yy, mm, dd).strftime("%A")
    jul = df.select(dt.jdn_julian(F.lit(1582), F.lit(10), F.lit(4)).alias("j")).first()["j"]
    assert jul + 1 == 2299161  # the day after 4 October 1582 (Julian) is 15 October (Gregorian)


def test_life_spans(on):
    got = on(["1820–1890", "1820-?", "b. 1820", "d. 1890", "c. 1700", "about 1650", ""], dt.life_span)
    assert [(x["b"], x["d"], x["approx"], x["loose"]) for x in got] == [
        (1820, 1890, False, False), (1820, None, False, False), (1820, None, False, False), (None, 1890, False, False),
        (1700, None, True, False), (1650, None, False, True), (None, None, False, False),
    ]


def test_hedges(on):
    got = on(
        ["Whether he was born is not known.", "No document says the 21st.", "He was born in 1820.", "No register survives."],
        lambda c: tx.hedge_hits(c, F.lit("en")),
    )
    assert got[0][0] == "is not known" and "whether" in [h.lower() for h in got[0]]
    assert got[1] == [] and got[2] == []
    assert got[3]
    assert on(["On ignore la date.", "La date est sûre."], lambda c: tx.is_hedged(c, F.lit("fr"))) == [True, False]


def test_negation_window(on):
    p = r"\bregisters?\b"
    got = on(["No register survives.", "The register gives 1820.", "x" * 80 + " no", "The register " + "y" * 60 + " not"], lambda c: tx.negated(c, p))
    assert got == [True, False, False, False]


def test_age_claims_and_near_misses(on):
    got = on(
        ["He died at forty-two.", "The household of nine held on.", "A farm of fifty acres.", "She, then thirty, left.", "aged 130"],
        ar.age_claims,
    )
    assert [[(c["n"], c["cue"]) for c in g] for g in got] == [[(42, "verb at")], [], [], [(30, "then")], []]


def test_name_keys_and_subsets(on):
    assert on(["Anna Maria Stone"], nm.name_keys) == [["anna maria stone", "anna maria", "anna maria", "anna"]]
    got = on(["Anna Stone"], lambda c: nm.token_subsets(nm.name_tokens(c)))[0]
    assert sorted(got) == ["anna", "anna stone", "stone"]


def test_names_of_any_length_are_found(spark):
    names = ["Maria Berta Clara Dora Emma", "Maria Berta Clara Dora Emma Frida Gerda Heims", "berta clara", "Clara", "Gerda", "Zoe Clara"]
    index = ["maria berta clara dora emma frida", "maria berta clara dora emma frida", "berta clara", "friedrich", "gerda"]
    got = nm.resolve(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in index], "key string"))
    assert sorted((r.name, r.how, r.candidates) for r in got.collect()) == [
        ("Gerda", "exact", 1), ("Maria Berta Clara Dora Emma", "containment", 3), ("Maria Berta Clara Dora Emma Frida Gerda Heims", "containment", 3), ("berta clara", "exact", 1),
    ]


def test_urls(on):
    urls = ["https://www.Example.org/ark:/61903/abcd9", "not a url", "http://x.org/v?p=Ann%20B&n=ab", "http://x.org/memorial/12345"]
    assert on(urls, ac.host_of) == ["example.org", "?", "x.org", "x.org"]
    assert on(urls, ac.url_markers) == [["abcd9"], [], ["Ann B"], ["12345"]]
    assert on(["https://gw.geneanet.org/x", "https://archive.org/a.pdf", "https://x.org/"], ac.url_risk) == ["high", "low", "medium"]
    assert on(["https://archive.org/a.pdf", "https://x.org/"], ac.url_kind) == ["file", "page"]


def test_distance(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("k")).first()["k"]
    assert abs(km - 111.19) < 0.01
