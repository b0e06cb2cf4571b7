"""Steps that have to grow no faster than their input, over rows made here."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx
from claimcheck.functions import text as tx
from claimcheck.operators import arithmetic as ar
from claimcheck.operators import geometry as ge
from claimcheck.operators import names as nm
from claimcheck.operators import privacy as pv
from claimcheck.plans.suite import run_checks
from claimcheck.session import spread


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alternatives_share_their_boundary(spark):
    p = r"\bno (one|two)\b|\b(?:not|nor)|act[|)]|\bx"
    assert rx.alternatives(p) == [r"\bno (one|two)\b", r"\b(?:not|nor)", "act[|)]", r"\bx"]
    assert rx.shared_start(p) == r"\b(?:no (one|two)\b|(?:not|nor))|act[|)]|\bx"
    whole = "|".join(q for _, q, _ in lx.SOURCE_TYPES)
    assert rx.shared_start(whole).count("|\\b") < whole.count("|\\b") / 2
    df = spark.createDataFrame([("a note, no two, act) xx ſx",)], "t string")
    assert df.select(rx.all_matches(F.col("t"), p, 0)).first()[0] == ["not", "no two", "act)", "x", "x"]


def test_sentences_hold_dots_only_where_they_did(spark):
    rows = [("St. Mary lies at A. Town. Next. \"So\" it is",), ("one sentence only.",), ("  ",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.sentences(F.col("t"))).collect()]
    assert got == [["St. Mary lies at A. Town.", "Next.", '"So" it is'], ["one sentence only."], [], None]


def test_sentences_are_cut_in_one_pass(spark):
    rows = [("Dr. Bell came.\u0004 So did co. Next\u0003 Last! \u201cSo\u201d it is. ",), ("A\u0003 B",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(tx.sentences(F.col("t"))).collect()]
    assert got == [["Dr. Bell came.\u0004 So did co. Next. Last!", '"So" it is.'], ["A. B"], [], None]
    # one pattern replaces, and the text is cut at a plain character
    assert plan(df.select(tx.sentences(F.col("t")).alias("s"))).count("regexp_replace") == 1


def test_place_mentions_make_runs_only_where_a_name_begins(spark):
    names = ["Saint Mary on the Hill (R)", "Mary (R)", "St. Ives (R)", "---- (R)", None, "Ur (R)", "Saint Mary (R)"]
    place = spark.createDataFrame(list(enumerate(names, 1)), "k int, n string")
    texts = ["At saint mary on the hill, not Mary's.", "saint mary on a hill; St, Ives; Ur ----", "St. Ives and Rosemary, St. Ives", None, "Saint", ""]
    units = spark.createDataFrame(list(enumerate(texts, 1)), "id int, sentence string")
    found = nm.place_mentions(units, place, ["id"])
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (1, 7), (2, 2), (2, 7), (3, 3)]
    assert sorted(map(tuple, nm.place_mentions(units, place, ["id"], ignore_case=False).collect())) == [(1, 2), (3, 3)]
    # no runs of every length at every word, and the words of a text are cut once
    assert "sequence(" not in plan(found)
    assert plan(found).count("regexp_extract_all(lower(sentence") <= 1


def test_hedge_hits_read_a_sentence_once(spark):
    rows = [("It may have been so, whether or not.",), ("A register gives it.",), ("No act says so, perhaps.",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    hits = tx.hedge_hits(F.col("t"), F.lit("en"))
    got = [r[0] for r in df.select(hits).collect()]
    assert got[0][0] == "may have" and "whether" in got[0] and got[1:] == [[], [], []]
    assert [bool(g) for g in got] == [r[0] for r in df.select(tx.is_hedged(F.col("t"), F.lit("en"))).collect()]
    # folded once for each language, and not again for the decision
    assert df.select(hits.alias("h"))._jdf.queryExecution().analyzed().toString().count("ÀÁÂÃ") == 2


def test_spread_goes_by_rows(spark):
    df = spark.range(0, 1000, 1, 20)
    assert spread(df, 10).rdd.getNumPartitions() == 100
    assert spread(df, 10).count() == 1000


def test_coded_numbers(spark):
    codes = [("A", 0), ("B", -1), ("C", 1), ("gB", 16)]
    df = spark.createDataFrame([(c,) for c, _ in codes], "c string")
    assert [r[0] for r in df.select(ge._value(F.col("c"))).collect()] == [n for _, n in codes]
    assert "reduce" not in plan(df.select(ge._value(F.col("c")))) and "aggregate(" not in plan(df.select(ge._value(F.col("c"))))


def test_leak_scan_makes_only_runs_asked_for(spark):
    texts = spark.createDataFrame([(1, "one Anna Bell two three four"), (2, "bell anna")], "id long, text string")
    index = spark.createDataFrame([("anna bell", "full")], "token string, tier string")
    found = pv.leak_scan(texts, "id", "text", index)
    assert [tuple(r) for r in found.collect()] == [(1, "anna bell", "full")]
    assert "concat(2 ," in plan(found) and "concat(3 ," not in plan(found)


def _tables(spark):
    person = spark.createDataFrame(
        [(1, None, "f", "Anna Bell", "1800–1850", "She was born there. She died in 1850, says the census.", ["The farm lay 5 km from town. She had two children."])],
        "card long, parent_card long, g string, name string, years string, note string, bio array<string>",
    ).withColumns({"union_idx": F.lit(0), "child_idx": F.lit(0)} | {c: F.lit(None).cast("string") for c in ("note_fr", "mn", "mn_fr", "headline", "headline_fr")}).withColumn("bio_fr", F.array().cast("array<string>"))
    return SimpleNamespace(
        person=person,
        union_=spark.createDataFrame([], "card long, union_idx int, s string, sy string, n string, n_fr string"),
        source=spark.createDataFrame([], "card long, origin string, pos long, label string, label_fr string, url string, quote string"),
        doc=spark.createDataFrame([], "card long, pos long, cap string, cap_fr string, tr string, tr_fr string, u string, img string"),
        event=spark.createDataFrame([(1, 7, 3, "birth", "doc", 1800, False)], "card long, pos long, k int, t string, c string, y int, x boolean").withColumns({c: F.lit(None).cast("string") for c in ("d", "w", "w_fr")}),
        place=spark.createDataFrame([(3, "TOWN (R)", 1.0, 1.0)], "k int, n string, lat double, lon double"),
    )


def test_findings_of_several_checks_are_stored_by_rule(spark):
    t = _tables(spark)
    found = run_checks(t, ["C7", "X13"])
    assert "Generate" not in plan(found)
    assert {r["check"] for r in found.collect()} == {"C7", "X13"}


def test_distances_are_stated_once(spark):
    t = _tables(spark)
    from claimcheck.operators import cards as cd

    found = ar.distance_claims(cd.fields(t), t.event, t.place)
    assert "mile|km|kilom" not in plan(found) and "kilom" not in plan(found).replace("LogicalRDD", "")
