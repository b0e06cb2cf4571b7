"""Planted defects and near-misses on tiny card tables."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from claimcheck.operators import arithmetic as ar
from claimcheck.operators import cards as cd
from claimcheck.operators import changes as ch
from claimcheck.operators import dossier as do
from claimcheck.operators import findings as fi
from claimcheck.operators import geometry as ge
from claimcheck.operators import names as nm
from claimcheck.operators import privacy as pv
from claimcheck.operators import prose as pr
from claimcheck.operators import structure as st
from claimcheck.operators import tree as tr
from claimcheck.operators.nearest import nearest_pairs
from claimcheck.plans.suite import CHECKS, run_checks

PERSON = (
    "card long, card_key string, parent_card long, union_idx int, child_idx int, depth int, g string, name string, years string, note string, "
    "note_fr string, mn string, mn_fr string, headline string, headline_fr string, bio array<string>, bio_fr array<string>"
)
EVENT = "card long, pos long, k int, t string, c string, y int, y2 int, d string, x boolean, w string, w_fr string"


def person(card, name, years, parent=None, child=0, g="m", note=None, note_fr=None, bio=(), bio_fr=()):
    return (card, f"{name}|{years}", parent, None if parent is None else 0, None if parent is None else child, 0, g, name, years,
            note, note_fr, None, None, None, None, list(bio), list(bio_fr))


def event(card, pos, t, d=None, y=None, k=1, c="doc", x=False, y2=None, w=None, w_fr=None):
    return (card, pos, k, t, c, y, y2, d, x, w, w_fr)


def tables(spark, people, events=(), unions=(), sources=(), docs=(), places=()):
    def df(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return SimpleNamespace(
        person=df(people, PERSON),
        event=df(events, EVENT),
        union_=df(unions, "card long, union_idx int, s string, sy string, div_ boolean, n string, n_fr string"),
        source=df(sources, "card long, origin string, pos long, label string, label_fr string, url string, quote string"),
        doc=df(docs, "card long, pos int, cap string, cap_fr string, tr string, tr_fr string, u string, img string"),
        place=df(places or [(1, "Northwick (West)", "Northwick", "West", "Ouest", 48.0, 7.0, "town")], "k int, n string, n_fr string, c string, c_fr string, lat double, lon double, kind string"),
    )


def rows(df):
    return sorted((r["check"], r["sev"], r["card"], r["path"]) for r in df.collect())


def test_span_rules(spark):
    t = tables(spark, [person(1, "Anna Stone", "1820–1890")], [
        event(1, 0, "residence", y=1810), event(1, 1, "residence", y=1895), event(1, 2, "burial", y=1895), event(1, 3, "work", y=1850, x=True),
    ])
    assert rows(st.event_vs_span(t.person, t.event)) == [("C5", "high", 1, "pl[0]"), ("C5", "high", 1, "pl[1]")]


def test_pin_rules_and_span_near_miss(spark):
    t = tables(spark, [person(1, "Anna Stone", "1820–1890")], [
        event(1, 0, "birth", y=1821), event(1, 1, "work", y=1850, y2=1840), event(1, 2, "work", d="3 May 1855", y=1850, y2=1860),
        event(1, 3, "work", d="3 May 1865", y=1850, y2=1860), event(1, 4, "residence", c="inf", y=1850), event(1, 5, "work", y=1851, w="It may have been copied."),
    ])
    assert rows(st.pin_notes(t.person, t.event)) == [
        ("C3", "high", 1, "pl[0]"), ("C3", "high", 1, "pl[1]"), ("C3", "high", 1, "pl[3]"), ("C3", "high", 1, "pl[4]"), ("C3", "high", 1, "pl[5].w"),
    ]


def test_event_order_keeps_every_event_in_a_conflict(spark):
    ev = [event(1, 0, "birth", "3 May 1830"), event(1, 1, "baptism", "1 May 1830"), event(1, 2, "birth", "5 May 1830"), event(1, 3, "death", "1 May 1900")]
    got = st.event_order(spark.createDataFrame(ev, EVENT)).collect()
    assert sorted(r["path"] for r in got) == ["pl[0] vs pl[1]", "pl[2] vs pl[1]"]


def test_parent_child(spark):
    t = tables(spark, [person(1, "A Stone", "1800–1850"), person(2, "B Stone", "1799–1850", 1, 0), person(3, "C Stone", "1810–1850", 1, 1),
                       person(4, "D Stone", "1830–1850", 1, 2), person(5, "E Stone", "1853–1890", 1, 3)], unions=[(1, 0, "P", "1802–1840", False, None, None)])
    got = {(r["path"], r["msg"].split(" ")[0]) for r in st.parent_child(t.person, t.union_).collect()}
    assert ("unions[0].c[0]", "child") in got and ("unions[0].c[1]", "parent") in got
    assert not [p for p, _ in got if p == "unions[0].c[2]"]
    assert len([p for p, _ in got if p == "unions[0].c[3]"]) == 2


def test_hedged_against_flat(spark):
    flat = "Anna Stone was born 3 May 1820 at Northwick."
    doubt = "Whether Anna Stone was born 3 May 1820 at Northwick is not known."
    t = tables(spark, [person(1, "Anna Stone", "1820–1890", note=flat, bio=[doubt]), person(2, "Bert Stone", "1820–1890", note=flat, bio=["He was born. No act says so."])])
    got = pr.hedge_vs_flat(cd.fields(t)).collect()
    assert [(r["card"], r["sev"], r["path"]) for r in got] == [(1, "high", "bio[0] ↔ note")]


def test_weekdays_by_calendar(spark):
    text = ["On Monday 15 October 1655 they met.", "On Wednesday 3 May 1820 they met.", "On Thursday 3 May 1820 they met.", "Thursday the 26th, noted 3 May 1820.", "On Friday 3 May 1820 [sic] they met."]
    t = tables(spark, [person(i, "Anna Stone", "1820–1890", bio=[x]) for i, x in enumerate(text)])
    assert [(r["card"], r["sev"]) for r in ar.weekday_claims(cd.units(cd.fields(t))).collect()] == [(2, "high")]


def test_ages_by_subject(spark):
    people = [
        person(1, "Otto Ferris Quill", "1790–1850"),
        person(2, "Anna Maria Quill", "1820–1890", 1, 0, "f", bio=["She died at 70 in 1890. In 1840 her father, then 50, left.", "In 1840 her brother, then 20, came."]),
        person(3, "Bert Quill", "1820–1890", 1, 1, bio=["He died at 40 in 1890.", "In 1840 his brother, then 20, came.", "In 1840 Ferris Quill, aged 50, came.", "In 1840 Maria Quill, aged 33, came."]),
        person(4, "Carl Quill", "1860–1890", 1, 2, bio=["In 1840 Nobody Else, aged 20, came."]),
    ]
    t = tables(spark, people)
    got = ar.age_check(cd.fields(t), t.person, t.union_, t.event).collect()
    assert sorted((r["check"], r["card"], r["path"]) for r in got) == [
        ("C4", 3, "bio[0]"), ("C4", 3, "bio[1]"), ("C4", 3, "bio[3]"), ("C4w", 4, "bio[0]"),
    ]


def test_counts(spark):
    t = tables(spark, [person(1, "Otto Stone", "1790–1850", bio=["He had three children.", "She counted two children of Otto Stone."]),
                       person(2, "Anna Stone", "1820–1890", 1, 0, "f"), person(3, "Bert Stone", "1825–1890", 1, 1, bio=["The two children of Otto Stone were known. The two children of Zed Unknown too."])])
    n = ar.count_claims(cd.fields(t), t.person)
    assert [(r["card"], r["path"]) for r in ar.count_mismatch(n).collect()] == [(1, "bio[0]")]
    assert [r["card"] for r in ar.count_contradiction(n).collect()] == [1]


def test_typography(spark):
    text = ["A **bold** word.", "It was was so.", "Twice,, yes.", "They had had it.", 'One " mark.', "Clean text here."]
    t = tables(spark, [person(i, "Anna Stone", "1820–1890", note=x) for i, x in enumerate(text)])
    assert [(r["card"], r["sev"]) for r in pr.typography(cd.fields(t, ["tooltip"])).orderBy("card").collect()] == [(0, "high"), (1, "med"), (2, "med"), (4, "med")]


def test_tree_numbers_match_a_recursive_walk(spark):
    rnd = random.Random(5)
    parent = {0: None, **{i: rnd.randrange(max(0, i - 30), i) for i in range(1, 120)}}
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)
    people = [person(i, f"P {i}", "1800–1850", p, 0 if p is None else kids[p].index(i)) for i, p in parent.items()]
    want, n = {}, [0]

    def walk(i, path):
        idx = n[0]
        n[0] += 1
        for c, k in enumerate(kids.get(i, [])):
            walk(k, f"{path}/u0c{c}")
        want[i] = (path, idx, n[0] - idx - 1)

    walk(0, "root")
    got = {r["card"]: (r["path"], r["idx"], r["descendants"]) for r in tr.preorder(spark.createDataFrame(people, PERSON)).collect()}
    assert got == want


def forest(seed=8, n=150):
    """Cards of several trees, some with parents that are not there, in shuffled order; (card, parent, children in order)."""
    rnd = random.Random(seed)
    cards = rnd.sample(range(1000, 9000), n)
    parent = {c: (None if i % 40 == 0 else 7 if i % 50 == 1 else rnd.choice(cards[max(0, i - 12) : i])) for i, c in enumerate(cards)}
    kids = {}
    for c in cards:
        kids.setdefault(parent[c] if parent[c] in parent else None, []).append(c)
    kids[None].sort()
    rows = [(c, parent[c], kids[parent[c]].index(c) // 3 if parent[c] in parent else 0, kids[parent[c]].index(c) % 3 if parent[c] in parent else 5) for c in cards]
    return rows, kids


FOREST = "card long, parent_card long, union_idx int, child_idx int"


def test_intervals_of_a_forest_with_missing_parents(spark):
    rows, kids = forest()
    want, n = {}, [0]

    def walk(c, depth):
        enter = n[0]
        n[0] += 1
        for k in kids.get(c, []):
            walk(k, depth + 1)
        want[c] = (depth, n[0] - enter, enter, n[0] - 1)

    for c in kids[None]:
        walk(c, 0)
    got = {r[0]: tuple(r)[1:] for r in tr.tree_intervals(spark.createDataFrame(rows, FOREST)).collect()}
    assert got == want


def test_branch_filter_keeps_nested_heads_and_their_lines(spark):
    rows, kids = forest(9)
    parent = {c: p for c, p, *_ in rows}

    def above(c):
        return [] if parent.get(c) not in parent else [parent[c], *above(parent[c])]

    heads = {c for c, *_ in rows[5::17]} | set(above(rows[-1][0])[:2])
    want = {c for c in parent if c in heads or heads & set(above(c))} | {a for h in heads for a in above(h)}
    spans = tr.tree_intervals(spark.createDataFrame(rows, FOREST))
    kept = [r.card for r in tr.branch_filter(spans, spark.createDataFrame([(h,) for h in [*heads, -5]], "card long")).collect()]
    assert sorted(kept) == sorted(want) and 0 < len(want) < len(parent)
    assert tr.branch_filter(spans, spark.createDataFrame([], "card long")).count() == 0


def test_sums_and_marks_in_a_long_chain(spark):
    """One chain of 1,000 cards: rounds grow with the logarithm of its length, rows with the length itself."""
    n = 1000
    chain = spark.range(n).selectExpr("id AS card", "CASE WHEN id > 0 THEN id - 1 END AS parent_card", "0 AS union_idx", "0 AS child_idx", "id AS v", "CASE WHEN id % 300 = 5 THEN 'm' || id END AS anchor")
    sums = {r.card: r.v for r in tr.subtree_sums(chain, "card", "parent_card", ["v"]).collect()}
    assert all(sums[c] == (n * (n - 1) - c * (c - 1)) // 2 for c in range(n))
    spans = {r.card: (r.depth, r.size, r.enter, r.leave) for r in tr.tree_intervals(chain).collect()}
    assert spans == {c: (c, n - c, c, n - 1) for c in range(n)}
    marks = {r.card: (r.head, r.branch) for r in tr.branches(chain).collect()}
    assert marks == {c: (None, None) if c < 5 else (h := (c - 5) // 300 * 300 + 5, f"m{h}") for c in range(n)}


def test_no_cards_no_tree(spark):
    empty = spark.createDataFrame([], FOREST + ", anchor string")
    assert tr.tree_intervals(empty).count() == tr.branches(empty).count() == tr.preorder(empty).count() == 0


def test_anchor_rules_name_missing_and_repeated_anchors(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "x")], "card long, anchor string")
    got = {tuple(r) for r in tr.anchor_rules(people, spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "anchor string")).collect()}
    assert got == {("a", 1, "ok"), ("b", 2, "ambiguous"), ("c", 0, "missing"), ("x", 1, "unknown")}


def test_cycle_is_an_error(spark):
    loop = [person(1, "A", "1800–1850", 2), person(2, "B", "1800–1850", 1)]
    with pytest.raises(ValueError):
        tr.with_paths(spark.createDataFrame(loop, PERSON))


def test_compare_and_set_equals_a_plain_fold(spark):
    rnd = random.Random(11)
    current = [(c, "name", "a") for c in range(4)] + [(9, "pl[0].w", "x")]
    edits = []
    for seq in range(60):
        expect = rnd.choice(["a", "b", "c", None])
        edits.append((rnd.choice([0, 0, 0, 1, 2]), "name", 1 + seq // 40, seq, expect, rnd.choice(["a", "b", "c"]), "why"))
    edits += [(7, "name", 1, 100, "a", "b", "w"), (3, "nope", 1, 101, "a", "b", "w"), (9, "pl[0].w", 1, 102, "x", None, "w"), (9, "pl[5].w", 1, 103, None, "q", "w")]
    state, want = {(c, p): v for c, p, v in current}, {}
    for c, p, o, s_, e, v, _ in sorted(edits, key=lambda r: (r[2], r[3])):
        if c == 7:
            want[s_] = "card not found"
        elif p in ("nope", "pl[5].w"):
            want[s_] = "unknown path"
        elif e is None or state[(c, p)] == e:
            want[s_], state[(c, p)] = "applied", v
        else:
            want[s_] = "expect mismatch"
    cur = spark.createDataFrame(current, "card long, path string, text string")
    df = spark.createDataFrame(edits, "card long, path string, ord int, seq long, expect string, value string, why string")
    out = ch.apply_edits(df, cur)
    assert {r["seq"]: r["status"] for r in out.collect()} == want
    merged = {(r["card"], r["path"]): r["text"] for r in ch.merged_fields(cur, out).collect()}
    assert merged == {k: v for k, v in state.items() if v is not None}


def test_write_only_when_clean(spark, tmp_path):
    cur = spark.createDataFrame([(1, "name", "a")], "card long, path string, text string")
    schema = "card long, path string, ord int, seq long, expect string, value string, why string"
    bad = ch.apply_edits(spark.createDataFrame([(1, "name", 1, 0, "zzz", "b", "w")], schema), cur)
    assert not ch.write_if_clean(bad, ch.merged_fields(cur, bad), str(tmp_path / "v1"))
    good = ch.apply_edits(spark.createDataFrame([(1, "name", 1, 0, "a", "b", "w")], schema), cur)
    assert ch.write_if_clean(good, ch.merged_fields(cur, good), str(tmp_path / "v2"))
    assert spark.read.parquet(str(tmp_path / "v2")).first()["text"] == "b"


def test_blocked_windows_equal_plain_windows(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(2), i, rnd.choice([None, "begin", "end"])) for i in range(60)]
    df = spark.createDataFrame(data, "file int, line_no long, mark string")
    got = {r["line_no"]: r["state"] for r in pv.carry_last(df, "file", "line_no", "mark", "state", block=4).collect()}
    last, want = {}, {}
    for f, n, mk in data:
        last[f] = mk or last.get(f)
        want[n] = last[f]
    assert got == want


def test_leaks_blocks_and_lookup(spark):
    people = spark.createDataFrame([person(1, "Anna Quill", "1950–?"), person(2, "Bert Marrow", "1800–1870")], PERSON)
    none = spark.createDataFrame([], "card long, union_idx int, s string, sy string, div_ boolean, n string, n_fr string")
    text = spark.createDataFrame([(1, "see anna quill there"), (2, "the marrow only"), (3, "annab quillon"), (4, "ANNA left")], "id int, t string")
    hits = {(r["id"], r["tier"]) for r in pv.leak_scan(text, "id", "t", pv.name_index(people, none)).collect()}
    assert hits == {(1, "full"), (1, "surname"), (1, "living_given"), (2, "surname"), (4, "living_given")}
    assert do.find_card(people, "quill").first()["card"] == 1
    with pytest.raises(LookupError):
        do.find_card(people, "1")
    names = people.select("card", "name", F.lit(None).cast("string").alias("via"))
    assert [r["card"] for r in nm.search(names, "MARR be").collect()] == [2]
    assert nm.search(names, "   ").count() == 0


def test_outline_round_trip(spark):
    df = spark.createDataFrame([(1, [(7.171, 48.032), (-122.44, 45.925), (0.0, -0.001)])], "id int, ring array<struct<lon:double,lat:double>>")
    out = ge.decode(df.select("id", ge.encode_outline("ring").alias("c")), "id", "c").orderBy("ord").collect()
    assert [(r["lon"], r["lat"]) for r in out] == [(7.171, 48.032), (-122.44, 45.925), (0.0, -0.001)]


def test_outlines_of_many_points_and_broken_ones(spark):
    rng = random.Random(5)
    ring = [(rng.randrange(-180_000, 180_001) / 1000, rng.randrange(-90_000, 90_001) / 1000) for _ in range(700)]
    coded = spark.createDataFrame([(1, ring), (2, ring[:1]), (3, [])], "id int, ring array<struct<lon:double,lat:double>>").select("id", ge.encode_outline("ring").alias("c"))
    texts = {r["id"]: r["c"] for r in coded.collect()}
    rows_ = [(1, texts[1] + "|" + texts[2]), (2, None), (3, ""), (4, texts[2] + "g"), (5, "A-A"), (6, "A|C"), (7, "CCE"), (8, "CC\n")]
    got = ge.decode(spark.createDataFrame(rows_, "id int, c string"), "id", "c").orderBy("id", "ring", "ord").collect()
    assert [(r["lon"], r["lat"]) for r in got if (r["id"], r["ring"]) == (1, 0)] == ring
    assert [(r["lon"], r["lat"]) for r in got if (r["id"], r["ring"]) == (1, 1)] == ring[:1]
    assert [(r["id"], r["ring"], r["ord"], r["lon"], r["lat"]) for r in got if r["id"] > 1] == [(7, 0, 0, 0.001, 0.001)]
    assert texts[3] == ""


def test_labels_of_a_layer(spark):
    """C is 1, B is -1, gB is 16 after the zig-zag."""
    layers = spark.createDataFrame([(1, "3CB~Alba~FR\t0gBA~Bruno 2~DE\t9broken\t6BC~Celia"), (2, "1AA~Dario~US"), (3, None)], "id int, t string")
    got = ge.decode_labels(ge.label_records(layers, "id", "t")).orderBy("layer", "pos").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, 3, 0.001, -0.001, "Alba", "FR"), (1, 1, 0, 0.017, -0.001, "Bruno 2", "DE"), (1, 2, None, 0.017, -0.001, None, None),
        (1, 3, 6, 0.016, 0.0, "Celia", None), (2, 0, 1, 0.0, 0.0, "Dario", "US"),
    ]


def test_suite_is_pruned(spark):
    t = tables(spark, [person(1, "Anna Stone", "1890–1820")])
    assert {"C1", "C2", "C3", "C3d", "C4", "C5", "C6", "C7", "C8", "X", "X13", "S1"} == set(CHECKS)
    assert {r["check"] for r in run_checks(t, ["C4"]).collect()} == {"C4"}


def test_edits_of_absent_and_deleted_fields(spark):
    """A field is added where it was absent, deleted, written again; nulls are guarded like values, over three batches."""
    cur = spark.createDataFrame([(1, "profile.headline", "h"), (2, "name", "n")], "card long, path string, text string")
    schema = "card long, path string, ord int, seq long, guarded boolean, expect string, value string, why string"
    edits = [
        (1, "note", 1, 0, True, None, "x", "w"), (1, "note", 1, 1, True, "x", None, "w"), (1, "note", 2, 0, True, None, "y", "w"),
        (1, "note", 2, 1, True, None, "z", "w"), (1, "note", 3, 0, True, "y", "q", "w"), (1, "note", 3, 1, False, None, None, "w"),
        (1, "headline", 1, 2, True, "h", "i", "w"), (1, "profile.headline", 1, 3, True, "i", "j", "w"), (2, "bio[0]", 1, 4, True, None, "b", "w"),
    ]
    out = ch.apply_edits(spark.createDataFrame(edits, schema), cur)
    got = {(r["card"], r["path"], r["ord"], r["seq"]): (r["status"], r["before"]) for r in out.collect()}
    assert got == {
        (1, "note", 1, 0): ("applied", None), (1, "note", 1, 1): ("applied", "x"), (1, "note", 2, 0): ("applied", None),
        (1, "note", 2, 1): ("expect mismatch", "y"), (1, "note", 3, 0): ("applied", "y"), (1, "note", 3, 1): ("applied", "q"),
        (1, "profile.headline", 1, 2): ("applied", "h"), (1, "profile.headline", 1, 3): ("applied", "i"), (2, "bio[0]", 1, 4): ("unknown path", None),
    }
    assert {tuple(r) for r in ch.merged_fields(cur, out).collect()} == {(1, "profile.headline", "j"), (2, "name", "n")}


def test_repeated_keys_stand_for_their_last_card(spark):
    people = spark.createDataFrame([(1, "a|1"), (5, "a|1"), (2, "b|2")], "card long, card_key string")
    kept, repeated = ch.latest_by_key(people)
    assert {tuple(r) for r in kept.select("card", "card_key").collect()} == {(5, "a|1"), (2, "b|2")}
    assert [tuple(r) for r in repeated.collect()] == [("a|1", 2)]


def test_doubt_meets_certainty_through_blocks(spark, monkeypatch):
    """Many sentences of one card: the same pairs whatever the blocks, and the pairs of a plain comparison."""
    notes = [f"He was perhaps born on {1 + k % 3} May 1820 at Dover in the parish of Wye." for k in range(6)]
    flats = [f"He was born on {1 + k % 4} May 1820 at Dover. He was baptised at Wye in 18{40 + k}." for k in range(9)]
    t = tables(spark, [person(k, "Anna Stone", "1820–1890", note=note, bio=flats) for k, note in enumerate(notes, 1)])

    def found():
        return sorted((r["card"], r["sev"], r["path"], r["msg"]) for r in pr.hedge_vs_flat(cd.fields(t)).collect())

    plain = found()
    monkeypatch.setattr(pr, "BLOCK", 2)
    assert found() == plain
    expected = {(k + 1, f"bio[{j}] ↔ note") for k in range(6) for j in range(9) if k % 3 == j % 4}
    assert {(card, " ↔ ".join(sorted(path.split(" ↔ ")))) for card, _, path, _ in plain} >= expected


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_pairs_of_places(spark, seed):
    import numpy as np

    rng = random.Random(seed)
    spots = [(0, k, f"p{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(150)]
    spots += [(1, k, f"p{k}", 48 + rng.uniform(-1, 1), 2 + rng.uniform(-1, 1)) for k in range(150)]
    spots += [(2, k, f"p{k}", rng.choice([10.0, 10.001]), rng.choice([179.99, -179.99])) for k in range(8)]
    spots += [(3, 1, "alone", 1.0, 1.0), (4, 1, "a", 0.0, 0.0), (4, 2, "b", 0.0, 1.0), (5, 1, "x", None, 2.0), (5, 2, "y", 3.0, None)]
    asked = [(card, km, near) for card in range(7) for km, near in ((0.0, 0.5), (7.0, 0.001), (111.0, 1.0), (111.0, 0.1), (9000.0, 0.01), (25000.0, 1.0), (300.0, 90.0))]
    got = nearest_pairs(
        spark.createDataFrame(asked + asked[:5], "card int, km double, near double"), spark.createDataFrame(spots, "card int, k int, n string, lat double, lon double")
    ).collect()

    def km_between(a, b):
        p, q = np.radians(a[3]), np.radians(b[3])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[4] - a[4]) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(np.sqrt(h))

    expected = {}
    for card, km, near in asked:
        own = [x for x in spots if x[0] == card and None not in x]
        gaps = sorted(abs(km_between(a, b) - km) for i, a in enumerate(own) for b in own[i + 1 :])
        if gaps and gaps[0] > near:
            expected.setdefault((card, km), []).append(gaps[:5])
    found = {}
    for r in got:
        found.setdefault((r["card"], r["km"]), []).append([x["gap"] for x in r["near"]])
    assert found.keys() == expected.keys() and len(found) > 12
    for key, gaps in found.items():
        assert [len(x) for x in gaps] == [len(x) for x in expected[key]]
        assert np.allclose(np.concatenate(gaps), np.concatenate(expected[key]), atol=1e-6)


def test_ids_of_findings_are_dense_and_stable(spark):
    rows_ = [(f"C{k % 7}", "med", k % 11, f"p{k % 5}", f"m{k}") for k in range(500)] + [("C1", "high", None, None, None)] * 3 + [("C9", None, 1, "p", "m")]
    frame = spark.createDataFrame(rows_, "check string, sev string, card long, path string, msg string")
    got = [tuple(r) for r in fi.with_ids(frame.repartition(9)).collect()]
    assert sorted(r[0] for r in got) == list(range(1, len(rows_) + 1))
    ordered = sorted(rows_, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in (r[0], r[2], r[3], r[4], r[1])))
    assert [r[1:] for r in sorted(got)] == ordered
    assert sorted(got) == sorted(tuple(r) for r in fi.with_ids(frame.repartition(2)).collect())
    assert fi.with_ids(frame.limit(0)).count() == 0


def test_stored_texts_give_the_same_sentences(spark):
    t = tables(spark, [person(1, "Anna Stone", "1820–1890", note="One. Two! Three?", bio=["Four. Five.", None, ""])])
    shared = cd.StoredTexts(t)
    for kinds in (None, ["bio"], ["tooltip", "pin"]):
        for make in (cd.fields, cd.units_of):
            plain, stored = make(t, kinds), make(shared, kinds)
            assert plain.columns == stored.columns and sorted(map(str, plain.collect())) == sorted(map(str, stored.collect()))
    assert shared.person is t.person and shared.all_units is shared.all_units


def test_contracts_come_with_the_tables(spark):
    t = tables(spark, [person(1, "Anna Stone", "1820–1890", bio=["The family site says she was a weaver."])])
    assert run_checks(t, ["S1", "C5"]).count() == 0
    t.contracts = [{"key": "family-site", "name": r"\bthe family site\b", "excludes": ["career"], "exempt": []}]
    assert [(r["check"], r["path"]) for r in run_checks(t, ["S1"]).collect()] == [("S1", "bio[0]")]
