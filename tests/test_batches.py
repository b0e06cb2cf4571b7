"""Reversions, typed edit batches and publication on small cases with known answers."""

from __future__ import annotations

import json
import types

import pytest
from pyspark.sql import functions as F

from claimcheck.operators import batches as ba
from claimcheck.operators import legacy as lg
from claimcheck.plans.card_model import Cards
from claimcheck.sources import readers as rd
from claimcheck.sources import sinks

LEGACY = "legacy_key string, kind string, path string, value string, parent_key string"
PERSON = "card long, name string, years string, mn string"


def people(spark):
    return spark.createDataFrame([(1, "A", "1–2", "here"), (2, "A", "1–2", None), (3, "B", None, "x|y"), (4, None, "5–6", "z")], PERSON)


def state(spark, legacy):
    p = people(spark)
    found = lg.earlier_state(lg.keyed_fields(p, ["name", "years", "mn"]), spark.createDataFrame(legacy, LEGACY), p)
    return sorted(map(tuple, found.where("change <> 'kept'").collect()), key=str)


def test_reversions_rebuild_the_earlier_state(spark):
    legacy = [
        ("1–2|A", "value", "years", "0–2", None), ("|B", "value", "mn", "x|y", None), ("5–6|", "value", "name", "Z", None), ("5–6|", "value", "mn", None, None),
        ("9|C", "value", "mn", "q", None), ("7–?|D", "phantom", None, None, "|B"), ("7–?|D", "phantom", None, None, "|B"), ("|E", "phantom", None, None, None),
    ]
    # both cards of a shared key are reverted, an absent field comes back, a deleted one goes
    assert state(spark, legacy) == sorted([
        ("1–2|A", "years", "0–2", "1–2", "reverted"), ("1–2|A", "years", "0–2", "1–2", "reverted"), ("|B", "mn", "x|y", "x|y", "same"), ("5–6|", "name", "Z", None, "reverted"),
        ("5–6|", "mn", None, "z", "reverted"), ("9|C", "mn", "q", None, "unresolved"), ("7–?|D", "years", "7–?", None, "phantom"), ("7–?|D", "name", "D", None, "phantom"), ("|E", "name", "E", None, "phantom"),
    ], key=str)
    assert state(spark, []) == []


def test_legacy_rules_count_violations(spark):
    p = people(spark)
    legacy = [
        ("1–2|A", "value", "years", "1–2", None), ("no", "value", "mn", "q", None), ("|B", "value", "years", "3", None), ("|B", "phantom", None, None, "no"),
        ("b", "banner", "banner", "x", None), ("b", "banner", "banner_fr", "", None),
    ]
    tags = spark.createDataFrame([(1, "t"), (1, "t"), (2, "u")], "card long, tag string")
    expected = spark.createDataFrame([("t", 1), ("v", 2)], "tag string, n long")
    got = {r.rule: (r.violations, r.total) for r in lg.legacy_rules(lg.keyed_fields(p, ["name", "years", "mn"]), spark.createDataFrame(legacy, LEGACY), p, tags, expected).collect()}
    assert got == {
        "legacy key resolves": (1, 3), "superseded value is gone": (2, 3), "corrected value is present": (1, 3), "phantom is gone": (1, 1),
        "phantom parent resolves": (1, 1), "banner is bilingual": (1, 1), "tag count is exact": (2, 3),
    }


def test_changed_reversions_set_the_flag_of_the_diff(spark, tmp_path):
    a = spark.createDataFrame([("k", "value", "mn", None, None), ("k", "value", "mn", None, None)], LEGACY)
    assert not lg.legacy_changed(a, a.limit(1)).first()[0]
    assert lg.legacy_changed(a, a.withColumn("value", F.lit(""))).first()[0] and lg.legacy_changed(a, a.limit(0)).first()[0]
    sinks.write_diff(a, a, str(tmp_path / "d"), lg.legacy_changed(a, a))
    assert [r.legacy_changed for r in spark.read.parquet(str(tmp_path / "d" / "legacy")).collect()] == [False]


def test_typed_edits_read_from_files(spark, tmp_path):
    edits = [
        {"path": "mn", "expect": None, "value": "new"}, {"path": "note", "value": None, "why": "gone"}, {"op": "appendSource", "value": {"l": "L", "u": 5}, "profileValue": {"label": "P"}},
        {"op": "gaz", "key": "3", "value": {"n": "N", "lat": 1.5}},
    ]
    (tmp_path / "b1.json").write_text(json.dumps([{"card": "c", "edits": edits}]))
    (tmp_path / "skipped.json").write_text(json.dumps({"card": "c", "edits": edits}))
    raw = rd.typed_edit_batches(spark, str(tmp_path), spark.createDataFrame([("b1", 4)], "batch string, ord int"))
    got = ba.typed_edits(raw).select("card", "ord", "seq", "op", "path", "key", "expect", "guarded", F.to_json("value"), F.to_json("profile_value"), "why").orderBy("seq").collect()
    assert [tuple(r) for r in got] == [
        ("c", 4, 0, "set", "mn", None, None, True, '"new"', None, None), ("c", 4, 1, "set", "note", None, None, False, "null", None, "gone"),
        ("c", 4, 2, "appendSource", None, None, None, False, '{"l":"L","u":5}', '{"label":"P"}', None), ("c", 4, 3, "gaz", None, "3", None, False, '{"lat":1.5,"n":"N"}', None, None),
    ]


def tables(spark):
    t = types.SimpleNamespace()
    t.fields = spark.createDataFrame([(1, "note", "a"), (1, "profile.headline", "h"), (2, "note", "b")], "card long, path string, text string")
    t.source = spark.createDataFrame([(1, "src", 4, "old", None, "u", None), (1, "profile.sources", 0, "p", None, "u", None)], "card long, origin string, pos long, label string, label_fr string, url string, quote string")
    t.place = spark.createDataFrame([(1, "N", 1.0), (2, "M", 2.0)], "k int, n string, lat double")
    t.profiles = spark.createDataFrame([(1,)], "card long")
    return t


def batch(spark, edits):
    rows = [(card, 1, seq, json.dumps(e)) for seq, (card, e) in enumerate(edits)]
    raw = spark.createDataFrame(rows, "card long, ord int, seq long, body string")
    t = tables(spark)
    return ba.apply_batch(ba.typed_edits(raw.select("card", "ord", "seq", F.parse_json("body").alias("edit"))), t.fields, t.source, t.place, t.profiles)


GOOD = [
    (1, {"path": "note", "expect": "a", "value": "b"}), (1, {"path": "note", "expect": "b", "value": None}), (2, {"path": "mn", "expect": None, "value": "m"}),
    (1, {"op": "appendSource", "value": {"l": "x"}}), (1, {"op": "appendSource", "value": {"l": "y", "u": "v"}, "profileValue": {"label": "py", "label_fr": "pf"}}),
    (None, {"op": "gaz", "key": "2", "value": {"lat": 9}}), (None, {"op": "gaz", "key": "2", "value": {"lat": 8, "n": "M2"}}),
]


def test_batch_applies_each_op_to_its_table(spark):
    done = batch(spark, GOOD)
    assert {r.status for r in done.outcome.collect()} == {"applied"} and done.outcome.count() == len(GOOD)
    assert sorted(map(tuple, done.fields.collect())) == [(1, "profile.headline", "h"), (2, "mn", "m"), (2, "note", "b")]
    assert sorted((r.origin, r.pos, r.label, r.label_fr, r.url) for r in done.source.where("label <> 'old'").collect()) == [
        ("profile.sources", 0, "p", None, "u"), ("profile.sources", 1, "py", "pf", None), ("src", 5, "x", None, None), ("src", 6, "y", None, "v")]
    assert sorted(map(tuple, done.place.collect())) == [(1, "N", 1.0), (2, "M2", 8.0)]


def test_errors_of_each_op_are_named(spark):
    edits = [
        (1, {"path": "note", "expect": "zzz", "value": "b"}), (9, {"path": "note", "value": "b"}), (1, {"path": "nope", "value": "b"}), (9, {"op": "appendSource", "value": {"l": "x"}}),
        (2, {"op": "appendSource", "value": {"l": "x"}, "profileValue": {"label": "p"}}), (None, {"op": "gaz", "key": "7", "value": {"n": "x"}}), (None, {"op": "gaz", "key": "Rome", "value": {"n": "x"}}), (1, {"op": "rename"}),
    ]
    got = {r.seq: r.status for r in batch(spark, edits).outcome.collect()}
    assert [got[k] for k in range(len(edits))] == ["expect mismatch", "card not found", "unknown path", "card not found", "no profile", "gaz key not found", "gaz key not found", "unknown op"]


def test_all_tables_are_published_or_none(spark, tmp_path):
    root = str(tmp_path / "pub")

    def put(edits):
        done = batch(spark, edits)
        return ba.publish(spark, root, {"fields": done.fields, "source": done.source, "place": done.place}, done.outcome)

    assert ba.latest(spark, root) is None
    with pytest.raises(ValueError):
        ba.published(spark, root, "fields")
    bad_append = [*GOOD, (9, {"op": "appendSource", "value": {"l": "x"}})]
    assert put(bad_append) is None and ba.latest(spark, root) is None and not (tmp_path / "pub").exists()
    assert put(GOOD) == 1 and put(GOOD[2:]) == 2 and put(bad_append) is None
    assert ba.latest(spark, root) == 2
    assert ba.published(spark, root, "fields", 1).count() == 3 and ba.published(spark, root, "fields").count() == 4
    with pytest.raises(ValueError):
        ba.published(spark, root, "other")


def test_a_version_without_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "pub")
    one = spark.range(3)
    assert ba.publish(spark, root, {"t": one}) == 1
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        ba.publish(spark, root, {"t": spark.range(5), "u": broken})
    assert ba.latest(spark, root) == 1 and ba.published(spark, root, "t").count() == 3


def test_composed_batch_has_every_kind_of_error(spark):
    from claimcheck.plans import q_legacy

    found = {r.status for r in q_legacy._batch(Cards(spark, "/root/testdata/sf0.001"), False).outcome.select("status").distinct().collect()}
    assert {"applied", "expect mismatch", "gaz key not found"} <= found
