"""Readers and writers on small files."""

from __future__ import annotations

import hashlib
import json

from claimcheck.sources import readers as rd
from claimcheck.sources import sinks


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "A", "gaz": {"x": {"n": "X", "lat": 1.5, "lon": 2}}, "src": [{"l": "Letter"}]}))
    docs = rd.json_documents(spark, str(tmp_path / "a.json"))
    g = rd.gazetteer(docs, "doc", "body").first()
    assert (g["k"], g["n"], g["lat"]) == ("x", "X", 1.5)
    assert [r["label"] for r in rd.harvest_labels(docs, "body").collect()] == ["Letter"]


def test_labels_at_any_depth(spark):
    """The walk finds what a recursive reading of the parsed document finds, and nothing in text that is not JSON."""
    bodies = [
        {"l": "a \"b\" \\ é\n\u2028", "x": [[{"l": "deep", "m": {"l": {"l": "inner"}}}, 3, None, "l"], {"l": 5}, {"l": None}, {"l": ["l", {"l": ""}]}]},
        {"a.b": {"": {"l": "odd keys"}}, "l": True},
        ["l", {"l": "in an array"}], "l", 7, None, {}, [], {"l": "42"},
    ]
    nest = {"l": "bottom"}
    for _ in range(40):
        nest = {"c": [nest]}
    bodies.append(nest)

    def labels(node):
        if isinstance(node, list):
            return [x for v in node for x in labels(v)]
        if not isinstance(node, dict):
            return []
        own = [node["l"]] if isinstance(node.get("l"), str) else []
        return own + [x for v in node.values() for x in labels(v)]

    rows = [(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(90, "no json {"), (91, ""), (92, None), (0, json.dumps(bodies[0]))]
    docs = spark.createDataFrame(rows, "id int, body string")
    got = sorted((r.id, r.label) for r in rd.harvest_labels(docs, "body", "id").collect())
    assert got == sorted([(k, x) for k, b in enumerate(bodies) for x in labels(b)] + [(0, x) for x in labels(bodies[0])])
    assert "$.x[0][0].m.l.l" in {r.path for r in rd.harvest_labels(docs, "body").collect()}
    assert rd.harvest_labels(docs.limit(0), "body").count() == 0


def test_url_list_and_state(spark, tmp_path):
    (tmp_path / "urls.tsv").write_text("# comment\nhigh\t3\tpage\thttps://a.org/\nlow\tx\tfile\thttps://b.org/\n")
    got = {r["url"]: (r["id"], r["dependents"]) for r in rd.url_list(spark, str(tmp_path / "urls.tsv")).collect()}
    assert got["https://a.org/"] == (hashlib.sha1(b"https://a.org/").hexdigest()[:12], 3)
    assert got["https://b.org/"][1] == 0
    state = spark.createDataFrame([(json.dumps({"id1": {"ok": True, "file": "f", "fetched": "2024-01-02T00:00:00Z"}}),)], "body string")
    row = rd.capture_state(state, "body").first()
    assert (row["id"], row["ok"], row["file"]) == ("id1", True, "f") and row["fetched"].year == 2024


def test_bodies_transcriptions_contracts(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "p.html").write_text("<p>é</p>")
    (tmp_path / "hand").mkdir()
    (tmp_path / "hand" / "id9.txt").write_text("# url: https://a.org/\nbody")
    assert rd.stored_bodies(spark, str(tmp_path / "store")).first()["body"] == "<p>é</p>"
    assert rd.transcriptions(spark, str(tmp_path / "hand")).first()["id"] == "id9"
    sheet = "status: VERIFIED\n```contract\nexcludes: career, nonsense | day-date\nexempt: (none)\n```\n"
    df = spark.createDataFrame([("family-site", sheet), ("unknown", sheet)], "key string, text string")
    r = rd.contract_sheets(df).collect()
    assert [(x["key"], x["excludes"], x["exempt"], x["status"]) for x in r] == [("family-site", ["career", "day-date"], [], "VERIFIED")]


def test_edit_batches_keep_order(spark, tmp_path):
    for b in ("b1", "b2", "stray"):
        (tmp_path / f"{b}.json").write_text(json.dumps([{"card": "A|1", "edits": [{"path": "note", "value": b}, {"path": "mn", "value": b}]}]))
    order = spark.createDataFrame([("b1", 2), ("b2", 1)], "batch string, ord int")
    got = [(r["ord"], r["seq"], r["value"]) for r in rd.edit_batches(spark, str(tmp_path), order).orderBy("ord", "seq").collect()]
    assert got == [(1, 0, "b2"), (1, 1, "b2"), (2, 0, "b1"), (2, 1, "b1")]


def test_sinks_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("C5", "high", 1, "note", "m"), ("X9", "low", 2, "mn", "n")], "check string, sev string, card long, path string, msg string")
    sinks.write_findings(f, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("check = 'C5'").count() == 1
    c = spark.createDataFrame([("i", "https://a.org/", "a.org", "high", "page", "L", 3, "src")], "id string, url string, host string, risk string, kind string, label string, dependents long, where string")
    sinks.write_catalog(c, str(tmp_path / "c"))
    sinks.write_public_catalog(c, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "c")).first()["host"] == "a.org"
    assert spark.read.csv(str(tmp_path / "p"), sep="\t").first()[0] == "high" and len(spark.read.csv(str(tmp_path / "p"), sep="\t").columns) == 4
    e = spark.createDataFrame([(1, "pl[0].c", "doc", "inf", "w", False), (2, "pl[1]", None, None, "none", True)], "card long, path string, expect string, value string, why string, skipped boolean")
    sinks.write_edits(e, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 1
    for name, fn in [("a", sinks.write_audit), ("i", sinks.write_claim_index)]:
        fn(f, str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).count() == 2
    sinks.write_diff(f, c, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d" / "places")).count() == 1


def test_row_local_rules_run_on_a_stream(spark, tmp_path):
    from claimcheck.operators import prose as pr

    src = spark.createDataFrame([(1, "note", "en", "tooltip", "It was was so.")], "card long, path string, lang string, kind string, text string")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = pr.typography(stream).writeStream.format("memory").queryName("typo").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT msg FROM typo").first()["msg"] == 'repeated word "was"'
