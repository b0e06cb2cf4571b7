"""Queries over reversions, edit batches of several kinds and their publication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimcheck.operators import batches as ba
from claimcheck.operators import legacy as lg
from claimcheck.plans.registry import query
from claimcheck.session import shared_folder

_FIELDS = "f AS (" + " UNION ALL ".join(f"SELECT card, years || '|' || name AS legacy_key, '{c}' AS path, CAST({c} AS VARCHAR) AS text FROM person WHERE {c} IS NOT NULL" for c in lg.FIELDS) + ")"
_STATE = f"""{_FIELDS},
  v AS (SELECT legacy_key, path, max(value) AS earlier FROM legacy WHERE kind = 'value' GROUP BY legacy_key, path),
  st AS (SELECT coalesce(f.legacy_key, v.legacy_key) AS legacy_key, coalesce(f.path, v.path) AS path,
      CASE WHEN v.path IS NULL THEN f.text ELSE v.earlier END AS earlier, f.text AS now,
      CASE WHEN f.path IS NULL AND v.legacy_key NOT IN (SELECT legacy_key FROM f) THEN 'unresolved' WHEN v.path IS NULL THEN 'kept'
        WHEN v.earlier IS NOT DISTINCT FROM f.text THEN 'same' ELSE 'reverted' END AS change
    FROM f FULL JOIN v ON f.legacy_key = v.legacy_key AND f.path = v.path),
  ph AS (SELECT DISTINCT legacy_key FROM legacy WHERE kind = 'phantom')"""


@query("legacy_state", "person legacy", f"""WITH {_STATE}
  SELECT * FROM st WHERE change <> 'kept' UNION ALL SELECT legacy_key, 'years', split_part(legacy_key, '|', 1), NULL, 'phantom' FROM ph
  UNION ALL SELECT legacy_key, 'name', split_part(legacy_key, '|', 2), NULL, 'phantom' FROM ph""")
def legacy_state(m):
    """What the corrections changed: the state before them beside the base, with the cards that are gone."""
    m = m.staged("person", "legacy")
    return lg.earlier_state(lg.keyed_fields(m.person), m.legacy, m.person).where("change <> 'kept'")


@query("legacy_rules", "person legacy provenance", f"""WITH {_STATE},
  keys AS (SELECT DISTINCT legacy_key FROM f), r AS (SELECT * FROM st WHERE change IN ('same', 'reverted')),
  b AS (SELECT legacy_key, count(DISTINCT path) AS n FROM legacy WHERE kind = 'banner' GROUP BY legacy_key),
  t AS (SELECT tag, count(DISTINCT card) AS n FROM provenance GROUP BY tag), e AS (SELECT * FROM (VALUES ('grafted', 2), ('added', 53), ('lost', 1)) x(tag, n)),
  pp AS (SELECT DISTINCT parent_key FROM legacy WHERE kind = 'phantom')
  SELECT 'legacy key resolves' AS rule, count(*) FILTER (legacy_key NOT IN (SELECT legacy_key FROM keys)) AS violations, count(*) AS total FROM (SELECT DISTINCT legacy_key FROM legacy WHERE kind = 'value')
  UNION ALL SELECT 'superseded value is gone', count(*) FILTER (change = 'same'), count(*) FROM r
  UNION ALL SELECT 'corrected value is present', count(*) FILTER (now IS NULL), count(*) FROM r WHERE earlier IS NOT NULL
  UNION ALL SELECT 'phantom is gone', count(*) FILTER (legacy_key IN (SELECT legacy_key FROM keys)), count(*) FROM ph
  UNION ALL SELECT 'phantom parent resolves', count(*) FILTER (parent_key NOT IN (SELECT legacy_key FROM keys)), count(*) FROM pp
  UNION ALL SELECT 'banner is bilingual', count(*) FILTER (n < 2), count(*) FROM b
  UNION ALL SELECT 'tag count is exact', count(*) FILTER (coalesce(t.n, 0) <> coalesce(e.n, 0)), count(*) FROM t FULL JOIN e ON t.tag = e.tag""")
def legacy_rules(m):
    """Keys, phantoms, banners and tag counts of the reversions."""
    m = m.staged("person", "legacy")
    expected = m.spark.createDataFrame([("grafted", 2), ("added", 53), ("lost", 1)], "tag string, n long")
    return lg.legacy_rules(lg.keyed_fields(m.person), m.legacy, m.person, m.provenance, expected)


@query("legacy_changed", "legacy", "SELECT (SELECT count(*) FROM legacy WHERE kind = 'value' AND path = 'mn' AND value IS NULL) > 0 AS legacy_changed")
def legacy_changed(m):
    """Whether reversions differ from a copy in which absent values became empty ones."""
    m = m.staged("legacy")
    return lg.legacy_changed(m.legacy, m.legacy.withColumn("value", F.when(F.expr("kind = 'value' and path = 'mn'"), F.coalesce("value", F.lit(""))).otherwise(F.col("value"))))


# ------------------------------------------------------------------ batches
def _batch(m, good: bool):
    m = m.staged("person", "op_edit", "source")
    raw = m.op_edit.where("k % 100 <> 51 and k % 200 <> 104 and k % 500 <> 7 and not (k % 50 = 5 and k % 30 > 24) and not (k % 100 = 54 and k % 3 <> 0)") if good else m.op_edit
    edits = ba.typed_edits(raw.select("card", "ord", "seq", F.parse_json("body").alias("edit")))
    fields = lg.keyed_fields(m.person).select("card", "path", "text")
    return ba.apply_batch(edits, fields, m.source, m.place, m.person.where("card % 3 = 0").select("card"))


_OPS = """o AS (SELECT op_edit.*, CASE WHEN k % 500 = 7 THEN 'rename' WHEN k % 50 = 4 THEN 'appendSource' WHEN k % 50 = 5 THEN 'gaz' ELSE 'set' END AS kind FROM op_edit)"""


@query("batch_outcome", "op_edit person", f"""WITH {_OPS}
  SELECT kind, CASE kind WHEN 'gaz' THEN CAST(k % 30 AS VARCHAR) ELSE CAST(card AS VARCHAR) END AS target,
    CASE kind WHEN 'appendSource' THEN 'src' WHEN 'rename' THEN 'title' WHEN 'gaz' THEN NULL ELSE CASE WHEN k % 50 = 6 THEN 'mn_fr' ELSE 'mn' END END AS path, ord, seq,
    CASE WHEN kind = 'rename' THEN 'unknown op' WHEN kind = 'gaz' THEN CASE WHEN k % 30 > 24 THEN 'gaz key not found' ELSE 'applied' END
      WHEN kind = 'appendSource' THEN CASE WHEN card < 0 THEN 'card not found' WHEN k % 100 = 54 AND card % 3 <> 0 THEN 'no profile' ELSE 'applied' END
      WHEN k % 100 = 51 THEN 'expect mismatch' ELSE 'applied' END AS status FROM o""")
def batch_outcome(m):
    """What becomes of each edit of a batch of sets, appended sources, place merges and an unknown op."""
    return _batch(m, False).outcome


_GOOD = "good AS (SELECT * FROM op_edit WHERE k % 100 <> 51 AND k % 200 <> 104 AND k % 500 <> 7 AND NOT (k % 50 = 5 AND k % 30 > 24) AND NOT (k % 100 = 54 AND k % 3 <> 0))"


@query("batch_published", "op_edit person source place", f"""WITH {_FIELDS}, {_GOOD},
  nf AS (SELECT count(*) + (SELECT count(*) FROM good WHERE k % 50 = 2) - (SELECT count(*) FROM good WHERE k % 50 = 6 AND card IN (SELECT card FROM f WHERE path = 'mn_fr')) AS n FROM f),
  ns AS (SELECT count(*) + (SELECT count(*) FROM good WHERE k % 50 = 4) + (SELECT count(*) FROM good WHERE k % 100 = 54) AS n FROM source),
  gp AS (SELECT CAST(k % 30 AS INT) AS key, max(k) AS k FROM good WHERE k % 50 = 5 GROUP BY 1)
  SELECT 1 AS version, 'fields' AS "table", n AS "rows", (SELECT count(*) FROM good WHERE k % 50 IN (1, 2)) AS edited FROM nf
  UNION ALL SELECT 1, 'place', (SELECT count(*) FROM place), (SELECT count(*) FROM gp)
  UNION ALL SELECT 1, 'source', n, (SELECT count(*) FROM good WHERE k % 50 = 4) + (SELECT count(*) FROM good WHERE k % 100 = 54) FROM ns""")
def batch_published(m):
    """A batch with errors publishes nothing; one without publishes three tables as version 1, read back here."""
    root = f"{shared_folder(m.spark)}/published-{uuid.uuid4().hex}"
    for good in (False, True):
        done = _batch(m, good)
        ba.publish(m.spark, root, {"fields": done.fields, "source": done.source, "place": done.place}, done.outcome)
    version = ba.latest(m.spark, root)
    marks = {"fields": "text like 'Moved %' or text like 'First note %'", "place": "n like 'Place %'", "source": "url like 'https://deeds.example.org/%'"}
    parts = [
        ba.published(m.spark, root, name).agg(F.lit(version).alias("version"), F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_if(F.expr(mark)).alias("edited"))
        for name, mark in marks.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("batch_sources", "op_edit source", f"""WITH {_GOOD},
  r AS (SELECT card, k, 'src' AS origin, 'Deed ' || k AS label, 'https://deeds.example.org/' || k AS url FROM good WHERE k % 50 = 4
    UNION ALL SELECT card, k, 'profile.sources', 'Deed', 'https://deeds.example.org/' FROM good WHERE k % 100 = 54),
  l AS (SELECT card, origin, max(pos) + 1 AS nx FROM source GROUP BY card, origin)
  SELECT r.card, r.origin, CAST(coalesce(nx, 0) AS BIGINT) AS pos, label, url FROM r LEFT JOIN l ON l.card = r.card AND l.origin = r.origin""")
def batch_sources(m):
    """Sources that the batch appends, at the end of their card's list."""
    return _batch(m, True).source.where("url like 'https://deeds.example.org/%'").select("card", "origin", "pos", "label", "url")
