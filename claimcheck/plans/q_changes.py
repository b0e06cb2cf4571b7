"""Queries over change data."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from claimcheck.operators import changes as ch
from claimcheck.plans import sql_text as sq
from claimcheck.plans.registry import query

FN = sq.FIELD_NEEDS
_KEY = "name || '|' || years"

SNAP = """snap AS (
  SELECT card, 'note' AS field, note AS value FROM person UNION ALL SELECT card, 'note_fr', note_fr FROM person UNION ALL SELECT card, 'mn', mn FROM person UNION ALL SELECT card, 'mn_fr', mn_fr FROM person
  UNION ALL SELECT card, 'name', name FROM person UNION ALL SELECT card, 'years', years FROM person UNION ALL SELECT card, 'g', g FROM person
  UNION ALL SELECT card, 'profile.headline', headline FROM person UNION ALL SELECT card, 'profile.headline_fr', headline_fr FROM person
  UNION ALL SELECT card, 'bio[' || (j - 1) || ']', bio[j] FROM person, unnest([1, 2, 3]) u(j) UNION ALL SELECT card, 'bio_fr[' || (j - 1) || ']', bio_fr[j] FROM person, unnest([1, 2, 3]) u(j)
  UNION ALL SELECT card, 'src[' || pos || '].l', label FROM source WHERE origin = 'src' UNION ALL SELECT card, 'src[' || pos || '].u', url FROM source WHERE origin = 'src' UNION ALL SELECT card, 'src[' || pos || '].q', quote FROM source WHERE origin = 'src'
  UNION ALL SELECT card, 'psrc[' || pos || '].label', label FROM source WHERE origin <> 'src' UNION ALL SELECT card, 'psrc[' || pos || '].label_fr', label_fr FROM source WHERE origin <> 'src' UNION ALL SELECT card, 'psrc[' || pos || '].url', url FROM source WHERE origin <> 'src'
  UNION ALL SELECT card, 'docs[' || pos || '].cap', cap FROM doc UNION ALL SELECT card, 'docs[' || pos || '].cap_fr', cap_fr FROM doc UNION ALL SELECT card, 'docs[' || pos || '].tr', tr FROM doc UNION ALL SELECT card, 'docs[' || pos || '].tr_fr', tr_fr FROM doc UNION ALL SELECT card, 'docs[' || pos || '].u', u FROM doc
  UNION ALL SELECT card, 'docs[' || pos || '].img.len', CAST(length(img) AS VARCHAR) FROM doc
  UNION ALL SELECT card, 'union[' || union_idx || '].s', s FROM union_ UNION ALL SELECT card, 'union[' || union_idx || '].sy', sy FROM union_ UNION ALL SELECT card, 'union[' || union_idx || '].n', n FROM union_ UNION ALL SELECT card, 'union[' || union_idx || '].n_fr', n_fr FROM union_
  UNION ALL SELECT card, 'pl[' || pos || ']', '{' || array_to_string(list_filter(['"k":' || k, '"t":"' || t || '"', '"c":"' || c || '"', '"y":' || y, '"y2":' || y2, '"d":"' || d || '"', '"x":' || x], lambda v: v IS NOT NULL), ',') || '}' FROM event
  UNION ALL SELECT card, 'pl[' || pos || '].w', w FROM event UNION ALL SELECT card, 'pl[' || pos || '].w_fr', w_fr FROM event),
  sv AS (SELECT snap.*, p.card_key FROM snap JOIN person p ON snap.card = p.card WHERE value IS NOT NULL)"""


@query("comparable_fields", FN, f"WITH {SNAP} SELECT card_key, field, value FROM sv")
def comparable_fields(m):
    return ch.comparable_fields(m)


def _after(m):
    """A later snapshot: one card in 101 gone, notes and dates changed, some cards new."""
    p = m.person.where("card % 101 <> 3").select(
        *[c for c in m.person.columns if c not in ("note", "mn", "g")],
        F.when(F.expr("card % 50 = 7"), F.concat("note", F.lit(" Corrected."))).otherwise(F.col("note")).alias("note"),
        F.when(F.expr("card % 70 = 9"), F.lit("Added later.")).otherwise(F.col("mn")).alias("mn"),
        F.when(F.expr("card % 90 = 11"), F.lit(None).cast("string")).otherwise(F.col("g")).alias("g"),
    )
    new = m.person.where("card % 200 = 1").withColumn("card", -F.col("card")).withColumn("card_key", F.concat(F.lit("New "), "card_key"))
    return SimpleNamespace(person=p.unionByName(new.select(*p.columns)), source=m.source, doc=m.doc, union_=m.union_, event=m.event)


def _last(t):
    """A snapshot in which each key stands for one card, the last, and the keys that several cards had."""
    person, repeated = ch.latest_by_key(t.person)
    return SimpleNamespace(person=person, source=t.source, doc=t.doc, union_=t.union_, event=t.event), repeated


def _diff(m):
    m = m.staged("person")
    (before, _), (after, _) = _last(m), _last(_after(m))
    return ch.snapshot_diff(ch.comparable_fields(before), ch.comparable_fields(after), before.person.select("card_key"), after.person.select("card_key"))


DIFF = f"""{SNAP}, kb AS (SELECT card_key, max(card) AS card FROM person GROUP BY card_key),
  pa AS (SELECT card, card_key FROM person WHERE card % 101 <> 3 UNION ALL SELECT -card, 'New ' || card_key FROM person WHERE card % 200 = 1),
  ka AS (SELECT card_key, max(card) AS card FROM pa GROUP BY card_key),
  fa AS (SELECT ka.card_key, field, CASE WHEN field = 'note' AND s.card % 50 = 7 THEN value || ' Corrected.' ELSE value END AS value FROM ka JOIN snap s ON s.card = ka.card WHERE NOT (field = 'mn' AND s.card % 70 = 9) AND NOT (field = 'g' AND s.card % 90 = 11)
    UNION ALL SELECT card_key, 'mn', 'Added later.' FROM ka WHERE card % 70 = 9),
  fb AS (SELECT kb.card_key, field, value FROM kb JOIN snap s ON s.card = kb.card),
  diff AS (SELECT card_key, 'REMOVED' AS kind, NULL AS field, NULL AS before, NULL AS after FROM kb WHERE card_key NOT IN (SELECT card_key FROM ka)
    UNION ALL SELECT card_key, 'ADDED', NULL, NULL, NULL FROM ka WHERE card_key NOT IN (SELECT card_key FROM kb)
    UNION ALL SELECT coalesce(fb.card_key, fa.card_key), 'CHANGED', coalesce(fb.field, fa.field), fb.value, fa.value FROM (SELECT * FROM fb WHERE value IS NOT NULL) fb FULL JOIN (SELECT * FROM fa WHERE value IS NOT NULL) fa ON fa.card_key = fb.card_key AND fa.field = fb.field
      WHERE fa.value IS DISTINCT FROM fb.value AND coalesce(fb.card_key, fa.card_key) IN (SELECT card_key FROM kb) AND coalesce(fb.card_key, fa.card_key) IN (SELECT card_key FROM ka))"""


@query("snapshot_diff", FN, f"WITH {DIFF} SELECT * FROM diff")
def snapshot_diff(m):
    return _diff(m)


@query("diff_totals", FN, f"WITH {DIFF} SELECT count(DISTINCT card_key) AS cards_changed, count(*) FILTER (kind = 'CHANGED') AS fields_changed, count(*) FILTER (kind = 'ADDED') AS added, count(*) FILTER (kind = 'REMOVED') AS removed FROM diff")
def diff_totals(m):
    return ch.diff_totals(_diff(m))


@query("diff_duplicates", "person", "SELECT card_key, count(*) AS n FROM person GROUP BY card_key HAVING count(*) > 1")
def diff_duplicates(m):
    return _last(m)[1]


@query("map_diff", "", """SELECT c_custkey AS key, CASE WHEN c_custkey % 80 = 5 THEN NULL ELSE c_mktsegment END AS seg_before, CASE WHEN c_custkey % 80 = 6 THEN NULL WHEN c_custkey % 80 = 7 THEN 'MOVED' ELSE c_mktsegment END AS seg_after FROM customer WHERE c_custkey % 80 IN (5, 6, 7)""")
def map_diff(m):
    base = m.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"))
    a = base.where("key % 80 <> 5")
    b = base.where("key % 80 <> 6").withColumn("seg", F.expr("CASE WHEN key % 80 = 7 THEN 'MOVED' ELSE seg END"))
    d = ch.map_diff(a, b, "key")
    return d.select("key", F.get_json_object("before", "$.seg").alias("seg_before"), F.get_json_object("after", "$.seg").alias("seg_after"))


# ------------------------------------------------------------------ edits
BATCHES = [("b1", 1, "first pass"), ("b2", 2, "second pass")]


def _batches(m):
    return m.spark.createDataFrame(BATCHES, "batch string, ord int, what string")


def _edits(m):
    """Edits of names, and of notes that are absent at first, written, deleted, written again and asked for in vain."""
    steps = F.expr("""inline(array(
      named_struct('ord', 1, 'seq', 10L, 'expect', cast(null as string), 'value', 'first'), named_struct('ord', 1, 'seq', 11L, 'expect', 'first', 'value', cast(null as string)),
      named_struct('ord', 2, 'seq', 0L, 'expect', cast(null as string), 'value', p_name), named_struct('ord', 2, 'seq', 1L, 'expect', 'never held', 'value', 'x'),
      named_struct('ord', 3, 'seq', 0L, 'expect', p_name, 'value', 'last')))""")
    notes = m.part.where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("card"), F.lit("note").alias("path"), steps)
    notes = notes.select("*", F.lit(None).cast("string").alias("why"), F.lit(True).alias("guarded"))
    names = m.edit.join(_batches(m), "batch").select(
        F.expr("CASE WHEN card % 130 = 0 THEN -1 - card ELSE card END").alias("card"),
        F.expr("CASE WHEN card % 110 = 0 THEN 'title' ELSE path END").alias("path"),
        "ord", F.col("seq").cast("long").alias("seq"), "expect", "value", "why", F.col("expect").isNotNull().alias("guarded"),
    )
    return names.unionByName(notes)


def _current(m):
    return m.part.select(F.col("p_partkey").alias("card"), F.lit("name").alias("path"), F.col("p_name").alias("text"))


@query("merge_cas", "edit", """WITH e AS (SELECT edit.*, p_name FROM edit JOIN part ON p_partkey = card WHERE batch IN ('b1', 'b2')),
  o AS (SELECT CASE WHEN card % 130 = 0 THEN -1 - card ELSE card END AS card, CASE WHEN card % 110 = 0 THEN 'title' ELSE path END AS path, CASE batch WHEN 'b1' THEN 1 ELSE 2 END AS ord, seq,
    CASE WHEN card % 130 = 0 THEN 'card not found' WHEN card % 110 = 0 THEN 'unknown path' WHEN card % 70 = 0 THEN 'expect mismatch' ELSE 'applied' END AS status,
    CASE WHEN card % 130 = 0 OR card % 110 = 0 THEN NULL WHEN seq = 0 OR card % 70 = 0 THEN p_name ELSE p_name || ' one' END AS before, value FROM e)
  SELECT card, path, ord, seq, status, before, value FROM o
  UNION ALL SELECT p_partkey, 'note', 1, 10, 'applied', NULL, 'first' FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT p_partkey, 'note', 1, 11, 'applied', 'first', NULL FROM part WHERE p_partkey % 10 = 3
  UNION ALL SELECT p_partkey, 'note', 2, 0, 'applied', NULL, p_name FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT p_partkey, 'note', 2, 1, 'expect mismatch', p_name, 'x' FROM part WHERE p_partkey % 10 = 3
  UNION ALL SELECT p_partkey, 'note', 3, 0, 'applied', p_name, 'last' FROM part WHERE p_partkey % 10 = 3""")
def merge_cas(m):
    return ch.apply_edits(_edits(m), _current(m)).drop("why")


@query("merged_fields", "edit", """WITH e AS (SELECT DISTINCT card FROM edit WHERE batch IN ('b1', 'b2') AND card % 130 <> 0 AND card % 110 <> 0 AND card % 70 <> 0)
  SELECT p_partkey AS card, 'name' AS path, CASE WHEN e.card IS NULL THEN p_name ELSE p_name || ' two' END AS text FROM part LEFT JOIN e ON e.card = p_partkey WHERE NOT (e.card IS NOT NULL AND p_partkey % 90 = 0)
  UNION ALL SELECT p_partkey, 'note', 'last' FROM part WHERE p_partkey % 10 = 3""")
def merged_fields(m):
    return ch.merged_fields(_current(m), ch.apply_edits(_edits(m), _current(m)))


@query("append_edit", "source", """WITH a AS (SELECT o_custkey AS card, o_orderkey AS seq, o_orderkey % 3 = 0 AS tp FROM orders WHERE o_orderkey % 4 = 1),
  r AS (SELECT card, seq, 'src' AS origin FROM a UNION ALL SELECT card, seq, 'profile.sources' FROM a WHERE tp AND card % 2 = 0),
  l AS (SELECT card, origin, max(pos) + 1 AS nx FROM source GROUP BY card, origin)
  SELECT r.card, r.origin, coalesce(nx, 0) + row_number() OVER (PARTITION BY r.card, r.origin ORDER BY seq) - 1 AS pos, 'Order ' || seq AS label FROM r LEFT JOIN l ON l.card = r.card AND l.origin = r.origin""")
def append_edit(m):
    a = m.orders.where("o_orderkey % 4 = 1").selectExpr(
        "o_custkey AS card", "o_orderkey AS seq", "'Order ' || o_orderkey AS label", "CAST(NULL AS STRING) AS label_fr", "CAST(NULL AS STRING) AS url", "o_orderkey % 3 = 0 AS to_profile"
    )
    new, _ = ch.append_sources(m.source, a, m.customer.where("c_custkey % 2 = 0").selectExpr("c_custkey AS card"))
    return new.select("card", "origin", "pos", "label")


@query("gaz_merge", "place", """WITH e AS (SELECT CAST(s_suppkey % 30 AS INT) AS k, max(s_suppkey) FILTER (s_suppkey % 2 = 0) AS ln, max(s_suppkey) FILTER (s_suppkey % 3 = 0) AS ll FROM supplier GROUP BY 1)
  SELECT p.k, CASE WHEN ln IS NOT NULL THEN 'Place ' || ln ELSE p.n END AS n, CASE WHEN ll IS NOT NULL THEN CAST(ll % 90 AS DOUBLE) ELSE p.lat END AS lat, (SELECT count(*) FROM supplier WHERE s_suppkey % 30 > 24) AS errors FROM place p LEFT JOIN e ON e.k = p.k""")
def gaz_merge(m):
    e = m.supplier.selectExpr(
        "CAST(s_suppkey % 30 AS INT) AS k", "s_suppkey AS seq", "CASE WHEN s_suppkey % 2 = 0 THEN 'Place ' || s_suppkey END AS n", "CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 90 AS DOUBLE) END AS lat"
    )
    out, bad = ch.merge_places(m.place, e)
    return out.select("k", "n", "lat", bad.agg(F.count("*")).scalar().alias("errors"))


@query("edit_history", "edit", """SELECT card, CASE batch WHEN 'b1' THEN 1 ELSE 2 END AS ord, batch, seq, path, coalesce(why, '(no reason given)') AS why, '- ' || expect || ' + ' || coalesce(value, 'null') AS change FROM edit WHERE batch IN ('b1', 'b2')""")
def edit_history(m):
    return ch.edit_history(m.edit, _batches(m).select("batch", "ord"))


@query("edits_per_card", "edit", """SELECT card, count(*) AS edits, count(DISTINCT batch) AS batches FROM edit WHERE batch IN ('b1', 'b2') GROUP BY card""")
def edits_per_card(m):
    h = ch.edit_history(m.edit, _batches(m).select("batch", "ord"))
    return h.groupBy("card").agg(F.count("*").alias("edits"), F.countDistinct("batch").alias("batches"))
