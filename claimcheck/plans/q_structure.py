"""Queries over the tree, life spans and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.operators import structure as st
from claimcheck.operators import tree as tr
from claimcheck.plans.card_model import idiv, jdn_sql, pick
from claimcheck.plans.registry import query

# ------------------------------------------------------------------ shared SQL pieces
SPAN = """span AS (SELECT card, years,
  CASE WHEN regexp_matches(years, '^(c|b)\\. ') THEN CAST(regexp_extract(years, '(\\d{4})', 1) AS INT)
       ELSE CAST(regexp_extract(years, '^(\\d{4})–', 1) AS INT) END AS b,
  CASE WHEN regexp_matches(years, '^(c|b)\\. ') THEN NULL
       ELSE CAST(regexp_extract(years, '–(\\d{4})$', 1) AS INT) END AS d_ FROM person)"""
MONTH_NO = "CASE regexp_extract(d, ' ([A-Za-z]+) ', 1) " + " ".join(
    f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(lx.MONTHS_EN)
) + " END"
DATED = f"""dated AS (SELECT event.*, CAST(nullif(regexp_extract(d, '(\\d{{4}})$', 1), '') AS INT) AS ddy,
  {MONTH_NO} AS ddm, CAST(nullif(regexp_extract(d, '^(\\d+)', 1), '') AS INT) AS ddd FROM event)"""
ORD = "CASE t WHEN 'birth' THEN 0 WHEN 'baptism' THEN 1 WHEN 'death' THEN 9 WHEN 'burial' THEN 10 END"
WALK = """
walk AS (WITH RECURSIVE w AS (
    SELECT card, 'root' AS path, 0 AS depth FROM person WHERE parent_card IS NULL
    UNION ALL
    SELECT p.card, w.path || '/u' || p.union_idx || 'c' || p.child_idx, w.depth + 1
    FROM person p JOIN w ON p.parent_card = w.card)
  SELECT * FROM w)"""


@query("tree_flatten", "person", f"""WITH {WALK},
  keyed AS (SELECT *, list_transform(string_split(path, '/'), lambda s: CASE WHEN s = 'root' THEN 0 ELSE
    CAST(regexp_extract(s, 'u(\\d+)', 1) AS INT) * 1000000 + CAST(regexp_extract(s, 'c(\\d+)', 1) AS INT) END) AS ord FROM walk),
  closure AS (SELECT a.card, count(*) AS n FROM walk a JOIN walk b ON b.path LIKE a.path || '/%' GROUP BY a.card)
  SELECT k.card, path, depth, coalesce(n, 0) AS descendants,
    row_number() OVER (ORDER BY ord) - 1 AS idx FROM keyed k LEFT JOIN closure c ON k.card = c.card""")
def tree_flatten(m):
    """Paths, depth, descendant counts and pre-order index."""
    return tr.preorder(m.person).select("card", "path", "depth", "descendants", "idx")


@query("descendant_counts", "person", f"""WITH {WALK}
  SELECT a.card, a.depth, (SELECT count(*) FROM walk b WHERE b.path LIKE a.path || '/%') AS descendants FROM walk a""")
def descendant_counts(m):
    return tr.descendant_counts(m.person).select("card", "depth", "descendants")


@query("subtree_filter", "person", f"""WITH {WALK},
  heads AS (SELECT card, path FROM walk WHERE card IN (SELECT card FROM person WHERE name LIKE '%Fiora Gravenor'))
  SELECT card, path, depth FROM walk w WHERE EXISTS (SELECT 1 FROM heads h
    WHERE w.path = h.path OR w.path LIKE h.path || '/%' OR h.path LIKE w.path || '/%')""")
def subtree_filter(m):
    heads = m.person.where(F.col("name").endswith("Fiora Gravenor")).select("card")
    return tr.branch_filter(tr.preorder(m.person).withColumn("leave", F.col("idx") + F.col("descendants")).withColumnRenamed("idx", "enter"), heads).select("card", "path", "depth")


_BRANCH = """, w AS (WITH RECURSIVE b AS (
    SELECT card, anchor AS branch, CASE WHEN anchor IS NOT NULL THEN card END AS head FROM person WHERE parent_card IS NULL
    UNION ALL
    SELECT p.card, coalesce(p.anchor, b.branch), CASE WHEN p.anchor IS NOT NULL THEN p.card ELSE b.head END
    FROM person p JOIN b ON p.parent_card = b.card)
  SELECT * FROM b)"""


@query("tree_intervals", "person", f"""WITH {WALK},
  sized AS (SELECT a.card, a.depth, a.path, (SELECT count(*) FROM walk b WHERE b.path = a.path OR b.path LIKE a.path || '/%') AS size FROM walk a),
  numbered AS (SELECT *, row_number() OVER (ORDER BY list_transform(string_split(path, '/'), lambda s: CASE WHEN s = 'root' THEN 0 ELSE
    CAST(regexp_extract(s, 'u(\\d+)', 1) AS INT) * 1000000 + CAST(regexp_extract(s, 'c(\\d+)', 1) AS INT) END)) - 1 AS enter FROM sized)
  SELECT card, depth, size, enter, enter + size - 1 AS leave FROM numbered""")
def tree_intervals(m):
    """Euler-tour intervals of every card."""
    return tr.tree_intervals(m.person)


@query("branch_of", "person", f"WITH one AS (SELECT 1){_BRANCH} SELECT card, head, branch FROM w")
def branch_of(m):
    """The branch that each card belongs to."""
    return tr.branches(m.person)


@query("branch_sizes", "person", f"""WITH one AS (SELECT 1){_BRANCH}
  SELECT branch, head, count(*) AS cards, min(card) AS first_card, max(card) AS last_card FROM w GROUP BY branch, head""")
def branch_sizes(m):
    """Cards of each branch without the branches inside it."""
    return tr.branches(m.person).groupBy("branch", "head").agg(F.count("*").alias("cards"), F.min("card").alias("first_card"), F.max("card").alias("last_card"))


@query("anchor_rules", "person", """WITH asked AS (SELECT unnest(['trunk', 'north', 'south', 'hill', 'shore']) AS anchor),
  carried AS (SELECT anchor, count(*) AS cards FROM person WHERE anchor IS NOT NULL GROUP BY anchor)
  SELECT coalesce(a.anchor, c.anchor) AS anchor, coalesce(cards, 0) AS cards,
    CASE WHEN a.anchor IS NULL THEN 'unknown' WHEN cards IS NULL THEN 'missing' WHEN cards > 1 THEN 'ambiguous' ELSE 'ok' END AS verdict
  FROM asked a FULL JOIN carried c ON a.anchor = c.anchor""")
def anchor_rules(m):
    """Required navigation anchors against those that cards carry."""
    required = m.spark.createDataFrame([(a,) for a in ("trunk", "north", "south", "hill", "shore")], "anchor string")
    return tr.anchor_rules(m.person, required)


_JSON = """'{"name":"O' || o_orderkey || '","years":"' || CAST(1800 + o_orderkey % 90 AS VARCHAR(9)) || '","unions":[{"c":[{"name":"A' || o_orderkey || '"},{"name":"B' || o_orderkey || '","unions":[{"s":"x"},{"c":[{"name":"C' || o_custkey || '","years":"1900"}]}]}]}]}'"""


@query("variant_tree_scan", "", """
  SELECT o_orderkey AS doc, 'root' AS path, NULL AS parent_path, 'O' || o_orderkey AS name, CAST(1800 + o_orderkey % 90 AS VARCHAR) AS years FROM orders
  UNION ALL SELECT o_orderkey, 'root/u0c0', 'root', 'A' || o_orderkey, NULL FROM orders
  UNION ALL SELECT o_orderkey, 'root/u0c1', 'root', 'B' || o_orderkey, NULL FROM orders
  UNION ALL SELECT o_orderkey, 'root/u0c1/u1c0', 'root/u0c1', 'C' || o_custkey, '1900' FROM orders""")
def variant_tree_scan(m):
    docs = m.orders.selectExpr("o_orderkey AS doc", f"{_JSON} AS body")
    return tr.variant_tree(docs, "doc", "body")


@query("place_lookup", "event place", "SELECT e.card, e.pos, e.k, p.n, p.lat, p.lon FROM event e LEFT JOIN place p ON e.k = p.k")
def place_lookup(m):
    return st.place_join(m.event, m.place).select("card", "pos", "k", "n", "lat", "lon")


@query("place_map_scan", "", """SELECT CAST(r_regionkey AS BIGINT) AS region, n_nationkey AS k, n_name AS n, CAST((n_nationkey * 37) % 140 - 70 AS DOUBLE) AS lat
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def place_map_scan(m):
    """A gazetteer held as one JSON map per row, exploded to rows."""
    from claimcheck.sources.readers import gazetteer

    body = """'{"gaz":{"' || n_nationkey || '":{"n":"' || n_name || '","lat":' || ((n_nationkey * 37) % 140 - 70) || '}}}'"""
    docs = m.nation.selectExpr("CAST(n_regionkey AS BIGINT) AS doc", f"{body} AS body")
    return gazetteer(docs, "doc", "body").selectExpr("doc AS region", "CAST(k AS INT) AS k", "n", "lat")


@query("fk_orphans", "event", """SELECT 'event.place' AS fk, count(*) AS n FROM event WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 7 <> 3)
  UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def fk_orphans(m):
    known = m.nation.where("n_nationkey % 7 <> 3")
    a = st.orphans(m.event.select("k"), "k", known, "n_nationkey").agg(F.count("*").alias("n"))
    b = st.orphans(m.lineitem.select("l_partkey"), "l_partkey", m.part, "p_partkey").agg(F.count("*").alias("n"))
    return a.select(F.lit("event.place").alias("fk"), "n").unionByName(
        b.select(F.lit("lineitem.part").alias("fk"), "n")
    )


@query("key_parity", "", """SELECT o_custkey AS key, 'left only' AS side FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)
  UNION ALL SELECT c_custkey, 'right only' FROM customer WHERE c_nationkey <> 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def key_parity(m):
    """Keys present in one of two dictionaries only."""
    a = m.orders.select(F.col("o_custkey").alias("key")).distinct()
    b = m.customer.where("c_nationkey <> 3").select(F.col("c_custkey").alias("key"))
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("left only")).unionByName(
        b.join(a, "key", "left_anti").withColumn("side", F.lit("right only"))
    )


# ------------------------------------------------------------------ span and order rules
@query("event_vs_span", "person event", f"""WITH {SPAN}, {DATED},
  e AS (SELECT card, pos, t, coalesce(ddy, y) AS yr FROM dated WHERE NOT x)
  SELECT 'C5' AS "check", 'high' AS sev, e.card, 'pl[' || pos || ']' AS path,
    t || ' dated ' || yr || ', before the birth year ' || b AS msg FROM e JOIN span USING (card) WHERE yr < b
  UNION ALL SELECT 'C5', 'high', e.card, 'pl[' || pos || ']', t || ' dated ' || yr || ', after the death year ' || d_
  FROM e JOIN span USING (card) WHERE yr > d_ AND t <> 'burial'""")
def event_vs_span(m):
    return st.event_vs_span(m.person, m.event)


_EN_W = r"(may have|might have|is inferred|inferred|copied|no source)"


@query("pin_notes", "person event", f"""WITH {SPAN}, {DATED},
  e AS (SELECT dated.*, b, d_, years, coalesce(w, '') AS ww, coalesce(w_fr, '') AS wf,
    coalesce(w LIKE '%may have%' OR w LIKE '%inferred%' OR w LIKE '%no source%', false) AS he,
    coalesce(w_fr LIKE '%déduit%', false) AS hf, 'pl[' || pos || ']' AS p FROM dated JOIN span USING (card))
  SELECT 'C3' AS "check", 'high' AS sev, card, p AS path, c || CASE WHEN x THEN '/alt' ELSE '' END || ' pin has no bilingual note' AS msg FROM e WHERE (c <> 'doc' OR x) AND (ww = '' OR wf = '')
  UNION ALL SELECT 'C3', 'high', card, p || '.w', '[doc] pin whose own note hedges' FROM e WHERE c = 'doc' AND NOT x AND (he OR hf)
  UNION ALL SELECT 'C3', 'med', card, p || '.w', '[' || c || '] pin whose note asserts a document reading flatly' FROM e WHERE c <> 'doc' AND ww LIKE 'The register records%' AND NOT he
  UNION ALL SELECT 'C3', 'high', card, p, 'birth pin year ' || y || ' ≠ dates line ' || years FROM e WHERE t = 'birth' AND y <> b
  UNION ALL SELECT 'C3', 'high', card, p, 'death pin publishes ' || y || ' but the dates line carries no death year (' || years || ')' FROM e WHERE t = 'death' AND NOT x AND y IS NOT NULL AND d_ IS NULL
  UNION ALL SELECT 'C3', 'high', card, p, 'death pin year ' || y || ' ≠ dates line ' || years FROM e WHERE t = 'death' AND NOT x AND y <> d_
  UNION ALL SELECT 'C3', 'high', card, p, 'pin date ' || d || ' lies outside the pin''s own ' || CASE WHEN y2 IS NOT NULL THEN 'span ' || y || '–' || y2 ELSE 'year ' || y END FROM e WHERE ddy <> y AND NOT coalesce(ddy >= y AND ddy <= y2, false)
  UNION ALL SELECT 'C3', 'high', card, p, 'pin span reversed ' || y || '–' || y2 FROM e WHERE y2 < y
  UNION ALL SELECT 'C3', 'high', card, p, c || ' span ' || y || '–' || y2 || ' while its own note says the later years are unsourced' FROM e WHERE y2 - y > 15 AND ww LIKE '%no source%'
  UNION ALL SELECT 'C3', 'med', card, p, t || ' pin dated ' || y || ', after the death year ' || d_ FROM e WHERE t NOT IN ('burial', 'death') AND y > d_""")
def pin_notes(m):
    return st.pin_notes(m.person, m.event)


@query("event_order", "event", f"""WITH {DATED},
  e AS (SELECT card, pos, t, d, {ORD} AS rk, {jdn_sql('ddy', 'ddm', 'ddd')} AS j FROM dated WHERE NOT x AND ddy IS NOT NULL AND {ORD} IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY card, t ORDER BY j DESC, pos DESC) AS late, row_number() OVER (PARTITION BY card, t ORDER BY j, pos) AS early FROM e)
  SELECT 'C5' AS "check", 'high' AS sev, a.card, 'pl[' || a.pos || '] vs pl[' || b.pos || ']' AS path,
    a.t || ' (' || a.d || ') falls after ' || b.t || ' (' || b.d || ')' AS msg
  FROM f a JOIN f b ON a.card = b.card AND a.rk < b.rk AND a.j > b.j AND (a.late = 1 OR b.early = 1)""")
def event_order(m):
    return st.event_order(m.event)


@query("gap_days", "event", f"""WITH {DATED},
  e AS (SELECT card, pos, t, d, {jdn_sql('ddy', 'ddm', 'ddd')} AS j, row_number() OVER (PARTITION BY card, t ORDER BY pos) AS rn FROM dated WHERE ddy IS NOT NULL),
  g AS (SELECT a.card, b.pos, a.d AS ad, b.d AS bd, b.j - a.j AS gap, a.t AS kind FROM e a JOIN e b ON a.card = b.card AND a.rn = 1 AND b.rn = 1
    AND ((a.t = 'birth' AND b.t = 'baptism') OR (a.t = 'death' AND b.t = 'burial')))
  SELECT 'C5' AS "check", CASE WHEN gap < 0 THEN 'high' ELSE 'med' END AS sev, card, 'pl[' || pos || ']' AS path,
    CASE WHEN kind = 'birth' THEN 'baptised ' ELSE 'buried ' END || CASE WHEN gap < 0 THEN bd || ' — before the ' || kind || ' ' || ad ELSE gap || ' days after ' || kind || ' (' || ad || ' → ' || bd || ')' END AS msg
  FROM g WHERE gap < 0 OR gap > CASE WHEN kind = 'birth' THEN 120 ELSE 60 END""")
def gap_days(m):
    return st.gap_days(m.event)


@query("parent_child", "person union_", f"""WITH {SPAN},
  par AS (SELECT card AS pc, b AS pb, d_ AS pd FROM span),
  u AS (SELECT card AS uc, s, CAST(regexp_extract(sy, '^(\\d+)', 1) AS INT) AS sb, CAST(regexp_extract(sy, '(\\d+)$', 1) AS INT) AS sd FROM union_),
  e AS (SELECT p.parent_card AS card, 'unions[0].c[' || p.child_idx || ']' AS path, p.name || ' ' || p.years AS who, c.b AS cb, pb, pd, s, sb, sd
    FROM person p JOIN span c ON p.card = c.card JOIN par ON p.parent_card = pc LEFT JOIN u ON p.parent_card = uc)
  SELECT 'C5' AS "check", 'high' AS sev, card, path, 'child ' || who || ' is born ' || cb || ', not after the parent''s ' || pb AS msg FROM e WHERE cb <= pb
  UNION ALL SELECT 'C5', 'high', card, path, 'parent would be ' || (cb - pb) || ' at the birth of ' || who FROM e WHERE cb > pb AND cb - pb < 14
  UNION ALL SELECT 'C5', 'high', card, path, 'child ' || who || ' born ' || cb || ', ' || (cb - pd) || ' years after the parent''s death (' || pd || ')' FROM e WHERE cb > pd + 1
  UNION ALL SELECT 'C5', 'high', card, path, s || ' would be ' || (cb - sb) || ' at the birth of ' || who FROM e WHERE cb - sb < 14
  UNION ALL SELECT 'C5', 'med', card, path, s || ' would be ' || (cb - sb) || ' at the birth of ' || who FROM e WHERE cb - sb > 50
  UNION ALL SELECT 'C5', 'high', card, path, s || ' died ' || sd || ', before the birth of ' || who || ' (' || cb || ')' FROM e WHERE cb > sd""")
def parent_child(m):
    return st.parent_child(m.person, m.union_)


@query("reversed_years", "person", f"""WITH {SPAN} SELECT 'C4' AS "check", 'high' AS sev, card, 'years' AS path, 'dates line reversed: ' || years AS msg FROM span WHERE d_ < b""")
def reversed_years(m):
    return st.reversed_years(m.person)


@query("claim_index", "person event", """SELECT card AS person, 'years' AS fact, years AS value, CAST(NULL AS BIGINT) AS place, NULL AS cert, 'years' AS "where" FROM person
  UNION ALL SELECT card, t, coalesce(d, CAST(y AS VARCHAR), ''), k, c, 'pl[' || pos || ']' FROM event""")
def claim_index(m):
    return st.claim_index(m.person, m.event)


# ------------------------------------------------------------------ trails
@query("trail_order", "event", """WITH t AS (SELECT card, pos, t, y, lag(y) OVER (PARTITION BY card ORDER BY pos) AS prev_y FROM event)
  SELECT card, pos, t, y, prev_y FROM t WHERE y < prev_y""")
def trail_order(m):
    return st.trail_order(m.event)


@query("after_death", "event", """WITH d AS (SELECT card, min(pos) AS death_pos FROM event WHERE t = 'death' GROUP BY card)
  SELECT e.card, pos, t, k, death_pos FROM event e JOIN d ON e.card = d.card WHERE pos > death_pos AND NOT x AND t NOT IN ('death', 'burial')""")
def after_death(m):
    return st.after_death(m.event)


@query("home_event", "event", """WITH r AS (SELECT *, CASE WHEN x THEN 3 WHEN t = 'birth' THEN 0 WHEN t = 'baptism' THEN 1 ELSE 2 END AS rank FROM event),
  o AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY rank, pos) AS rn FROM r) SELECT card, rank, pos, t, k FROM o WHERE rn = 1""")
def home_event(m):
    return st.home_event(m.event)


@query("sole_event", "event", """SELECT card, t, min(pos) AS pos FROM event WHERE NOT x AND t IN ('birth', 'baptism', 'death', 'burial') GROUP BY card, t HAVING count(*) = 1""")
def sole_event(m):
    return st.sole_event(m.event)


@query("family_counts", "person", """WITH k AS (SELECT parent_card AS pc, count(*) AS n, count(*) FILTER (g = 'f') AS f FROM person WHERE parent_card IS NOT NULL GROUP BY parent_card)
  SELECT p.card, coalesce(a.n, 0) AS children, coalesce(a.n - a.f, 0) AS sons, coalesce(a.f, 0) AS daughters,
    coalesce(s.n - s.f, 0) AS brothers_all, coalesce(s.n - s.f, 0) - CASE WHEN s.n IS NOT NULL AND p.g <> 'f' THEN 1 ELSE 0 END AS brothers,
    coalesce(s.f, 0) AS sisters_all, coalesce(s.f, 0) - CASE WHEN s.n IS NOT NULL AND p.g = 'f' THEN 1 ELSE 0 END AS sisters
  FROM person p LEFT JOIN k a ON p.card = a.pc LEFT JOIN k s ON p.parent_card = s.pc""")
def family_counts(m):
    return st.family_counts(m.person).drop("per_union")
