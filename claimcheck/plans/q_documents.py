"""Queries over nested documents, and over the rules of portraits and the sync date."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.operators import constraints as co
from claimcheck.plans.registry import query
from claimcheck.sources import readers as rd


@query("label_walk", "", r"""WITH o AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)
  SELECT c_custkey AS doc, '$.l' AS path, 'Email to "' || c_name || '", \ via é' || chr(10) || c_mktsegment AS label FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT c_custkey, '$.l.l', 'within' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, '$.b.src[0].l', '' FROM customer
  UNION ALL SELECT c_custkey, '$.b.src[0].u.deep[0][0].l', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, '$.b.orders[' || k || '].l', o_orderpriority FROM o JOIN customer ON o_custkey = c_custkey""")
def label_walk(m):
    """Labels of nested documents: at several depths, with escapes, below keys that hold objects, none where they are numbers."""
    orders = m.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("l")))).alias("os"))
    rows = m.customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    deep = F.struct(F.array(F.array(F.struct(F.col("c_mktsegment").alias("l")))).alias("deep"))
    body = F.struct(F.col("c_custkey").alias("l"), F.array(F.struct(F.lit("").alias("l"), deep.alias("u"))).alias("src"), F.col("os").alias("orders")).alias("b")
    label = F.concat(F.lit('Email to "'), "c_name", F.lit('", \\ via é\n'), "c_mktsegment")
    text = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.struct(F.lit("within").alias("l")).alias("l"), body))).otherwise(F.to_json(F.struct(label.alias("l"), body)))
    return rd.harvest_labels(rows.select(F.col("c_custkey").alias("doc"), text.alias("body")), "body", "doc")


_PORTRAIT = """SELECT c_custkey AS card, CASE WHEN c_custkey % 50 = 7 THEN 'Creator of this website' END AS note,
  CASE c_custkey % 5 WHEN 0 THEN 'img/' || c_custkey || '.jpg' WHEN 1 THEN '' WHEN 2 THEN 'data:image/webp;base64,AA' WHEN 3 THEN 'data:image/gif;base64,AA' END AS img,
  CASE WHEN c_custkey % 20 = 3 THEN 'you' WHEN c_custkey % 20 = 4 THEN 'living' END AS tag FROM customer"""
_SITE = "SELECT CASE o_orderkey % 4 WHEN 0 THEN '3 May 1820' WHEN 1 THEN NULL ELSE substr(CAST(o_orderdate AS {text}), 1, 10) END AS synced FROM orders"


@query("portrait_rules", "", f"""WITH p AS ({_PORTRAIT}), s AS ({_SITE.format(text='VARCHAR')}),
  r AS (SELECT count(*) AS n, count(*) FILTER (contains(lower(coalesce(note, '')), 'creator of this website')) AS credits,
      count(*) FILTER (contains(lower(coalesce(note, '')), 'creator of this website') AND NOT coalesce(regexp_matches(img, '^data:image/(jpeg|png|webp);base64,'), false)) AS bare,
      count(*) FILTER (coalesce(img, '') <> '' AND img NOT LIKE 'data:image/%') AS linked, count(*) FILTER (tag = 'you') AS tagged FROM p)
  SELECT 'the maker of the site is credited' AS name, 'portrait' AS scope, greatest(1 - credits, 0) AS violations, n AS total FROM r
  UNION ALL SELECT 'portrait of the maker is embedded', 'portrait', bare, n FROM r
  UNION ALL SELECT 'portraits are embedded', 'portrait', linked, n FROM r
  UNION ALL SELECT 'no card has the tag you', 'portrait', tagged, n FROM r
  UNION ALL SELECT 'sync date is written year-month-day', 'site', count(*) FILTER (NOT coalesce(regexp_full_match(synced, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), false)), count(*) FROM s""")
def portrait_rules(m):
    """Rules on portraits, the forbidden tag and the sync date."""
    portrait = m.customer.sparkSession.sql(_PORTRAIT.replace("FROM customer", "FROM {customer}"), customer=m.customer)
    site = m.orders.sparkSession.sql(_SITE.format(text="STRING").replace("FROM orders", "FROM {orders}"), orders=m.orders)
    return co.check_constraints({"portrait": portrait, "site": site}, co.portrait_rules())
