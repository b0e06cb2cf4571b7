"""Queries over the source archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.functions import text as tx
from claimcheck.operators import archive as ac
from claimcheck.plans.registry import query
from claimcheck.plans.sql_text import q


def _first(c, rules, default):
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {q(p)}, 'i') THEN '{v}'" for p, v in rules) + f" ELSE '{default}' END"


RISK, KIND = _first("url", lx.URL_RISK, "medium"), _first("url", lx.URL_KIND, "page")
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"
CATALOG = f"""uses AS (SELECT url, label, card, CASE WHEN origin = 'links' THEN 'profile.links' ELSE origin END AS wh, pos FROM source WHERE regexp_matches(lower(url), '^https?://')
    UNION ALL SELECT u, cap, card, 'docs', pos FROM doc WHERE u IS NOT NULL),
  cat AS (SELECT substr(sha1(url), 1, 12) AS id, url, {HOST} AS host, {RISK} AS risk, {KIND} AS kind, arg_min(left(label, 180), (card, wh, pos)) AS label, count(DISTINCT card) AS dependents,
    array_to_string(list_sort(list(DISTINCT wh)), ',') AS "where" FROM uses GROUP BY url)"""
NEEDS = "source doc"


def _catalog(m):
    return ac.url_catalog(ac.url_uses(m.source, m.doc))


@query("url_catalog", NEEDS, f'WITH {CATALOG} SELECT id, url, host, risk, kind, label, dependents, "where" FROM cat')
def url_catalog(m):
    return _catalog(m)


@query("url_risk", NEEDS, f"WITH {CATALOG} SELECT 'risk' AS facet, risk AS value, count(*) AS urls, count(DISTINCT host) AS hosts FROM cat GROUP BY risk UNION ALL SELECT 'kind', kind, count(*), count(DISTINCT host) FROM cat GROUP BY kind UNION ALL SELECT 'all', 'all', count(*), count(DISTINCT host) FROM cat")
def url_risk(m):
    return ac.catalog_counts(_catalog(m))


@query("catalog_topk", NEEDS, f"WITH {CATALOG} SELECT url, risk, kind, dependents FROM cat ORDER BY CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, dependents DESC, host, url LIMIT 10")
def catalog_topk(m):
    return ac.catalog_order(_catalog(m), 10).select("url", "risk", "kind", "dependents")


@query("catalog_deid", NEEDS, f"WITH {CATALOG} SELECT risk, dependents, kind, url FROM cat")
def catalog_deid(m):
    return ac.deidentified(_catalog(m))


_MURL = """CASE o_orderkey % 5 WHEN 0 THEN 'https://www.familysearch.org/ark:/61903/3q9m' || o_orderkey WHEN 1 THEN 'https://www.findagrave.com/memorial/' || (o_orderkey * 7) || '/x'
  WHEN 2 THEN 'http://t.example.org/v?n=Dunmarch&p=Anna%20Fiora+' || o_orderkey WHEN 3 THEN 'http://news.example.org/18' || (100000 + o_orderkey % 800000) || '-p1' ELSE 'http://plain.example.org/' || o_orderkey END"""


@query("url_markers", "", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '3q9m' || o_orderkey WHEN 1 THEN CASE WHEN length(CAST(o_orderkey * 7 AS VARCHAR)) >= 4 THEN CAST(o_orderkey * 7 AS VARCHAR) ELSE '' END
  WHEN 2 THEN 'Anna Fiora ' || o_orderkey || ' | Dunmarch' WHEN 3 THEN '18' || (100000 + o_orderkey % 800000) ELSE '' END AS markers FROM orders""")
def url_markers(m):
    t = m.orders.selectExpr("o_orderkey", f"{_MURL} AS url")
    return t.select("o_orderkey", F.array_join(ac.url_markers(F.col("url")), " | ").alias("markers"))


TEXT = "regexp_replace(regexp_replace({c}, '<script[\\s\\S]*?</script>', ' ', 'gi'), '<[^>]+>', ' ', 'g')"


@query("html_text", "", f"SELECT page_id, {TEXT.format(c='html')} AS text FROM pages")
def html_text(m):
    return m.pages.select("page_id", tx.html_text(F.col("html")).alias("text"))


_STEMS = "SELECT DISTINCT left(w, 6) AS stem FROM (SELECT lower(regexp_replace(strip_accents(unnest(string_split_regex(name, '\\s+'))), '[^A-Za-z]', '', 'g')) AS w FROM life) z WHERE length(w) >= 5"
_WALL = "CASE " + " ".join(f"WHEN regexp_matches(body, {q(p)}, 'i') THEN {q(v)}" for p, v, _ in lx.WALLS) + " END"
_VIEW = "CASE " + " ".join(f"WHEN regexp_matches(body, {q(p)}) THEN {q(v)}" for p, v, _ in lx.VIEWERS) + " END"
_WS = "' ' || chr(9) || chr(10) || chr(13)"
PAGECAT = f"pc AS (SELECT substr(sha1(url), 1, 12) AS id, url, {RISK} AS risk, {KIND} AS kind, {HOST} AS host, page_id % 37 AS dependents FROM pages)"
VERDICT = f"""{PAGECAT}, stems AS ({_STEMS}), rxs AS (SELECT string_agg(stem, '|') AS r FROM stems),
  j AS (SELECT pc.id, pc.url, pc.risk, pc.dependents, c.ok, c.file, c.body, c.transcription AS tr, c.result, {TEXT.format(c='c.body')} AS txt,
    trim(array_to_string(list_filter(string_split(c.transcription, chr(10)), lambda v: NOT starts_with(v, '#')), chr(10)), {_WS}) AS hb FROM pc LEFT JOIN capture c ON pc.id = c.id),
  k AS (SELECT j.*, coalesce(regexp_matches(lower(txt), r), false) AS nb, coalesce(regexp_matches(lower(hb), r), false) AS nh, {_WALL} AS wall, {_VIEW} AS vw, nullif(regexp_extract(tr, '# url: (\\S+)', 1), '') AS decl FROM j, rxs),
  s AS (SELECT *, CASE WHEN body IS NULL THEN NULL WHEN trim(body, {_WS}) = '' THEN 'stored file is empty (0 bytes)' WHEN nb THEN NULL WHEN wall IS NOT NULL THEN wall WHEN vw IS NOT NULL THEN vw || ', no record text' ELSE 'no marker for this record anywhere in the stored bytes' END AS sh FROM k),
  v AS (SELECT id, url, risk, dependents,
    CASE WHEN ok AND body IS NULL THEN 'UNREAD-HERE' WHEN ok AND sh IS NULL THEN 'RECORD' WHEN ok AND tr IS NOT NULL THEN 'TRANSCRIPT' WHEN ok THEN 'SHELL' WHEN tr IS NOT NULL AND decl <> url THEN 'MISMATCH' WHEN tr IS NOT NULL AND length(hb) < 120 THEN 'SHELL' WHEN tr IS NOT NULL THEN 'TRANSCRIPT' ELSE 'NONE' END AS verdict,
    CASE WHEN ok AND body IS NULL THEN 'stored copy not in this checkout: ' || file WHEN ok AND sh IS NULL THEN 'a cited surname is in the stored text' WHEN ok AND tr IS NOT NULL THEN 'auto-capture is a ' || sh || '; a hand transcription stands in its place' WHEN ok THEN sh
      WHEN tr IS NOT NULL AND decl <> url THEN 'the transcription is of a different URL: ' || decl WHEN tr IS NOT NULL AND length(hb) < 120 THEN 'transcription has almost no content (' || length(hb) || ' chars)'
      WHEN tr IS NOT NULL THEN CASE WHEN nh THEN 'hand transcription, a cited surname present' ELSE 'hand transcription, no surname — check it is a record page and not a search form' END ELSE 'never captured (' || result || ')' END AS why FROM s)"""


def _pagecat(m):
    url = F.col("url")
    return m.pages.select(
        ac.url_id(url).alias("id"), "url", ac.url_risk(url).alias("risk"), ac.url_kind(url).alias("kind"), ac.host_of(url).alias("host"),
        (F.col("page_id") % 37).alias("dependents"),
    )


def _verdicts(m):
    return ac.verdicts(_pagecat(m), m.capture, ac.name_stems(m.life))


@query("archive_verdict", "capture life", f"WITH {VERDICT} SELECT id, url, risk, dependents, verdict, why FROM v")
def archive_verdict(m):
    return _verdicts(m)


@query("verdict_counts", "capture life", f"""WITH {VERDICT}, pcards AS (SELECT substr(sha1(url), 1, 12) AS id, page_id % 91 AS card FROM pages)
  SELECT verdict, count(DISTINCT v.id) AS entries, count(DISTINCT card) AS cards FROM v LEFT JOIN pcards p ON p.id = v.id GROUP BY verdict""")
def verdict_counts(m):
    cards = m.pages.select(ac.url_id(F.col("url")).alias("id"), (F.col("page_id") % 91).alias("card"))
    return ac.verdict_counts(_verdicts(m), cards)


@query("verdict_failures", "capture life", f"WITH {VERDICT} SELECT url, dependents, verdict, why FROM v WHERE verdict IN ('SHELL', 'MISMATCH', 'NONE')")
def verdict_failures(m):
    return ac.failed_first(_verdicts(m)).select("url", "dependents", "verdict", "why")


AS_OF = "2026-01-01"
STATUS = f"""{PAGECAT}, st AS (SELECT pc.id, pc.url, pc.risk, pc.dependents, c.result, coalesce(c.ok, false) AS auto, c.transcription IS NOT NULL AND NOT coalesce(c.ok, false) AS hand_only,
    coalesce(c.ok, false) OR c.transcription IS NOT NULL AS held, coalesce(c.ok, false) AND age_days > 180 AS stale FROM pc LEFT JOIN capture c ON pc.id = c.id)"""


def _status(m):
    cap = m.capture.withColumn("fetched", F.expr(f"date_sub(DATE'{AS_OF}', age_days)").cast("timestamp"))
    return ac.held_status(_pagecat(m), cap, AS_OF)


@query("archive_coverage", "capture", f"""WITH {STATUS}, a AS (SELECT 'all' AS risk, * EXCLUDE (risk) FROM st UNION ALL SELECT risk, * EXCLUDE (risk) FROM st)
  SELECT risk, count(*) AS total, count(*) FILTER (held) AS held, count(*) FILTER (auto) AS auto, count(*) FILTER (hand_only) AS hand_only, count(*) FILTER (stale) AS stale FROM a GROUP BY risk""")
def archive_coverage(m):
    return ac.coverage(_status(m))


@query("archive_gaps", "capture", f"WITH {STATUS} SELECT dependents, risk, coalesce(result, 'never tried') AS result, url, (SELECT count(*) FROM st WHERE NOT held) AS gaps FROM st WHERE NOT held ORDER BY dependents DESC, url LIMIT 15")
def archive_gaps(m):
    worst, total = ac.gaps(_status(m))
    return worst.select("*", total.select("n").scalar().alias("gaps"))


@query("orphaned_cards", "capture", f"""WITH {STATUS}, pcards AS (SELECT substr(sha1(url), 1, 12) AS id, page_id % 91 AS card FROM pages)
  SELECT card, bool_or(held) AS covered FROM pcards JOIN st USING (id) GROUP BY card""")
def orphaned_cards(m):
    cards = m.pages.select(ac.url_id(F.col("url")).alias("id"), (F.col("page_id") % 91).alias("card"))
    return ac.card_coverage(_status(m), cards)


@query("changed_captures", "capture", "SELECT id, url, result FROM capture WHERE result = 'CHANGED'")
def changed_captures(m):
    return ac.changed(m.capture).select("id", "url", "result")
