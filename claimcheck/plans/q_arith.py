"""Queries that compute: calendars, intervals, ages, distances, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.functions import dates as dt
from claimcheck.functions import geo
from claimcheck.functions import lexicon as lx
from claimcheck.operators import arithmetic as ar
from claimcheck.operators import cards as cd
from claimcheck.operators import names as nm
from claimcheck.operators import structure as st
from claimcheck.plans import sql_text as sq
from claimcheck.plans.card_model import jdn_sql, pick
from claimcheck.plans.q_structure import DATED, SPAN
from claimcheck.plans.registry import query
from claimcheck.plans.sql_text import q

FN = sq.FIELD_NEEDS


def _m(c, p):
    return f"regexp_matches({c}, {q(p)}, 'i')"


# ------------------------------------------------------------------ calendars
@query("jdn_weekday", "", "SELECT o_orderkey, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS BIGINT) AS jdn, dayname(o_orderdate) AS weekday FROM orders")
def jdn_weekday(m):
    d = F.col("o_orderdate")
    j = dt.jdn(F.year(d), F.month(d), F.dayofmonth(d))
    return m.orders.select("o_orderkey", j.cast("bigint").alias("jdn"), dt.weekday(j).alias("weekday"))


_YMD = "CAST(1500 + o_orderkey % 400 AS INT) AS y, CAST(1 + o_orderkey % 12 AS INT) AS m, CAST(1 + o_orderkey % 31 AS INT) AS d"


@query("julian_weekday", "", f"""WITH t AS (SELECT o_orderkey, {_YMD} FROM orders), j AS (SELECT *, {jdn_sql('y', 'm', 'd')} AS g, {jdn_sql('y', 'm', 'd', True)} AS u FROM t)
  SELECT o_orderkey, CAST(g AS BIGINT) AS greg, CAST(u AS BIGINT) AS jul, {pick("(CASE WHEN y < 1682 OR (y = 1682 AND m <= 2) THEN u ELSE g END) % 7", lx.WEEKDAYS)} AS era_weekday FROM j""")
def julian_weekday(m):
    t = m.orders.selectExpr("o_orderkey", *_YMD.split(", "))
    y, mo, d = F.col("y"), F.col("m"), F.col("d")
    g, u = dt.jdn(y, mo, d), dt.jdn_julian(y, mo, d)
    era = dt.weekday(F.when(dt.in_julian_era(y, mo), u).otherwise(g))
    return t.select("o_orderkey", g.cast("bigint").alias("greg"), u.cast("bigint").alias("jul"), era.alias("era_weekday"))


@query("full_years", "", """SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) + 20 - year(o_orderdate) - CASE WHEN month(l_shipdate) * 100 + day(l_shipdate) < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END AS INT) AS years
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def full_years(m):
    df = m.lineitem.join(m.orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def ymd(c, plus=0):
        return F.struct((F.year(c) + plus).alias("y"), F.month(c).alias("m"), F.dayofmonth(c).alias("d"))

    return df.select("l_orderkey", "l_linenumber", dt.full_years(ymd("o_orderdate"), ymd("l_shipdate", 20)).alias("years"))


@query("lifespan_parse", "person", f"WITH {SPAN} SELECT card, b, d_ AS d, starts_with(years, 'c.') AS approx FROM span")
def lifespan_parse(m):
    return m.person.select("card", dt.life_span(F.col("years")).alias("s")).select("card", "s.b", "s.d", "s.approx")


_HAV = "2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query("haversine_km", "event place life", f"""SELECT e.card, e.pos, CAST(round({_HAV}) AS BIGINT) AS km FROM event e JOIN life l ON e.card = l.card JOIN place a ON e.k = a.k JOIN place b ON b.k = l.k % 25""")
def haversine_km(m):
    """Distance from every event to its card's home."""
    home = m.place.select(F.col("k").alias("hk"), F.col("lat").alias("hlat"), F.col("lon").alias("hlon"))
    df = st.place_join(m.event, m.place).withColumn("hk", (F.col("card") % 25).cast("int"))
    df = df.join(st.small_side_of(home), "hk")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon"))
    return df.select("card", "pos", F.round(km).cast("bigint").alias("km"))


# ------------------------------------------------------------------ prose against arithmetic
_WD = "|".join(lx.WEEKDAYS)
_MN = "|".join(lx.MONTHS_EN)
_MCASE = "CASE mon " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(lx.MONTHS_EN)) + " END"


@query("weekday_claims", FN, f"""WITH {sq.FIELD}, {sq.UNIT},
  w0 AS (SELECT card, path, unnest(regexp_extract_all(sentence, '(?:{_WD}) \\d{{1,2}} (?:{_MN}) \\d{{4}}')) AS hit FROM unit WHERE lang = 'en' AND kind IN ('bio', 'mapnote', 'tooltip', 'union', 'pin', 'doctr', 'srcquote', 'doccap')),
  w1 AS (SELECT card, path, split_part(hit, ' ', 1) AS said, CAST(split_part(hit, ' ', 2) AS INT) AS d, split_part(hit, ' ', 3) AS mon, CAST(split_part(hit, ' ', 4) AS INT) AS y, substring(hit, instr(hit, ' ') + 1) AS raw FROM w0),
  w2 AS (SELECT *, {_MCASE} AS m FROM w1),
  w3 AS (SELECT *, y < 1682 OR (y = 1682 AND m <= 2) AS jul, {jdn_sql('y', 'm', 'd')} AS g, {jdn_sql('y', 'm', 'd', True)} AS u FROM w2),
  w AS (SELECT *, {pick('g % 7', lx.WEEKDAYS)} AS greg, {pick('(CASE WHEN jul THEN u ELSE g END) % 7', lx.WEEKDAYS)} AS era FROM w3)
  SELECT 'C4' AS "check", CASE WHEN greg <> said THEN 'high' ELSE 'med' END AS sev, card, path, '"' || said || ' ' || raw || '" — ' || CASE WHEN greg <> said THEN 'Julian ' || era || ', Gregorian ' || greg WHEN jul THEN 'era is Julian; Julian weekday is ' || era ELSE 'weekday is ' || era END AS msg FROM w WHERE era <> said""")
def weekday_claims(m):
    return ar.weekday_claims(cd.units(cd.fields(m, ar.DATED_KINDS)))


_ITEXT = """'The stay lasted ' || CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 400 AS VARCHAR(9)) || ' days' WHEN 1 THEN CAST(o_orderkey % 60 AS VARCHAR(9)) || ' weeks' WHEN 2 THEN CAST(o_orderkey % 14 AS VARCHAR(9)) || ' months' ELSE CAST(o_orderkey % 3 AS VARCHAR(9)) || ' years' END
  || ', from ' || CAST(1 + o_orderkey % 28 AS VARCHAR(9)) || ' ' || {mon} || ' ' || CAST(1600 + o_orderkey % 200 AS VARCHAR(9)) || ' to ' || CAST(1 + o_custkey % 28 AS VARCHAR(9)) || ' ' || {mon2} || ' ' || CAST(1600 + o_orderkey % 200 + o_custkey % 3 AS VARCHAR(9)) || CASE WHEN o_orderkey % 5 = 0 THEN ', before the move.' ELSE '.' END""".format(
    mon=pick("o_orderkey % 12", lx.MONTHS_EN), mon2=pick("o_custkey % 12", lx.MONTHS_EN)
)
_ITEXT_ROWS = "SELECT o_orderkey AS card, 'bio[0]' AS path, 'en' AS lang, CASE WHEN o_orderkey % 8 = 1 THEN 'doctr' ELSE 'bio' END AS kind, {t} AS sentence FROM {o}"


@query("interval_claims", "", f"""WITH t AS (SELECT o_orderkey AS card, o_orderkey % 8 = 1 AS quoted, o_orderkey % 5 = 0 AS open,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 400 WHEN 1 THEN o_orderkey % 60 WHEN 2 THEN o_orderkey % 14 ELSE o_orderkey % 3 END AS n, o_orderkey % 4 AS un,
    1 + o_orderkey % 28 AS d1, 1 + o_orderkey % 12 AS m1, 1600 + o_orderkey % 200 AS y1, 1 + o_custkey % 28 AS d2, 1 + o_custkey % 12 AS m2, 1600 + o_orderkey % 200 + o_custkey % 3 AS y2 FROM orders),
  v AS (SELECT *, CASE WHEN y1 < 1682 OR (y1 = 1682 AND m1 <= 2) THEN {jdn_sql('y2', 'm2', 'd2', True)} - {jdn_sql('y1', 'm1', 'd1', True)} ELSE {jdn_sql('y2', 'm2', 'd2')} - {jdn_sql('y1', 'm1', 'd1')} END AS days FROM t),
  x AS (SELECT *, CASE un WHEN 0 THEN days WHEN 1 THEN days / 7.0 WHEN 2 THEN (y2 - y1) * 12 + m2 - m1 ELSE y2 - y1 - CASE WHEN m2 < m1 OR (m2 = m1 AND d2 < d1) THEN 1 ELSE 0 END END AS val,
    d1 || ' ' || {pick('m1 - 1', lx.MONTHS_EN)} || ' ' || y1 AS a, d2 || ' ' || {pick('m2 - 1', lx.MONTHS_EN)} || ' ' || y2 AS b FROM v)
  SELECT 'C4' AS "check", CASE WHEN quoted OR open THEN 'review' ELSE 'med' END AS sev, card, 'bio[0]' AS path,
    '"' || n || ' ' || CASE un WHEN 0 THEN 'days' WHEN 1 THEN 'weeks' WHEN 2 THEN 'months' ELSE 'years' END || '" matches no date pair in the sentence' || CASE WHEN open THEN ' (the other term is off-card — verify)' ELSE '' END || '; ' || a || '→' || b || '=' || CAST(round(val) AS BIGINT) || CASE un WHEN 0 THEN 'd' WHEN 1 THEN 'w' WHEN 2 THEN 'm' ELSE 'y' END AS msg
  FROM x WHERE NOT (abs(val - n) < CASE WHEN un = 0 THEN 1.01 ELSE 0.51 END) AND NOT (un = 3 AND abs(abs(y2 - y1) - n) <= 1)""")
def interval_claims(m):
    return ar.interval_claims(m.spark.sql(_ITEXT_ROWS.format(t=_ITEXT, o="{o}"), o=m.orders))


# ------------------------------------------------------------------ ages
_ATEXT = f"""CASE o_orderkey % 6
  WHEN 0 THEN 'He died at ' || (1 + o_orderkey % 109) || ' in the town.' WHEN 1 THEN {pick('o_orderkey % 10', ['Alba', 'Bruno', 'Celia', 'Dario', 'Elena', 'Fabio', 'Greta', 'Hugo', 'Irma', 'Jonas'])} || ' Ardent, aged thirty-' || {pick('o_orderkey % 3', ['two', 'five', 'eight'])} || ', kept the shop.'
  WHEN 2 THEN 'The household of nine held fifty acres, then ' || (o_orderkey % 50) || ' acres.' WHEN 3 THEN 'A weaver of ' || (20 + o_orderkey % 40) || ' came, and "she was then ' || (10 + o_orderkey % 20) || '" he wrote.'
  WHEN 4 THEN 'At the age of ' || (o_orderkey % 120) || ' Maria left.' ELSE 'Nothing is said.' END"""
_AROWS = "SELECT o_orderkey AS card, {t} AS sentence FROM {o}"


@query("age_claims", "", f"""
  SELECT o_orderkey AS card, CAST(1 + o_orderkey % 109 AS INT) AS n, 3 AS pos, 'verb at' AS cue, false AS quoted, 'died at ' || (1 + o_orderkey % 109) AS raw FROM orders WHERE o_orderkey % 6 = 0
  UNION ALL SELECT o_orderkey, CAST({pick('o_orderkey % 3', [32, 35, 38])} AS INT), length({pick('o_orderkey % 10', ['Alba', 'Bruno', 'Celia', 'Dario', 'Elena', 'Fabio', 'Greta', 'Hugo', 'Irma', 'Jonas'])}) + 9, 'aged', false, 'aged thirty-' || {pick('o_orderkey % 3', ['two', 'five', 'eight'])} FROM orders WHERE o_orderkey % 6 = 1
  UNION ALL SELECT o_orderkey, CAST(20 + o_orderkey % 40 AS INT), 0, 'trade of N', true, 'A weaver of ' || (20 + o_orderkey % 40) FROM orders WHERE o_orderkey % 6 = 3
  UNION ALL SELECT o_orderkey, CAST(10 + o_orderkey % 20 AS INT), 34, 'then', true, 'then ' || (10 + o_orderkey % 20) FROM orders WHERE o_orderkey % 6 = 3
  UNION ALL SELECT o_orderkey, CAST(o_orderkey % 120 AS INT), 7, 'aged', false, 'age of ' || (o_orderkey % 120) FROM orders WHERE o_orderkey % 6 = 4 AND o_orderkey % 120 BETWEEN 1 AND 110""")
def age_claims(m):
    t = m.spark.sql(_AROWS.format(t=_ATEXT, o="{o}"), o=m.orders)
    return t.select("card", F.explode(ar.age_claims(F.col("sentence"))).alias("c")).select("card", "c.n", "c.pos", "c.cue", "c.quoted", "c.raw")


@query("nearest_name", "", f"""SELECT o_orderkey AS card, CASE WHEN o_orderkey % 6 = 1 THEN {pick('o_orderkey % 10', ['Alba', 'Bruno', 'Celia', 'Dario', 'Elena', 'Fabio', 'Greta', 'Hugo', 'Irma', 'Jonas'])} || ' Ardent' WHEN o_orderkey % 6 = 4 THEN 'Maria' WHEN o_orderkey % 6 = 5 THEN 'Nothing' END AS name FROM orders""")
def nearest_name(m):
    """Last capitalised run of the sentence."""
    t = m.spark.sql(_AROWS.format(t=_ATEXT, o="{o}"), o=m.orders)
    runs = ar.name_runs(F.col("sentence"))
    return t.select("card", runs.alias("r")).select("card", F.when(F.size("r") > 0, F.element_at("r", -1)["raw"]).alias("name"))


_KEYS_P = "[lower(name), lower(given || ' ' || middle), lower(given || ' ' || middle), lower(given)]"


@query("age_check", "prose union_ event doc", f"""WITH {DATED},
  person AS (SELECT card, years, parent_card FROM prose), {SPAN},
  fb AS (SELECT card, ddy, ddm, ddd, t, row_number() OVER (PARTITION BY card, t ORDER BY pos) AS rn FROM dated WHERE d IS NOT NULL AND t IN ('birth', 'death')),
  vit AS (SELECT p.card, p.parent_card, p.name, p.given, p.middle, coalesce(x.ddy, s.b) AS by_, x.ddm AS bm, x.ddd AS bd, coalesce(z.ddy, s.d_) AS dy_, z.ddm AS dm, z.ddd AS dd
    FROM prose p JOIN span s ON p.card = s.card LEFT JOIN fb x ON x.card = p.card AND x.t = 'birth' AND x.rn = 1 LEFT JOIN fb z ON z.card = p.card AND z.t = 'death' AND z.rn = 1),
  par AS (SELECT s AS name, CAST(left(sy, 4) AS INT) AS by_, CAST(right(sy, 4) AS INT) AS dy_ FROM union_),
  idx AS (SELECT unnest({_KEYS_P}) AS key, by_, bm, bd, dy_, dm, dd FROM vit
    UNION ALL SELECT unnest([lower(name), lower(split_part(name, ' ', 1)), lower(split_part(name, ' ', 1))]), by_, NULL, NULL, dy_, NULL, NULL FROM par),
  idk AS (SELECT * FROM idx WHERE length(key) >= 4),
  cl AS (
    SELECT card, 'bio[2]' AS path, 'died at ' || v AS raw, v AS n, [d] AS ys, true AS deadly, 'self' AS md, NULL AS nm, false AS soft, NULL AS em, NULL AS ed FROM (SELECT *, CASE WHEN k % 21 = 11 THEN d - b + 9 ELSE d - b END AS v FROM prose) WHERE v BETWEEN 1 AND 110
    UNION ALL SELECT card, 'bio[2]', 'then ' || v, v, [true_b + 20], false, 'father', NULL, false, NULL, NULL FROM (SELECT *, true_b + 20 - parent_b + CASE WHEN k % 14 = 3 THEN 6 ELSE 0 END AS v FROM prose WHERE k > 0 AND k % 7 = 3) WHERE v BETWEEN 1 AND 110
    UNION ALL SELECT card, 'bio[2]', 'aged 30', 30, [b + 22], false, 'name', CASE WHEN k % 64 = 6 THEN {pick('(k + 3) % 10', ['Aldric', 'Blanca', 'Corin', 'Delphe', 'Esmon', 'Fiora', 'Gaspar', 'Helda', 'Ivo', 'Juno'])} ELSE {pick('(k + 3) % 10', ['Alba', 'Bruno', 'Celia', 'Dario', 'Elena', 'Fabio', 'Greta', 'Hugo', 'Irma', 'Jonas'])} END || ' ' || {pick('(k + 5) % 7', ['Ardent', 'Bellmont', 'Corvane', 'Dunmarch', 'Estrell', 'Fairlode', 'Gravenor'])}, false, NULL, NULL FROM prose WHERE k % 32 = 6
    UNION ALL SELECT card, 'docs[0].tr', 'aged ' || (k % 90 + 1), k % 90 + 1, [b], false, 'self', NULL, true, mo, dy FROM prose WHERE k % 9 = 0),
  cn AS (SELECT cl.*, row_number() OVER () AS id, given, middle, surname FROM cl JOIN (SELECT card AS c2, given, middle, surname FROM prose) o ON cl.card = c2),
  cm AS (SELECT *, CASE WHEN md = 'name' AND list_contains([given, middle, surname], split_part(nm, ' ', 1)) AND list_contains([given, middle, surname], split_part(nm, ' ', 2)) THEN 'self' WHEN md = 'name' AND lower(nm) IN (SELECT key FROM idk) THEN 'exact' ELSE md END AS mode FROM cn),
  sub AS (
    SELECT cm.*, v.by_, v.bm, v.bd, v.dy_, v.dm, v.dd FROM cm JOIN vit v ON v.card = cm.card WHERE mode = 'self'
    UNION ALL SELECT cm.*, f.by_, f.bm, f.bd, f.dy_, f.dm, f.dd FROM cm JOIN vit v ON v.card = cm.card JOIN vit f ON f.card = v.parent_card WHERE mode = 'father'
    UNION ALL SELECT cm.*, i.by_, i.bm, i.bd, i.dy_, i.dm, i.dd FROM cm JOIN idk i ON i.key = lower(nm) WHERE mode = 'exact'
    UNION ALL SELECT cm.*, i.by_, i.bm, i.bd, i.dy_, i.dm, i.dd FROM cm JOIN idk i ON list_has_all(string_split(i.key, ' '), string_split(lower(nm), ' ')) WHERE mode = 'name'),
  ag AS (SELECT *, ys[1] - by_ - CASE WHEN coalesce(em, 7) < coalesce(bm, 7) OR (coalesce(em, 7) = coalesce(bm, 7) AND coalesce(ed, 1) < coalesce(bd, 1)) THEN 1 ELSE 0 END AS a1, bm IS NULL OR em IS NULL AS v1,
    dy_ - by_ - CASE WHEN coalesce(dm, 7) < coalesce(bm, 7) OR (coalesce(dm, 7) = coalesce(bm, 7) AND coalesce(dd, 1) < coalesce(bd, 1)) THEN 1 ELSE 0 END AS a2, bm IS NULL OR dm IS NULL AS v2 FROM sub),
  r AS (SELECT id, any_value(card) AS card, any_value(path) AS path, any_value(raw) AS raw, any_value(n) AS n, any_value(soft) AS soft, count(*) AS people,
    bool_or(abs(a1 - n) <= CASE WHEN v1 THEN 1 ELSE 0 END OR (deadly AND coalesce(abs(a2 - n) <= CASE WHEN v2 THEN 1 ELSE 0 END, false))) AS ok FROM ag GROUP BY id)
  SELECT 'C4' AS "check", CASE WHEN soft THEN 'review' WHEN people > 3 THEN 'med' ELSE 'high' END AS sev, card, path, 'age "' || raw || '" (=' || n || ') matches no subject/date pairing' AS msg FROM r WHERE NOT ok""")
def age_check(m):
    return ar.age_check(cd.fields(m, ar.DATED_KINDS), m.person, m.union_, m.event)


# ------------------------------------------------------------------ places
MENTION = """gz AS (SELECT k, n, split_part(n, ' (', 1) AS base FROM place)"""


@query("place_mentions", FN + " place", f"""WITH {sq.FIELD}, {sq.UNIT}, {MENTION}
  SELECT DISTINCT u.card, u.path, u.ord, g.k FROM (SELECT *, unnest(regexp_extract_all(lower(sentence), 'nation_[0-9]+')) AS hit FROM unit) u JOIN gz g ON hit = lower(base)""")
def place_mentions(m):
    return nm.place_mentions(cd.units(cd.fields(m)), m.place, ["card", "path", "ord"])


@query("distance_claims", FN + " place", f"""WITH {sq.FIELD}, {MENTION},
  cl AS (SELECT card, 'bio[1]' AS path, 5 + card % 400 AS km FROM person WHERE card % 25 = 3),
  sp AS (SELECT DISTINCT z.card, g.k, g.n, p.lat, p.lon FROM (SELECT card, unnest(regexp_extract_all(text, 'NATION_[0-9]+')) AS hit FROM f) z JOIN gz g ON g.base = hit JOIN place p ON p.k = g.k WHERE z.card IN (SELECT card FROM cl)
    UNION SELECT DISTINCT e.card, g.k, g.n, p.lat, p.lon FROM event e JOIN gz g ON e.k = g.k JOIN place p ON p.k = g.k WHERE e.card IN (SELECT card FROM cl)),
  pr AS (SELECT a.card, a.n || '→' || b.n AS s, {_HAV} AS d FROM sp a JOIN sp b ON a.card = b.card AND a.k < b.k),
  rk AS (SELECT cl.card, path, km, s, d, abs(d - km) AS gap, row_number() OVER (PARTITION BY cl.card ORDER BY abs(d - km), s) AS rn FROM cl JOIN pr ON pr.card = cl.card)
  SELECT 'C8' AS "check", 'high' AS sev, card, path, '"' || km || ' km" disagrees with the gazetteer; nearest ' || string_agg(s || '=' || CAST(round(d) AS BIGINT) || 'km', '; ' ORDER BY rn) AS msg
  FROM rk WHERE rn <= 5 GROUP BY card, path, km HAVING min(gap) > greatest(km * 0.3, 1.0)""")
def distance_claims(m):
    return ar.distance_claims(cd.fields(m), m.event, m.place)


_VERBS = " UNION ALL ".join(f"SELECT *, '{t}' AS t, instr(sentence, regexp_extract(sentence, {q(p)}, 0, 'i')) - 1 AS ea FROM hd WHERE {_m('sentence', p)}" for t, p in lx.EVENT_VERBS.items())


@query("pin_vs_prose", FN + " place", f"""WITH {sq.FIELD}, {sq.UNIT}, {MENTION},
  hd0 AS (SELECT card, path, ord, {sq.norm('sentence')} AS sentence FROM unit WHERE lang = 'en' AND kind IN ('bio', 'mapnote', 'tooltip', 'headline') AND {sq.hedged('sentence', 'en')}),
  hd AS (SELECT *, {sq.first_hedge('sentence', 'en')} AS hedge FROM hd0),
  ev AS (SELECT *, instr({sq.fold('sentence')}, lower(hedge)) - 1 AS ha FROM ({_VERBS}) z),
  ok AS (SELECT *, regexp_extract_all(sentence, 'NATION_[0-9]+') AS pl FROM ev WHERE ha < 0 OR (abs(ha - ea) <= 90 AND NOT regexp_matches(substring(sentence, least(ha, ea) + 1, abs(ha - ea)), '[;—:]'))),
  pins AS (SELECT e.card, e.t, e.k, e.pos, g.n, g.base FROM event e JOIN gz g ON e.k = g.k WHERE c = 'doc' AND NOT x AND NOT EXISTS (SELECT 1 FROM event z WHERE z.card = e.card AND z.t = e.t AND z.x)),
  one AS (SELECT card, t FROM event WHERE NOT x AND t IN ('birth', 'death', 'baptism', 'burial') GROUP BY card, t HAVING count(*) = 1)
  SELECT 'C3' AS "check", 'med' AS sev, p.card, 'pl[' || pos || '] ↔ ' || path AS path, '[doc] ' || p.t || ' pin at ' || n || ' while the prose about that event hedges ("' || hedge || '")' AS msg
  FROM ok JOIN pins p ON p.card = ok.card AND p.t = ok.t WHERE list_contains(pl, base) OR (len(pl) = 0 AND (p.card, p.t) IN (SELECT (card, t) FROM one))""")
def pin_vs_prose(m):
    return ar.pin_vs_prose(cd.fields(m, ["bio", "mapnote", "tooltip", "headline"]), m.event, m.place)


# ------------------------------------------------------------------ counts
_CW = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.NUMBER_WORDS.items()) + " ELSE TRY_CAST(w AS INT) END"
_CNT = f"""cc AS (SELECT card, path, unnest(regexp_extract_all(sentence, {q(lx.FAMILY_COUNT)})) AS raw FROM unit WHERE lang = 'en' AND kind IN ('bio', 'mapnote', 'tooltip', 'union')),
  cn AS (SELECT card, path, raw, w, {_CW} AS n FROM (SELECT *, split_part(raw, ' ', 1) AS w FROM cc) z),
  kd AS (SELECT p.card, count(c.card) AS kids FROM person p LEFT JOIN person c ON c.parent_card = p.card GROUP BY p.card)"""


@query("count_claims", FN, f"""WITH {sq.FIELD}, {sq.UNIT}, {_CNT}
  SELECT 'X13' AS "check", 'review' AS sev, cn.card, path, '"' || raw || '" — this card draws ' || kids || ' children' AS msg FROM cn JOIN kd ON kd.card = cn.card WHERE n <> kids""")
def count_claims(m):
    f = cd.fields(m, ["bio", "mapnote", "tooltip", "union"])
    return ar.count_mismatch(ar.count_claims(f, m.person))


@query("count_contradiction", FN, f"""WITH {sq.FIELD}, {sq.UNIT}, {_CNT}, d AS (SELECT card, list_sort(list(DISTINCT n)) AS v, min(path) AS path FROM cn GROUP BY card)
  SELECT 'X13b' AS "check", 'review' AS sev, card, path, 'this card asserts ' || array_to_string(v, ' and ') || ' children' AS msg FROM d WHERE len(v) > 1""")
def count_contradiction(m):
    f = cd.fields(m, ["bio", "mapnote", "tooltip", "union"])
    return ar.count_contradiction(ar.count_claims(f, m.person))


_OFTEXT = """'The four children of ' || name || ' are known.'"""


@query("subject_reattribution", "prose", """WITH f AS (SELECT lower(name) AS key, min(card) AS card FROM prose GROUP BY lower(name))
  SELECT DISTINCT p.name AS of, f.card AS target FROM prose p JOIN f ON f.key = lower(p.name)
  UNION SELECT DISTINCT p.middle || ' ' || p.surname, (SELECT min(card) FROM prose z WHERE contains(lower(z.name), lower(p.middle || ' ' || p.surname))) FROM prose p""")
def subject_reattribution(m):
    p = m.prose
    q_ = p.select(F.col("name").alias("of")).unionByName(p.select(F.concat_ws(" ", "middle", "surname").alias("of")))
    return ar.reattribute(q_, m.person)


@query("name_resolve", "life union_", f"""WITH i AS (SELECT unnest({_KEYS_P}) AS key FROM life UNION ALL SELECT unnest([lower(s), lower(split_part(s, ' ', 1)), lower(split_part(s, ' ', 1))]) FROM union_),
  idx AS (SELECT key, count(*) AS n FROM i WHERE length(key) >= 4 GROUP BY key), qn AS (SELECT DISTINCT lower(p_name) AS name FROM part p2(a, p_name, b, c, d, e) UNION SELECT DISTINCT middle || ' ' || surname FROM life UNION SELECT DISTINCT given || ' ' || surname FROM life UNION SELECT DISTINCT surname FROM life),
  ex AS (SELECT name, 'exact' AS how, n AS candidates FROM qn JOIN idx ON key = lower(name)),
  lo AS (SELECT name, 'containment' AS how, sum(n)::BIGINT AS candidates FROM qn JOIN idx ON
      (list_has_all(string_split(key, ' '), string_split(lower(name), ' ')) OR list_has_all(string_split(lower(name), ' '), string_split(key, ' ')))
      AND (least(len(string_split(key, ' ')), len(string_split(lower(name), ' '))) >= 2 OR (NOT contains(name, ' ') AND length(name) >= 6 AND list_contains(string_split(key, ' '), lower(name))))
    WHERE lower(name) NOT IN (SELECT key FROM idx) GROUP BY name)
  SELECT * FROM ex UNION ALL SELECT * FROM lo""")
def name_resolve(m):
    people = m.person.select(F.explode(nm.name_keys(F.col("name"))).alias("key"))
    partners = m.union_.select(F.explode(nm.name_keys(F.col("s"), spouse=True)).alias("key"))
    lf = m.life
    qs = (
        m.part.select(F.lower("p_name").alias("name"))
        .unionByName(lf.select(F.concat_ws(" ", "middle", "surname").alias("name")))
        .unionByName(lf.select(F.concat_ws(" ", "given", "surname").alias("name")))
        .unionByName(lf.select(F.col("surname").alias("name")))
    )
    out = nm.resolve(qs, people.unionByName(partners))
    return out.groupBy("name", "how").agg(F.sum("candidates").alias("candidates"))


@query("name_search", "life union_", """SELECT card, name, CASE WHEN own THEN NULL ELSE name END AS via FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY own DESC) AS rn FROM (
    SELECT card, name, true AS own FROM life WHERE given LIKE 'Fa%' AND surname LIKE 'Grav%' OR given LIKE 'Fa%' AND middle LIKE 'Grav%'
    UNION ALL SELECT card, s, false FROM union_ WHERE s LIKE 'Fa% Grav%') z) y WHERE rn = 1 ORDER BY card LIMIT 8""")
def name_search(m):
    own = m.person.select("card", "name", F.lit(None).cast("string").alias("via"))
    partner = m.union_.select("card", F.col("s").alias("name"), F.col("s").alias("via"))
    return nm.search(own.unionByName(partner), "  gràv FA ")
