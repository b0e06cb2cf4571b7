"""Queries over findings, constraints, privacy and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.operators import constraints as co
from claimcheck.operators import dossier as do
from claimcheck.operators import findings as fi
from claimcheck.operators import geometry as ge
from claimcheck.operators import privacy as pv
from claimcheck.operators import structure as st
from claimcheck.operators import tree as tr
from claimcheck.plans import q_arith, q_evidence, q_structure, q_text  # noqa: F401  (their SQL is reused below)
from claimcheck.plans import sql_text as sq
from claimcheck.plans.card_model import oracle_sql
from claimcheck.plans.registry import ORACLES, query
from claimcheck.plans.suite import run_checks
from claimcheck.session import cut_lineage

FN = sq.FIELD_NEEDS


def _union(names: list[str]) -> str:
    return " UNION ALL ".join(f'SELECT "check", sev, card, path, msg FROM ({ORACLES[n]})' for n in names)


STRUCTURE = ["event_vs_span", "event_order", "gap_days", "parent_child"]
ROLL = [*STRUCTURE, "tooltip_cards"]
ALL = f"fnd AS ({_union(ROLL)})"


def _findings(m):
    return run_checks(m.staged("person", "event"), ["C5", "C7"])


@query("findings_rollup", "", f"""WITH {ALL} SELECT 'sev' AS facet, sev AS value, count(*) AS n FROM fnd GROUP BY sev UNION ALL SELECT 'check', "check", count(*) FROM fnd GROUP BY "check"
  UNION ALL SELECT 'total', 'all', count(*) FROM fnd UNION ALL SELECT 'cards', 'with findings', count(DISTINCT card) FROM fnd""")
def findings_rollup(m):
    return fi.rollup(_findings(m))


@query("severity_pivot", "", f"""WITH {ALL} SELECT "check", count(*) FILTER (sev = 'high') AS high, count(*) FILTER (sev = 'med') AS med, count(*) FILTER (sev = 'review') AS review, count(*) FILTER (sev = 'low') AS low FROM fnd GROUP BY "check" """)
def severity_pivot(m):
    return fi.severity_pivot(_findings(m))


_W = "CASE sev WHEN 'high' THEN 10 WHEN 'med' THEN 4 WHEN 'review' THEN 2 ELSE 1 END"
_R = "CASE sev WHEN 'high' THEN 0 WHEN 'med' THEN 1 WHEN 'review' THEN 2 ELSE 3 END"


@query("card_score", "", f"""WITH {ALL} SELECT card, CAST(sum({_W}) AS BIGINT) AS score, count(*) AS n, min({_R}) AS worst_rank, card % 10 = 0 AS priority FROM fnd GROUP BY card""")
def card_score(m):
    scores = fi.card_scores(_findings(m), m.customer.where("c_custkey % 10 = 0").selectExpr("c_custkey AS card"))
    return fi.report_order(scores)


@query("check_subset", "", f"""WITH s AS ({_union(STRUCTURE)}) SELECT "check", sev, card, path, msg FROM s""")
def check_subset(m):
    return run_checks(m, ["C5"])


@query("report_topk", "", f"""WITH {ALL}, s AS (SELECT card, CAST(sum({_W}) AS BIGINT) AS score FROM fnd GROUP BY card) SELECT card, score FROM s ORDER BY card % 10 = 0 DESC, score DESC, card LIMIT 15""")
def report_topk(m):
    scores = fi.card_scores(_findings(m), m.customer.where("c_custkey % 10 = 0").selectExpr("c_custkey AS card"))
    return fi.report_order(scores, 15).select("card", "score")


@query("report_rows", "", f"""WITH {ALL}, s AS (SELECT card, CAST(sum({_W}) AS BIGINT) AS score FROM fnd GROUP BY card)
  SELECT row_number() OVER (ORDER BY card % 10 = 0 DESC, score DESC, card, {_R}, "check", path, msg) AS "row", "check", sev, card, path, msg FROM fnd JOIN s USING (card)""")
def report_rows(m):
    found = cut_lineage(_findings(m))
    return fi.report_rows(found, fi.card_scores(found, m.customer.where("c_custkey % 10 = 0").selectExpr("c_custkey AS card")))


#: Queries whose SQL is over the cards alone; what the others find on cards is spelled out below.
SUITE = [
    *STRUCTURE, "tooltip_cards", "hedge_vs_flat", "source_type_unsupported", "census_unsupported", "cross_reference", "source_count", "pin_notes", "pin_vs_prose",
    "undocumented_pins", "weekday_claims", "age_check", "reversed_years", "pair_parity_missing", "pair_parity_years", "pair_parity_numbers", "pair_parity_hedges",
    "pair_parity_sentences", "pair_parity_names", "pair_parity_words", "distance_claims", "typography_cards", "process_phrases", "headline_dup", "unused_source",
    "count_claims", "count_contradiction",
]
#: Contracts asked of the cards: the registers of some towns give no day.
SUITE_CONTRACTS = [
    *q_evidence.CONTRACTS,
    {"key": "town-registers", "name": r"\bNATION_1[0-9]\b", "excludes": ["day-date"], "exempt": [], "status": "DRAFT"},
]
_LENGTHS = f"""WITH {sq.PAIR} SELECT 'C6' AS "check", 'med' AS sev, card, label AS path, 'length ratio EN/FR ' || CAST(floor(len(en) * 100 / len(fr)) AS BIGINT) || '%' AS msg
  FROM both_ WHERE len(en) / len(fr) < 0.55 OR len(en) / len(fr) > 1.6"""
_INTERVALS = """WITH x AS (SELECT card, regexp_extract(bio[2], '[0-9]+ years, from (.+) to ([^.]+)\\.', ['a', 'b']) AS v, regexp_extract(bio[2], '([0-9]+) years, from ', 1) AS n FROM person WHERE contains(bio[2], ' years, from ')),
  y AS (SELECT card, n, v.a AS a, v.b AS b, CAST(right(v.b, 4) AS INT) - CAST(right(v.a, 4) AS INT) AS val FROM x)
  SELECT 'C4' AS "check", 'med' AS sev, card, 'bio[1]' AS path, '"' || n || ' years" matches no date pair in the sentence; ' || a || '→' || b || '=' || val || 'y' AS msg FROM y WHERE abs(val - CAST(n AS INT)) > 1"""
_CONTRACTS_SQL = f"WITH {sq.FIELD}, t AS (SELECT card, path, text FROM f WHERE NOT regexp_matches(path, '^(src|psrc|profile\\.sources)\\[')), {q_evidence.contract_sql(SUITE_CONTRACTS, 't')}"
_EVERY = " UNION ALL ".join([_union(SUITE), *(f'SELECT "check", sev, card, path, msg FROM ({oracle_sql(FN, body)})' for body in (_LENGTHS, _INTERVALS, _CONTRACTS_SQL))])


@query("all_checks", "", f"""WITH fnd AS ({_EVERY}) SELECT row_number() OVER (ORDER BY "check", card, path, msg, sev) AS id, "check", sev, card, path, msg FROM fnd""")
def all_checks(m):
    """Every check of the registry over the cards, source contracts included, with ids that reruns give again."""
    m = m.staged("person", "event", "source", "doc", "union_")
    m.contracts = SUITE_CONTRACTS
    return fi.with_ids(run_checks(m))


# ------------------------------------------------------------------ dossier
_PIN = "concat_ws(' ', e.t, '@', p.n, 'c=' || e.c, CASE WHEN x THEN 'x=ALT' END, concat_ws('–', y, y2), d)"


@query("dossier", FN + " place", f"""WITH {sq.FIELD}, {sq.EVIDENCE}, {q_structure.SPAN},
  up AS (SELECT p.card, f.name || ' ' || f.years AS fw, f.years AS fy, u.s, u.sy FROM person p JOIN person f ON p.parent_card = f.card LEFT JOIN union_ u ON u.card = f.card),
  chk AS ({_union(STRUCTURE)})
  SELECT card, 'family' AS section, 'parents' AS item, fw || ' × ' || concat_ws(' ', s, sy) AS text FROM up
  UNION ALL SELECT card, 'family', 'union[0]', s || ' ' || sy || CASE WHEN div_ THEN ' [divorced]' ELSE '' END FROM union_
  UNION ALL SELECT parent_card, 'family', 'union[0].c[' || child_idx || ']', name || ' ' || years FROM person WHERE parent_card IS NOT NULL
  UNION ALL SELECT card, 'field', path, text FROM f
  UNION ALL SELECT e.card, 'pin', 'pl[' || pos || ']', {_PIN} FROM event e LEFT JOIN place p ON e.k = p.k
  UNION ALL SELECT card, 'evidence', path, left(text, 400) FROM evidence
  UNION ALL SELECT card, 'anchor', 'dates line', years || ' (birth ' || coalesce(CAST(b AS VARCHAR), '?') || ', death ' || coalesce(CAST(d_ AS VARCHAR), '?') || ')' FROM span
  UNION ALL SELECT card, 'anchor', 'parents', 'father: ' || fy || '   mother: ' || coalesce(sy, '?') FROM up
  UNION ALL SELECT parent_card, 'anchor', 'union[0].c[' || child_idx || ']', years FROM person WHERE parent_card IS NOT NULL
  UNION ALL SELECT card, 'anchor', 'pl[' || pos || ']', t || ': ' || d FROM event WHERE d IS NOT NULL
  UNION ALL SELECT card, 'finding', sev || '/' || "check" || ' ' || path, msg FROM chk""")
def dossier(m):
    m = m.staged("person", "event")
    return do.dossier(m, findings=run_checks(m, ["C5"]))


# ------------------------------------------------------------------ constraints
def _constraint_sql() -> str:
    filled = lambda c: f"coalesce({c}, '') <> ''"
    pair = lambda a, b: f"(NOT {filled(a)} OR {filled(b)})"
    conds = {
        "name is not empty": filled("name"), "at least 108 people": 108, "sex is f or m": "g IN ('f', 'm')",
        "bio is bilingual, paragraph for paragraph": "len(bio) = len(bio_fr)", "note has its translation": pair("note", "note_fr"),
        "map note has its translation": pair("mn", "mn_fr"),
        "note names no spouse": "NOT regexp_matches(coalesce(note, ''), '(re)?married\\s+[A-Z]|\\b(wife|husband|spouse)\\s+[A-ZÉ]')",
        "union note has its translation": pair("n", "n_fr"), "source has a label": filled("label"),
        "source url is http(s)": f"(NOT {filled('url')} OR regexp_matches(url, '^https?://'))",
        "profile source url is https": f"(origin <> 'profile.sources' OR NOT {filled('url')} OR url LIKE 'https://%')",
        "document is captioned in both languages": f"{filled('cap')} AND {filled('cap_fr')}",
        "document is transcribed in both languages": f"{filled('tr')} AND {filled('tr_fr')}",
        "document image is embedded": "regexp_matches(coalesce(img, ''), '^data:image/(jpeg|png);base64,')",
        "document link is https": f"(NOT {filled('u')} OR u LIKE 'https://%')",
        "place coordinates are valid": "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180",
        "place names are bilingual": f"{filled('n')} AND {filled('n_fr')}", "place contexts are bilingual": "c IS NOT NULL AND c_fr IS NOT NULL",
        "more than 100 places": 101, "at least 380 events": 380,
        "event certainty is known": "c IN ('doc', 'inf', 'apx')", "event type is known": "t IN (" + ", ".join(f"'{t}'" for t in lx.EVENT_TYPES) + ")",
        "event year is plausible": "(y IS NULL OR (y > 1400 AND y < 2100))", "event span does not run backwards": "(y2 IS NULL OR y IS NULL OR y2 >= y)",
        "event note has its translation": pair("w", "w_fr"), "uncertain or conflicting event explains itself": f"((c = 'doc' AND NOT x) OR {filled('w')})",
        "at least one disclosed conflict": None, "at least 10 people have documents": ("DISTINCT card", "true", 10), "at least 20 documents": 20,
        "at least 90 people have a place trail": ("DISTINCT card", "true", 90), "at least 8 event types": ("DISTINCT t", "true", 8),
        "at least 80 homes are a birth or baptism": ("*", "t IN ('birth', 'baptism')", 80), "at least 25 home places": ("DISTINCT k", "true", 25),
    }
    out = []
    for r in co.default_rules():
        cond = conds[r.name]
        if cond is None:
            v = "greatest(1 - count(*) FILTER (x), 0)"
        elif isinstance(cond, tuple):
            v = f"greatest({cond[2]} - count({cond[0]}) FILTER ({cond[1]}), 0)"
        elif isinstance(cond, int):
            v = f"greatest({cond} - count(*), 0)"
        else:
            v = f"count(*) - count(*) FILTER ({cond})"
        out.append(f"SELECT '{r.name}' AS name, '{r.table}' AS scope, {v} AS violations, count(*) AS total FROM {r.table}")
    home = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY CASE WHEN x THEN 3 WHEN t = 'birth' THEN 0 WHEN t = 'baptism' THEN 1 ELSE 2 END, pos) AS rn FROM event) WHERE rn = 1"
    return f"WITH home AS ({home}) " + " UNION ALL ".join(out)


@query("constraints", "person union_ source doc place event", _constraint_sql())
def constraints(m):
    tables = {t: m.table(t) for t in ["person", "union_", "source", "doc", "place", "event"]}
    return co.check_constraints(tables | {"home": st.home_event(m.event)})


@query("root_reach", "person", f"WITH {q_structure.WALK} SELECT (SELECT count(*) FROM person) AS people, (SELECT count(*) FROM person WHERE parent_card IS NULL) AS roots, (SELECT count(*) FROM walk WHERE depth > 0) AS descendants")
def root_reach(m):
    return co.root_reach(m.person, tr.with_paths(m.person))


@query("uncited_people", "person source", "SELECT card, name FROM person WHERE card NOT IN (SELECT card FROM source WHERE origin = 'src')")
def uncited_people(m):
    return co.uncited_people(m.person, m.source)


@query("undated_trails", "event", "SELECT card, count(*) AS stops, count(y) AS dated FROM event GROUP BY card HAVING count(*) > 1 AND count(y) = 0")
def undated_trails(m):
    return co.undated_trails(m.event)


@query("university_events", "event place", "SELECT card, pos, t, e.k FROM event e JOIN place p ON e.k = p.k WHERE kind = 'university' AND t NOT IN ('study', 'work')")
def university_events(m):
    return co.misplaced_at_university(m.event, m.place)


@query("duplicate_names", "person", "SELECT name, count(*) AS n FROM person GROUP BY name HAVING count(*) > 1")
def duplicate_names(m):
    return co.duplicate_names(m.person)


@query("home_summary", "event", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY CASE WHEN x THEN 3 WHEN t = 'birth' THEN 0 WHEN t = 'baptism' THEN 1 ELSE 2 END, pos) AS rn FROM event)
  SELECT count(*) AS homes, count(*) FILTER (t IN ('birth', 'baptism')) AS at_birth, count(DISTINCT k) AS places FROM o WHERE rn = 1""")
def home_summary(m):
    return co.home_summary(st.home_event(m.event))


# ------------------------------------------------------------------ privacy
_LW = "list_filter(string_split_regex({c}, '[^\\p{{L}}]+'), lambda v: v <> '')"


@query("leak_scan", "", f"""WITH b AS (SELECT DISTINCT array_to_string({_LW.format(c=sq.fold('text'))}, ' ') AS token FROM benchmark),
  d AS (SELECT doc_id, ' ' || array_to_string({_LW.format(c=sq.fold('text'))}, ' ') || ' ' AS body FROM documents)
  SELECT doc_id, token, 'full' AS tier FROM d JOIN b ON contains(body, ' ' || token || ' ')""")
def leak_scan(m):
    index = m.benchmark.select(F.array_join(pv.letters(F.col("text")), " ").alias("token"), F.lit("full").alias("tier")).distinct()
    return pv.leak_scan(m.documents, "doc_id", "text", index)


@query("message_leak", "", f"""WITH tk AS (SELECT DISTINCT unnest({_LW.format(c='lower(text)')}) AS token FROM benchmark), t5 AS (SELECT token FROM tk WHERE length(token) >= 3),
  w AS (SELECT conv_id, turn, unnest(list_distinct(list_concat({_LW.format(c='lower(text)')}, {_LW.format(c=sq.fold('text'))}))) AS token FROM conversations)
  SELECT conv_id, turn, array_to_string(list_sort(list(DISTINCT token)), ',') AS hits FROM w WHERE length(token) >= 3 AND token IN (SELECT token FROM t5) GROUP BY conv_id, turn""")
def message_leak(m):
    tokens = m.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("token")).where("length(token) >= 3").distinct()
    return pv.message_leak(m.conversations, ["conv_id", "turn"], "text", tokens)


_LINES = """SELECT user_id AS file, event_id AS line_no, CASE WHEN event_id % 13 = 4 THEN '/* allow-names-begin */' WHEN event_id % 13 = 9 THEN '/* allow-names-end */' WHEN event_id % 17 = 5 THEN event_type || ' // allow-names: vocabulary' ELSE event_type || ' ' || event_id END AS line FROM {e}"""


@query("allow_block", "", f"""WITH l AS ({_LINES.format(e='events')}), k AS (SELECT *, CASE WHEN line LIKE '%-begin%' THEN 'begin' WHEN line LIKE '%-end%' THEN 'end' END AS mark FROM l),
  s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM k)
  SELECT file, line_no, line FROM s WHERE coalesce(state, '') <> 'begin' AND mark IS NULL AND line NOT LIKE '%allow-names%'""")
def allow_block(m):
    return pv.strip_allowed(m.spark.sql(_LINES.format(e="{e}"), e=m.events))


@query("unclosed_blocks", "", f"""WITH l AS ({_LINES.format(e='events')}), k AS (SELECT * FROM l WHERE line LIKE '%-begin%' OR line LIKE '%-end%'), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS rn FROM k)
  SELECT file, line_no FROM r WHERE rn = 1 AND line LIKE '%-begin%'""")
def unclosed_blocks(m):
    return pv.unclosed_blocks(m.spark.sql(_LINES.format(e="{e}"), e=m.events))


_LBL = """CASE o_orderkey % 4 WHEN 0 THEN 'Letter to the archive from Anna ' || {s} || ' in 1901' WHEN 1 THEN 'Photographed by Élise ' || {s} || ' Nord (copy)' WHEN 2 THEN 'Census of 1850 by Paul ' || {s} ELSE 'Email via Otto ' || {s} END"""
_SUR = "(CASE o_custkey % 3 WHEN 0 THEN 'Ardent' WHEN 1 THEN 'Bell' ELSE 'Corvane' END)"


@query("label_names", "", """WITH l AS (SELECT o_orderkey % 4 AS z, CASE o_custkey % 3 WHEN 0 THEN 'ardent' WHEN 1 THEN 'bell' ELSE 'corvane' END AS s FROM orders)
  SELECT DISTINCT token, tier FROM (SELECT CASE z WHEN 0 THEN 'anna ' || s WHEN 1 THEN 'elise ' || s || ' nord' ELSE 'otto ' || s END AS token, 'full' AS tier FROM l WHERE z <> 2
    UNION ALL SELECT s, 'surname' FROM l WHERE z IN (0, 3) AND length(s) >= 5) q""")
def label_names(m):
    return pv.label_names(m.orders.selectExpr(f"{_LBL.format(s=_SUR)} AS label"))


@query("name_index", "person union_", """WITH n AS (SELECT name, years FROM person UNION ALL SELECT s, NULL FROM union_), w AS (SELECT string_split(lower(name), ' ') AS ws, lower(name) AS low, CAST(regexp_extract(years, '(\\d{4})', 1) AS INT) >= 1930 AND NOT regexp_matches(years, '–\\d{4}$') AS living FROM n)
  SELECT DISTINCT token, tier FROM (SELECT low AS token, 'full' AS tier FROM w UNION ALL SELECT ws[-1], 'surname' FROM w WHERE length(ws[-1]) >= 5 AND ws[-1] <> 'ardent' UNION ALL SELECT unnest(ws[1:-2]), 'living_given' FROM w WHERE living) z WHERE tier <> 'living_given' OR length(token) >= 4""")
def name_index(m):
    return pv.name_index(m.person, m.union_, allow=["ardent"])


@query("deny_list", "event person", """WITH k AS (SELECT e.card, pos, t, k, left(sha256(name || '|' || years || ':' || t || ':' || k), 16) AS h FROM event e JOIN person p ON e.card = p.card)
  SELECT card, pos, t, k, h FROM k WHERE h IN (SELECT h FROM k WHERE pos % 97 = 13)""")
def deny_list(m):
    keys = m.event.where("pos % 97 = 13").join(m.person.select("card", "name", "years"), "card")
    deny = keys.select(pv.event_key(F.col("name"), F.col("years"), F.col("t"), F.col("k")).alias("h")).distinct()
    return pv.denied_events(m.event, m.person, deny)


# ------------------------------------------------------------------ geometry
_XY = "CAST((o_orderkey * 37 % 340 - 170) AS DOUBLE) + (o_orderkey % 8) / 8.0 AS x, CAST((o_orderkey * 53 % 140 - 70) AS DOUBLE) + (o_orderkey % 4) / 4.0 AS y"
_PTS = f"""o AS (SELECT o_orderkey AS id, {_XY} FROM orders), pts AS (SELECT id, 0 AS ring, 0 AS ord, x AS lon, y AS lat FROM o UNION ALL SELECT id, 0, 1, x + 0.125, y - 0.25 FROM o UNION ALL SELECT id, 0, 2, -x, -y FROM o)"""


def _code(*steps: str) -> str:
    """SQL that codes whole numbers of up to 19 bits, written apart from the decoder that it checks."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', CAST({} AS INT) + 1, 1)"
    digits = [
        f"CASE WHEN n >= {32 ** (j + 1)} THEN {digit.format(f'n div {32**j} % 32 + 32')} WHEN n >= {32**j if j else 0} THEN {digit.format(f'n div {32**j} % 32')} ELSE '' END"
        for j in range(4)
    ]
    zigzag = f"transform(array({', '.join(steps)}), s -> CASE WHEN s < 0 THEN -2 * s - 1 ELSE 2 * s END)"
    return f"array_join(transform({zigzag}, n -> concat({', '.join(digits)})), '')"


_STEPS = f"SELECT *, CAST(x * 1000 AS BIGINT) AS px, CAST(y * 1000 AS BIGINT) AS py FROM (SELECT o_orderkey, o_custkey, {_XY} FROM {{orders}})"


def _points(m):
    steps = m.spark.sql(f"SELECT o_orderkey AS id, px, py, -2 * px - 125 AS bx, -2 * py + 250 AS by_ FROM ({_STEPS})", orders=m.orders)
    return ge.decode(steps.selectExpr("id", f"{_code('px', 'py', '125L', '-250L', 'bx', 'by_')} AS code"), "id", "code")


def _labels(m):
    before = "lag({0}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"
    steps = m.spark.sql(f"SELECT *, px - coalesce({before.format('px')}, 0) AS dx, py - coalesce({before.format('py')}, 0) AS dy FROM ({_STEPS})", orders=m.orders)
    rec = f"concat(o_orderkey % 9, {_code('dx', 'dy')}, '~Town ', o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '~FR' END)"
    return ge.decode_labels(steps.selectExpr("o_custkey AS layer", "o_orderkey AS pos", f"{rec} AS rec"))


_LABELS = f"lab AS (SELECT o_custkey AS layer, o_orderkey AS pos, CAST(o_orderkey % 9 AS INT) AS rank, CAST(x AS DOUBLE) AS lon, CAST(y AS DOUBLE) AS lat, 'Town ' || o_orderkey AS name, CASE WHEN o_orderkey % 13 > 0 THEN 'FR' END AS cc FROM (SELECT o_orderkey, o_custkey, {_XY} FROM orders))"


@query("label_decode", "", f"WITH {_LABELS} SELECT layer, pos, rank, lon, lat, name, cc FROM lab")
def label_decode(m):
    return _labels(m)


@query("geo_decode", "", f"WITH {_PTS} SELECT id, ring, ord, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM pts")
def geo_decode(m):
    return _points(m)


BOXES = [("north", 10.0, 40.0, 25.0), ("west", -90.0, 0.0, 30.0), ("small", 0.0, 0.0, 0.5)]


@query("bbox_counts", "", f"WITH {_PTS} " + " UNION ALL ".join(f"SELECT '{n}' AS box, count(*) FILTER (abs(lon - ({x})) < {d} AND abs(lat - ({y})) < {d}) AS points FROM pts" for n, x, y, d in BOXES))
def bbox_counts(m):
    return ge.box_counts(_points(m), BOXES)


def _layer_sql() -> str:
    near = [(f"at least 4 labels around {n}", f"greatest(4 - count(*) FILTER (abs(lon - ({x})) < {d} AND abs(lat - ({y})) < {d}), 0)") for n, x, y, d in BOXES]
    label = [
        ("label rank is 0 to 6", "count(*) FILTER (rank > 6)"), ("label has a name and a country", "count(*) FILTER (cc IS NULL)"),
        ("label lies on the globe", "count(*) FILTER (abs(lat) > 90 OR abs(lon) > 180)"), *near,
    ]
    outline = [("outline lies on the globe", "count(*) FILTER (abs(lat) > 90 OR abs(lon) > 180.5)"), ("at least 200 rings", "greatest(200 - count(DISTINCT id), 0)")]
    cell = "SELECT '{}' AS name, '{}' AS scope, {} AS violations, count(*) AS total FROM {}"
    return " UNION ALL ".join([cell.format(n, "label", v, "lab") for n, v in label] + [cell.format(n, "outline", v, "pts") for n, v in outline])


@query("layer_constraints", "", f"WITH {_PTS}, {_LABELS} {_layer_sql()}")
def layer_constraints(m):
    return co.check_constraints({"label": _labels(m), "outline": _points(m)}, ge.layer_rules(BOXES, 4, 200))
