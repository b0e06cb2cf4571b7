"""Cards composed from the plain star-schema tables.

The tables hold no genealogy, so persons, events, sources and bilingual prose are derived from
their keys with integer arithmetic, plus planted contradictions at fixed moduli. Each table is
one SELECT in the common SQL subset, so that the same text runs on Spark and on the checking
database; ``ARR(`` is the only word that differs between them. Everything grows with the input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from claimcheck.functions import lexicon as lx
from claimcheck.session import cut_lineage, spread

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# tables whose rows feed text work, with the most rows for a task; the others are joined or counted as they come
SPREAD = {"customer": 20_000, "orders": 50_000, "documents": 2_000, "pages": 2_000, "conversations": 20_000}

GIVEN = ["Alba", "Bruno", "Celia", "Dario", "Elena", "Fabio", "Greta", "Hugo", "Irma", "Jonas"]
MIDDLE = ["Aldric", "Blanca", "Corin", "Delphe", "Esmon", "Fiora", "Gaspar", "Helda", "Ivo", "Juno"]
SURNAMES = ["Ardent", "Bellmont", "Corvane", "Dunmarch", "Estrell", "Fairlode", "Gravenor"]


def pick(expr: str, values: list) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE {expr} {whens} END)"


def idiv(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}.0) AS BIGINT)"


def _depth() -> str:
    bounds, total = [], 0
    for level in range(20):
        total += 4**level
        bounds.append(f"WHEN c_custkey < {total} THEN {level}")
    return f"(CASE {' '.join(bounds)} END)"


def jdn_sql(y: str, m: str, d: str, julian: bool = False) -> str:
    a = f"(CASE WHEN ({m}) <= 2 THEN 1 ELSE 0 END)"
    yy, mm = f"(({y}) + 4800 - {a})", f"(({m}) + 12 * {a} - 3)"
    days = f"({d}) + {idiv(f'153 * {mm} + 2', 5)} + 365 * {yy} + {idiv(yy, 4)}"
    if julian:
        return f"({days} - 32083)"
    return f"({days} - {idiv(yy, 100)} + {idiv(yy, 400)} - 32045)"


COUNT_WORDS = ["no", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def _base_birth(k: str, depth: str) -> str:
    return f"CAST(1600 + 27 * ({depth}) + ({k}) % 11 AS INT)"


MODEL: dict[str, str] = {}

MODEL["tree"] = f"""
SELECT c_custkey AS card, c_custkey AS k,
  CASE WHEN c_custkey > 0 THEN {idiv('c_custkey - 1', 4)} END AS parent_card,
  CASE WHEN c_custkey > 0 THEN 0 END AS union_idx,
  CASE WHEN c_custkey > 0 THEN CAST((c_custkey - 1) % 4 AS INT) END AS child_idx,
  {_depth()} AS depth,
  CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS g,
  {pick('c_custkey % 10', GIVEN)} AS given,
  {pick(f"{idiv('c_custkey', 10)} % 10", MIDDLE)} AS middle,
  {pick('c_custkey % 7', SURNAMES)} AS surname,
  c_acctbal AS bal
FROM customer
"""

# true and published years; the published ones carry the planted defects
MODEL["life"] = f"""
SELECT t.*, bb AS true_b,
  CASE WHEN k > 0 AND k % 37 = 5 THEN pb - 3 WHEN k > 0 AND k % 53 = 9 THEN pb + 10 ELSE bb END AS b,
  CASE WHEN k > 0 AND k % 37 = 5 THEN pb - 3 WHEN k > 0 AND k % 53 = 9 THEN pb + 10 ELSE bb END
    + CASE WHEN k % 41 = 7 THEN -1 ELSE CAST(40 + k % 50 AS INT) END AS d,
  CAST(1 + k % 12 AS INT) AS mo, CAST(1 + k % 28 AS INT) AS dy,
  given || ' ' || middle || ' ' || surname AS name,
  'NATION_' || CAST(k % 25 AS VARCHAR(20)) AS home,
  CASE WHEN g = 'f' THEN 'She' ELSE 'He' END AS he,
  CASE WHEN g = 'f' THEN 'her' ELSE 'his' END AS his
FROM (SELECT tree.*, {_base_birth('k', 'depth')} AS bb,
        {_base_birth('parent_card', 'depth - 1')} AS pb FROM tree) t
"""

_MON = pick("mo - 1", lx.MONTHS_EN)
_MOIS = pick("mo - 1", lx.MONTHS_FR)
_WED_Y, _WED_M, _WED_D = "(b + 24)", "(1 + (mo + 4) % 12)", "(1 + (dy + 9) % 28)"
_WED_JDN = (
    f"(CASE WHEN {_WED_Y} < 1682 OR ({_WED_Y} = 1682 AND {_WED_M} <= 2) THEN "
    f"{jdn_sql(_WED_Y, _WED_M, _WED_D, True)} ELSE {jdn_sql(_WED_Y, _WED_M, _WED_D)} END)"
)
_WED_MON = pick(f"{_WED_M} - 1", lx.MONTHS_EN)
_WED_MOIS = pick(f"{_WED_M} - 1", lx.MONTHS_FR)


def _s(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


MODEL["prose"] = f"""
SELECT l.*,
  CASE WHEN k % 67 = 11 THEN 'c. ' || {_s('b')} WHEN k % 71 = 12 THEN 'b. ' || {_s('b')}
       ELSE {_s('b')} || '–' || {_s('d')} END AS years,
  name || ' was born ' || {_s('dy')} || ' ' || {_MON} || ' ' || {_s('b')} || ' at ' || home || '.'
    || CASE WHEN k % 29 = 3 THEN ' ' || he || ' died in ' || {_s('d')} || ', according to the census.' ELSE '' END
    || CASE WHEN k % 47 = 8 THEN ' Nothing more is written,, or kept.' ELSE '' END
    || CASE WHEN k % 61 = 9 THEN ' This card has long said so .' ELSE '' END AS note,
  CASE WHEN k % 31 = 7 THEN NULL ELSE
  name || ' est né le ' || {_s('dy')} || ' ' || {_MOIS} || ' ' || {_s('CASE WHEN k % 19 = 4 THEN b + 1 ELSE b END')} || ' à ' || home || '.'
    || CASE WHEN k % 29 = 3 THEN ' Mort en ' || {_s('d')} || ', selon le recensement.' ELSE '' END END AS note_fr,
  CASE WHEN k % 5 = 1 THEN 'Lived at ' || home || ' from ' || {_s('b + 20')} || ' to ' || {_s('b + 30')} || '.' END AS mn,
  CASE WHEN k % 5 = 1 THEN 'A vécu à ' || home || ' de ' || {_s('b + 20')} || ' à ' || {_s('b + 30')} || '.' END AS mn_fr,
  given || ' ' || surname || ' lived and worked at ' || home AS headline,
  given || CASE WHEN k % 43 = 6 THEN '' ELSE ' ' || surname END || ' a vécu et travaillé à ' || home AS headline_fr,
  ARR(
    CASE WHEN k % 59 = 6 THEN given || ' ' || surname || ' lived and worked at ' || home || ' for long. ' ELSE '' END ||
    CASE WHEN k % 3 = 0 THEN 'Whether ' || name || ' was born ' || {_s('dy')} || ' ' || {_MON} || ' ' || {_s('b')} || ' at ' || home || ' is not known.'
         WHEN k % 3 = 1 THEN name || ' was born ' || {_s('dy')} || ' ' || {_MON} || ' ' || {_s('b')} || ' at ' || home || ', as the parish register records.'
         ELSE name || ' was born at ' || home || ' in ' || {_s('b')} || '. No register survives for that year.' END
      || CASE WHEN k % 33 = 4 THEN ' A single family tree gives the date.' WHEN k % 33 = 5 THEN ' Both trees give the date.' ELSE '' END
      || CASE WHEN k % 39 = 8 THEN ' The obituary on his own card says otherwise.' ELSE '' END
      || CASE WHEN k % 36 = 10 THEN ' The 1850 census lists the house.' ELSE '' END,
    he || ' was married on ' || {pick(f'({_WED_JDN} + CASE WHEN k % 13 = 2 THEN 1 ELSE 0 END) % 7', lx.WEEKDAYS)} || ' ' || {_s(_WED_D)} || ' ' || {_WED_MON} || ' ' || {_s(_WED_Y)} || '. The couple stayed '
      || {_s('CASE WHEN k % 17 = 5 THEN 9 ELSE 5 END')} || ' years, from ' || {_s(_WED_D)} || ' ' || {_WED_MON} || ' ' || {_s(_WED_Y)} || ' to ' || {_s(_WED_D)} || ' ' || {_WED_MON} || ' ' || {_s('b + 29')} || '.'
      || CASE WHEN k % 25 = 3 THEN ' The farm lay ' || {_s('5 + k % 400')} || ' km from town.' ELSE '' END,
    he || ' died at ' || {_s('CASE WHEN k % 21 = 11 THEN d - b + 9 ELSE d - b END')} || ' in ' || {_s('d')} || '. The family had '
      || {pick('kids + CASE WHEN kids > 0 AND k % 27 = 14 THEN 2 ELSE 0 END', COUNT_WORDS)} || ' children.'
      || CASE WHEN k % 27 = 15 THEN ' A neighbour counted nine children there.' ELSE '' END
      || CASE WHEN k > 0 AND k % 7 = 3 THEN ' In ' || {_s('true_b + 20')} || ' ' || his || ' father, then ' || {_s('true_b + 20 - parent_b + CASE WHEN k % 14 = 3 THEN 6 ELSE 0 END')} || ', sold the farm.' ELSE '' END
      || CASE WHEN k % 32 = 6 THEN ' In ' || {_s('b + 22')} || ' ' || CASE WHEN k % 64 = 6 THEN {pick('(k + 3) % 10', MIDDLE)} ELSE {pick('(k + 3) % 10', GIVEN)} END || ' ' || {pick('(k + 5) % 7', SURNAMES)} || ', aged 30, kept the shop.' ELSE '' END
  ) AS bio,
  ARR(
    CASE WHEN k % 3 = 0 THEN 'On ignore si ' || name || ' est né le ' || {_s('dy')} || ' ' || {_MOIS} || ' ' || {_s('b')} || ' à ' || home || '.'
         WHEN k % 3 = 1 THEN name || ' est né le ' || {_s('dy')} || ' ' || {_MOIS} || ' ' || {_s('b')} || ' à ' || home || ', selon le registre paroissial.'
         ELSE name || ' est né à ' || home || ' en ' || {_s('b')} || '. Le fonds est clos.' END,
    'Le mariage eut lieu le ' || {_s(_WED_D)} || ' ' || {_WED_MOIS} || ' ' || {_s(_WED_Y)} || '. Le couple resta 5 ans, du ' || {_s(_WED_D)} || ' ' || {_WED_MOIS} || ' ' || {_s(_WED_Y)} || ' au ' || {_s(_WED_D)} || ' ' || {_WED_MOIS} || ' ' || {_s('b + 29')} || '.'
      || CASE WHEN k % 23 = 5 THEN ' Un seul acte, jamais retrouvé, le confirme.' ELSE '' END,
    'Mort à ' || {_s('d - b')} || ' ans en ' || {_s('d')} || '. La famille avait des enfants.'
  ) AS bio_fr
FROM (SELECT life.*, p.p_b AS parent_b,
        CAST(greatest(0, least(4, (SELECT count(*) FROM customer) - 1 - 4 * life.k)) AS INT) AS kids
      FROM life
      LEFT JOIN (SELECT card AS p_card, b AS p_b FROM life) p ON life.parent_card = p.p_card) l
"""

MODEL["person"] = """
SELECT card, name || '|' || years AS card_key, parent_card, union_idx, child_idx, depth, g, name,
  years, note, note_fr, mn, mn_fr, headline, headline_fr, bio, bio_fr,
  CASE WHEN k = 0 THEN 'trunk' WHEN k = 2 THEN 'north' WHEN k = 3 THEN 'south' WHEN k = 11 THEN 'hill'
       WHEN k % 97 = 60 THEN 'lane' || CAST(k AS VARCHAR(20)) WHEN k % 1000 = 23 THEN 'hill' END AS anchor
FROM prose
"""

MODEL["union_"] = f"""
SELECT card, 0 AS union_idx,
  {pick('(k + 4) % 10', GIVEN)} || ' ' || {pick('(k + 2) % 7', SURNAMES)} AS s,
  {_s('true_b + CAST(k % 5 AS INT) - CASE WHEN k % 23 = 4 THEN 40 ELSE 0 END')} || '–' ||
  {_s('CASE WHEN k % 29 = 6 THEN true_b + 20 ELSE true_b + 60 END')} AS sy,
  (k % 12 = 5) AS div_,
  CASE WHEN k % 8 = 1 THEN 'They were married in ' || {_s('b + 24')} || '.' END AS n,
  CASE WHEN k % 16 = 1 THEN 'Mariés en ' || {_s('b + 24')} || '.' END AS n_fr
FROM life
WHERE 4 * k + 1 < (SELECT count(*) FROM customer)
"""

_O = "o_orderkey"
MODEL["event"] = f"""
SELECT card, pos, k, t, c, y,
  CASE WHEN y IS NOT NULL AND pos % 43 = 3 THEN y - 1
       WHEN y IS NOT NULL AND pos % 5 = 0 THEN y + CAST(pos % 20 AS INT) END AS y2,
  CASE WHEN y IS NOT NULL AND pos % 4 <> 3 THEN {_s('1 + pos % 28')} || ' ' || {pick('pos % 12', lx.MONTHS_EN)} || ' '
       || {_s('CASE WHEN pos % 59 = 8 THEN y + 2 ELSE y END')} END AS d,
  x,
  CASE WHEN pos % 13 = 4 AND c <> 'doc' THEN NULL
       WHEN c = 'doc' AND pos % 29 = 7 THEN 'The date may have been copied from a letter.'
       WHEN c <> 'doc' AND pos % 31 = 9 THEN 'The register records the event plainly.'
       WHEN pos % 20 > 15 AND pos % 5 = 0 THEN 'There is no source after the first year.'
       WHEN c = 'doc' AND pos % 6 = 0 THEN 'Cited on the parent card.'
       WHEN c = 'doc' AND NOT x THEN NULL
       ELSE 'The stay at NATION_' || {_s('k')} || ' is inferred.' END AS w,
  CASE WHEN pos % 37 = 5 THEN NULL
       WHEN c = 'doc' AND NOT x THEN NULL
       ELSE 'Le séjour à NATION_' || {_s('k')} || ' est déduit.' END AS w_fr
FROM (SELECT o_custkey AS card, {_O} AS pos, CAST({_O} % 25 AS INT) AS k,
        {pick(_O + ' % 11', lx.EVENT_TYPES)} AS t, {pick(_O + ' % 3', lx.CERTAINTIES)} AS c,
        ({_O} % 17 = 0) AS x,
        CASE WHEN {_O} % 19 = 3 THEN NULL WHEN {_O} % 47 = 2 THEN b - 5
             WHEN {_O} % 11 < 2 THEN b WHEN {_O} % 11 > 8 THEN d + CASE WHEN {_O} % 23 = 6 THEN 1 ELSE 0 END
             ELSE b + CAST({_O} % 60 AS INT) END AS y
      FROM orders JOIN life ON o_custkey = card) e
"""

MODEL["place"] = f"""
SELECT n_nationkey AS k, n_name || ' (' || r_name || ')' AS n, 'PAYS ' || n_name AS n_fr,
  r_name AS c, r_name AS c_fr,
  CAST((n_nationkey * 37) % 140 - 70 AS DOUBLE) AS lat,
  CAST((n_nationkey * 53) % 340 - 170 AS DOUBLE) AS lon,
  CASE WHEN n_nationkey % 6 = 1 THEN 'university' ELSE 'town' END AS kind
FROM nation JOIN region ON n_regionkey = r_regionkey
"""

_LABELS = [
    "Parish register, act n 12", "Census of 1850, household sheet", "Obituary in the Free Trader",
    "Member tree on Geneanet", "Letter, family records",
]
_LABELS_FR = [
    "Registre paroissial, acte n 12", "Recensement de 1850", "Nécrologie du Free Trader",
    "Arbre de membre Geneanet", "Lettre, documents de la famille",
]
MODEL["source"] = f"""
SELECT page_id % (SELECT count(*) FROM customer) AS card,
  CASE WHEN page_id % 3 = 0 THEN 'profile.sources' ELSE 'src' END AS origin, 1000000000 + page_id AS pos,
  {pick('page_id % 5', _LABELS)} AS label, {pick('page_id % 5', _LABELS_FR)} AS label_fr,
  url, CASE WHEN page_id % 4 = 1 THEN 'The entry reads: born in the year named.' END AS quote
FROM pages
UNION ALL
SELECT card, 'src' AS origin, 0 AS pos,
  CASE WHEN k % 8 = 1 THEN 'Parish registers, cahier 4' ELSE 'Member tree on Geneanet' END AS label,
  CAST(NULL AS VARCHAR(20)) AS label_fr,
  CASE WHEN k % 6 = 2 THEN 'http' ELSE 'https' END || '://gw.geneanet.org/tree' || {_s('CASE WHEN k % 3 = 0 THEN 0 ELSE k % 40 END')} AS url,
  CAST(NULL AS VARCHAR(20)) AS quote
FROM tree WHERE k % 4 <> 0
"""

MODEL["doc"] = f"""
SELECT card, 0 AS pos, 'Scan of the page for ' || given AS cap,
  CASE WHEN k % 45 = 9 THEN NULL ELSE 'Image de la page pour ' || given END AS cap_fr,
  'entered on ' || {_s('dy')} || ' ' || {_MON} || ' ' || {_s('b')} || ', aged ' || {_s('k % 90 + 1')} || '.' AS tr,
  'Inscrit le ' || {_s('dy')} || ' ' || {_MOIS} || ' ' || {_s('b')} || ', à ' || {_s('k % 90 + 1')} || ' ans.' AS tr_fr,
  CASE WHEN k % 2 = 0 THEN 'https://www.familysearch.org/ark:/61903/page' || {_s('k')} END AS u,
  'data:image/png;base64,' || {_s('k')} AS img
FROM life WHERE k % 9 = 0
"""

MODEL["capture"] = f"""
SELECT substr(sha1(url), 1, 12) AS id, url, (page_id % 4 <> 0) AS ok,
  CASE WHEN page_id % 4 <> 0 THEN 'store/' || {_s('page_id')} END AS file,
  CASE WHEN page_id % 4 = 0 OR page_id % 11 = 5 THEN NULL
       WHEN page_id % 9 = 1 THEN '<html>Sign in to continue</html>'
       WHEN page_id % 9 = 2 THEN '  ' WHEN page_id % 9 = 4 THEN '<div id="root"></div>'
       WHEN page_id % 9 = 5 THEN '<p>Record of ' || {pick('page_id % 7', SURNAMES)} || '</p>'
       ELSE html END AS body,
  CASE WHEN page_id % 6 = 1 THEN '# url: ' || CASE WHEN page_id % 4 = 0 AND page_id % 5 = 1 THEN 'https://other.example.org/' ELSE url END || chr(10) ||
       CASE WHEN page_id % 18 = 1 THEN 'too short' ELSE 'The page says that the entry of the year was read and copied by hand, line after line, and that every word of it was compared with the image.' END END AS transcription,
  CASE WHEN page_id % 7 = 3 THEN 'CHANGED' WHEN page_id % 4 = 0 THEN 'FAILED' ELSE 'SAVED' END AS result,
  CAST(page_id AS INT) % 400 AS age_days
FROM pages
"""

MODEL["edit"] = f"""
SELECT CASE WHEN p_partkey % 20 = 0 THEN 'b1' WHEN p_partkey % 50 = 10 THEN 'gone' ELSE 'b2' END AS batch,
  p_partkey AS card, CAST(seq AS INT) AS seq, 'name' AS path,
  CASE WHEN p_partkey % 70 = 0 AND seq = 0 THEN 'some other name'
       WHEN seq = 0 THEN p_name ELSE p_name || ' one' END AS expect,
  CASE WHEN p_partkey % 90 = 0 AND seq = 1 THEN NULL WHEN seq = 0 THEN p_name || ' one' ELSE p_name || ' two' END AS value,
  CASE WHEN p_partkey % 30 = 0 THEN 'repair' END AS why
FROM (SELECT p.*, 0 AS seq FROM part p UNION ALL SELECT q.*, 1 AS seq FROM part q) s
WHERE p_partkey % 10 = 0
"""

MODEL["legacy"] = f"""
SELECT CASE WHEN k % 166 = 92 THEN '1000–1001' ELSE years END || '|' || name AS legacy_key, 'value' AS kind, 'years' AS path,
  CASE WHEN k % 249 = 9 THEN years ELSE {_s('b - 5')} || '–?' END AS value, CAST(NULL AS VARCHAR(20)) AS parent_key
FROM prose WHERE k % 83 = 9
UNION ALL
SELECT years || '|' || name, 'value', 'mn', CASE WHEN k % 2 = 0 THEN 'Was said to live at ' || home END, CAST(NULL AS VARCHAR(20))
FROM prose WHERE k % 89 = 3
UNION ALL
SELECT CASE WHEN k % 194 = 110 THEN years ELSE {_s('b - 30')} || '–?' END || '|' || name, 'phantom', CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)),
  CASE WHEN k % 291 = 13 THEN '1000–1001|nobody' ELSE years || '|' || name END
FROM prose WHERE k % 97 = 13
UNION ALL
SELECT 'banner ' || r_name, 'banner', 'banner', 'As it was before, ' || r_name, CAST(NULL AS VARCHAR(20)) FROM region
UNION ALL
SELECT 'banner ' || r_name, 'banner', 'banner_fr', 'Comme avant, ' || r_name, CAST(NULL AS VARCHAR(20)) FROM region WHERE r_regionkey <> 3
"""

MODEL["provenance"] = """
SELECT card, CASE WHEN k < 20 THEN 'grafted' ELSE 'added' END AS tag FROM tree WHERE k = 7 OR k = 12 OR k % 25 = 23
"""

# angle brackets stand for the braces of JSON, which the SQL formatter would read
MODEL["op_edit"] = f"""
SELECT CASE WHEN k % 200 = 104 THEN -1 - card ELSE card END AS card, 1 AS ord, CAST(k % 50 AS BIGINT) AS seq, k,
  translate(CASE k % 50
    WHEN 1 THEN '<"path":"mn","expect":"' || CASE WHEN k % 100 = 51 THEN 'Never held' ELSE mn END || '","value":"Moved ' || {_s('k')} || '","why":"a letter">'
    WHEN 2 THEN '<"path":"mn","expect":null,"value":"First note ' || {_s('k')} || '">'
    WHEN 4 THEN '<"op":"appendSource","value":<"l":"Deed ' || {_s('k')} || '","u":"https://deeds.example.org/' || {_s('k')} || '">'
      || CASE WHEN k % 100 = 54 THEN ',"profileValue":<"label":"Deed","label_fr":"Acte","url":"https://deeds.example.org/">' ELSE '' END || '>'
    WHEN 5 THEN '<"op":"gaz","key":"' || {_s('k % 30')} || '","value":<"n":"Place ' || {_s('k')} || '"' || CASE WHEN k % 3 = 0 THEN ',"lat":' || {_s('k % 90')} ELSE '' END || '>>'
    WHEN 6 THEN '<"path":"mn_fr","value":null>'
    ELSE '<"op":"rename","path":"' || 'title' || '">' END, '<>', chr(123) || chr(125)) AS body
FROM prose WHERE k % 50 IN (1, 2, 4, 5, 6) OR k % 500 = 7
"""

_DEPS: dict[str, list[str]] = {}


def _deps(name: str) -> list[str]:
    """Model tables a model table reads, by name."""
    if name not in _DEPS:
        _DEPS[name] = [
            m for m in MODEL if m != name and re.search(rf"\b(?:FROM|JOIN)\s+{m}\b", MODEL[name])
        ]
    return _DEPS[name]


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in _deps(n):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_sql(names: str, body: str) -> str:
    """``WITH <model tables>, <further CTEs> SELECT ...`` for the checking database."""
    parts = [
        f"{n} AS ({MODEL[n].replace('ARR(', 'list_value(')})" for n in _closure(names.split())
    ]
    body = body.strip()
    if body.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + (",\n" if parts else "") + body[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


class Cards:
    """Lazy DataFrames of the composed model over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in MODEL:
                inputs = {d: self.table(d) for d in self._inputs(name)}
                sql = MODEL[name].replace("ARR(", "array(")
                for d in inputs:
                    sql = re.sub(rf"\b(FROM|JOIN)(\s+){d}\b(?! [a-z]\b)", rf"\1\2{{{d}}} AS {d}", sql)
                    sql = re.sub(rf"\b(FROM|JOIN)(\s+){d}\b(?= [a-z]\b)", rf"\1\2{{{d}}}", sql)
                self._made[name] = self.spark.sql(sql, **inputs)
            else:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                self._made[name] = spread(df, SPREAD[name]) if name in SPREAD else df
        return self._made[name]

    @staticmethod
    def _inputs(name: str) -> list[str]:
        bases = [b for b in BASE_TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{b}\b", MODEL[name])]
        return _deps(name) + bases

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def staged(self, *names: str) -> Cards:
        """Write model tables that a query reads many times once, instead of composing them anew."""
        for n in names:
            self._made[n] = cut_lineage(self.table(n))
        return self
