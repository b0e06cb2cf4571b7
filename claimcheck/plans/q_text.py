"""Queries over text: functions, typography, style, parity, doubt."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.functions import dates as dt
from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx
from claimcheck.functions import text as tx
from claimcheck.operators import cards as cd
from claimcheck.operators import prose as pr
from claimcheck.plans import sql_text as sq
from claimcheck.plans.registry import query
from claimcheck.plans.sql_text import q

FN = sq.FIELD_NEEDS


def _docs(m):
    """Documents as fields: one text per document."""
    return m.documents.select(
        F.col("doc_id").alias("card"), F.lit("text").alias("path"), "lang",
        F.lit("tooltip").alias("kind"), "text", F.lit(None).cast("bigint").alias("i"),
        F.lit(False).alias("alt"),
    )


@query("field_unpivot", FN, f"WITH {sq.FIELD} SELECT card, path, lang, kind, text, i, alt FROM f")
def field_unpivot(m):
    return cd.fields(m)


@query("pair_unpivot", FN, f"WITH {sq.PAIR} SELECT card, label, kind, en, fr FROM pair")
def pair_unpivot(m):
    return cd.pairs(m)


@query("evidence_items", "source doc", f"WITH {sq.EVIDENCE} SELECT card, path, text FROM evidence")
def evidence_items(m):
    return cd.evidence(m)


@query("norm_fold", "", f"SELECT doc_id, {sq.norm('text')} AS normed, strip_accents(text) AS plain, {sq.fold('text')} AS folded FROM documents")
def norm_fold(m):
    t = F.col("text")
    return m.documents.select("doc_id", tx.norm(t).alias("normed"), tx.deaccent(t).alias("plain"), tx.fold(t).alias("folded"))


@query("sentence_split", "", f"WITH x AS (SELECT doc_id, {sq.sentences('text')} AS ss FROM documents) SELECT doc_id, j - 1 AS ord, ss[j] AS sentence FROM x, unnest(range(1, len(ss) + 1)) u(j)")
def sentence_split(m):
    return m.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence"))


@query("clause_split", "", f"""WITH x AS (SELECT doc_id, flatten(list_transform({sq.sentences("replace(text, ', ', '; ')")}, lambda s: string_split_regex(s, '\\s*[;—]\\s*'))) AS cs FROM documents)
  SELECT doc_id, len(cs) AS clauses, list_sum(list_transform(cs, lambda c: len(c)))::BIGINT AS chars FROM x""")
def clause_split(m):
    cs = tx.clauses(F.regexp_replace("text", ", ", "; "))
    df = m.documents.select("doc_id", cs.alias("cs"))
    chars = F.aggregate("cs", F.lit(0), lambda a, c: a + F.length(c))
    return df.select("doc_id", F.size("cs").alias("clauses"), F.when(F.size("cs") > 0, chars.cast("bigint")).alias("chars"))


_TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
_ONES = ["x", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "second"]


def _case(expr, values):
    return f"(CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


_NUMTEXT = f"CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey % 999 AS VARCHAR(9)) ELSE {_case('2 + o_orderkey % 8', _TENS)} || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE ' ' END || {_case('o_orderkey % 11', _ONES)} END"
_VALUES = f"CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 999 WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 10 THEN 10 * (2 + o_orderkey % 8) + 2 ELSE 10 * (2 + o_orderkey % 8) + o_orderkey % 11 END"


@query("number_words", "", f"SELECT o_orderkey, CAST({_VALUES} AS INT) AS n FROM orders")
def number_words(m):
    return m.orders.selectExpr("o_orderkey", f"{_NUMTEXT} AS word").select("o_orderkey", tx.number_of(F.col("word")).alias("n"))


_DATETEXT = f"""'Entered on ' || CAST(dd AS VARCHAR(9)) || ' ' || {_case('mo - 1', lx.MONTHS_EN)} || ' ' || CAST(yy AS VARCHAR(9)) || ', copied ' || {_case('mo % 12', lx.MONTHS_EN)} || ' ' || CAST(dd AS VARCHAR(9)) || ', ' || CAST(yy + 30 AS VARCHAR(9)) || ', puis le ' || CASE WHEN dd = 1 THEN '1er' ELSE CAST(dd AS VARCHAR(9)) END || ' ' || {_case('mo - 1', lx.MONTHS_FR)} || ' ' || CAST(yy + 2 AS VARCHAR(9)) || ' à 9 h 30, n° 145.'"""
_ODATES = "(SELECT o_orderkey, CAST(1 + o_orderkey % 28 AS INT) AS dd, CAST(1 + o_orderkey % 12 AS INT) AS mo, CAST(1600 + o_orderkey % 300 AS INT) AS yy FROM {o}) z"


@query("date_extract", "", f"""WITH t AS (SELECT *, {_DATETEXT} AS text FROM {_ODATES.format(o='orders')}), a AS (
  SELECT o_orderkey, 0 AS ord, yy AS y, mo AS m, dd AS d, dd || ' ' || {_case('mo - 1', lx.MONTHS_EN)} || ' ' || yy AS raw, text FROM t
  UNION ALL SELECT o_orderkey, 1, yy + 30, mo % 12 + 1, dd, {_case('mo % 12', lx.MONTHS_EN)} || ' ' || dd || ', ' || (yy + 30), text FROM t
  UNION ALL SELECT o_orderkey, 2, yy + 2, mo, dd, CASE WHEN dd = 1 THEN '1er' ELSE CAST(dd AS VARCHAR) END || ' ' || {_case('mo - 1', lx.MONTHS_FR)} || ' ' || (yy + 2), text FROM t)
  SELECT o_orderkey, ord, y, m, d, raw, CAST(CASE WHEN ord = 0 THEN instr(text, 'on ' || raw) + 2 WHEN ord = 1 THEN instr(text, 'copied ' || raw) + 6 ELSE instr(text, 'le ' || raw) + 2 END AS INT) AS pos FROM a""")
def date_extract(m):
    t = m.spark.sql(f"SELECT *, {_DATETEXT} AS text FROM {_ODATES.format(o='{o}')}", o=m.orders)
    return t.select("o_orderkey", F.posexplode(dt.find_dates(F.col("text"))).alias("ord", "x")).select("o_orderkey", "ord", "x.y", "x.m", "x.d", "x.raw", "x.pos")


@query("year_extract", "", f"""WITH t AS (SELECT *, {_DATETEXT} AS text FROM {_ODATES.format(o='orders')}), y AS (SELECT o_orderkey, regexp_extract_all(text, {q(lx.YEAR)}) AS ys FROM t)
  SELECT o_orderkey, j - 1 AS ord, CAST(ys[j] AS INT) AS y FROM y, unnest(range(1, len(ys) + 1)) u(j)""")
def year_extract(m):
    t = m.spark.sql(f"SELECT *, {_DATETEXT} AS text FROM {_ODATES.format(o='{o}')}", o=m.orders)
    return t.select("o_orderkey", F.posexplode(dt.find_years(F.col("text"))).alias("ord", "y"))


_YTEXT = "'From ' || (1800 + o_orderkey % 90) || '–' || (10 + o_orderkey % 80) || ' until the ' || (10 * (160 + o_orderkey % 20)) || 's and the années 1650, in ' || (1700 + o_orderkey % 100) || ' at 10:45, n° ' || o_orderkey || ', on the ' || (1 + o_orderkey % 30) || 'th of 2' || (o_orderkey % 9) || ' days'"
_YSET = f"""list_sort(list_distinct(list_concat(
    list_transform(regexp_extract_all(text, {q(lx.YEAR)}), lambda v: CAST(v AS INT)),
    list_concat(list_transform(regexp_extract_all(text, {q(lx.YEAR_RANGE)}), lambda v: CAST(left(v, 2) || right(v, 2) AS INT)),
      list_transform(regexp_extract_all(text, {q('(?i)' + lx.DECADE)}), lambda v: CAST(regexp_extract(v, '(\\d{{4}})', 1) AS INT))))))"""


@query("year_expand", "", f"WITH t AS (SELECT o_orderkey, {_YTEXT} AS text FROM orders) SELECT o_orderkey, array_to_string({_YSET}, ',') AS years FROM t")
def year_expand(m):
    t = m.orders.selectExpr("o_orderkey", f"{_YTEXT} AS text")
    return t.select("o_orderkey", F.array_join(F.transform(dt.year_set(F.col("text")), lambda v: v.cast("string")), ",").alias("years"))


def _nums(c):
    t = sq.norm(c)
    for i, p in enumerate(lx.CLOCK_TIMES):
        t = f"regexp_replace({t}, {q(p)}, ' ', '{'g' if i == 0 else 'gi'}')"
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({t}, {q('(?i)' + lx.BARE_NUMBER)}), lambda v: CAST(regexp_extract(v, '^(\\d+)', 1) AS INT))))"


@query("bare_numbers", "", f"WITH t AS (SELECT o_orderkey, {_YTEXT} AS text FROM orders) SELECT o_orderkey, array_to_string({_nums('text')}, ',') AS numbers FROM t")
def bare_numbers(m):
    t = m.orders.selectExpr("o_orderkey", f"{_YTEXT} AS text")
    return t.select("o_orderkey", F.array_join(F.transform(dt.bare_numbers(F.col("text")), lambda v: v.cast("string")), ",").alias("numbers"))


# ------------------------------------------------------------------ typography and style
def _x9(src: str) -> str:
    toks = "regexp_extract_all(text, '\\w+|[\\s]+|[^\\w\\s]+')"
    return f"""
  toks AS (SELECT *, {toks} AS tk FROM {src}),
  rep AS (SELECT *, list_filter(range(1, len(tk) - 1), lambda j: len(tk[j]) >= 3 AND regexp_full_match(tk[j], '\\w+') AND regexp_full_match(tk[j + 1], '\\s+') AND lower(tk[j]) = lower(tk[j + 2]))[1] AS at_,
    regexp_extract(text, {q(lx.DOUBLED_PUNCT)}) AS dp FROM toks),
  x AS (SELECT *, tk[at_] AS rw, CASE WHEN dp <> '' THEN instr(text, dp) END AS dpos FROM rep)
  SELECT 'X9' AS "check", 'high' AS sev, card, path, 'markdown syntax in user-visible text' AS msg FROM x WHERE regexp_matches(text, {q(lx.MARKDOWN)})
  UNION ALL SELECT 'X9', 'med', card, path, 'doubled punctuation' FROM x WHERE dp <> '' AND NOT regexp_matches(substring(text, greatest(dpos - 6, 1), least(dpos, 7)), '\\b[A-Za-zÀ-ÿ]{{1,4}}\\.$')
  UNION ALL SELECT 'X9', 'med', card, path, 'repeated word "' || rw || '"' FROM x WHERE rw IS NOT NULL AND lower(rw) NOT IN ({', '.join(q(w) for w in lx.REPEAT_EXEMPT)})
  UNION ALL SELECT 'X9', 'low', card, path, 'space before punctuation (EN)' FROM x WHERE lang = 'en' AND regexp_matches(text, '\\s[,.]')
  UNION ALL SELECT 'X9', 'low', card, path, 'double space' FROM x WHERE regexp_matches(text, '\\s{{2,}}')
  UNION ALL SELECT 'X9', 'med', card, path, 'unbalanced quotation mark' FROM x WHERE len(regexp_extract_all(text, '[“”"]')) % 2 = 1"""


@query("typography", "", f"WITH d AS (SELECT doc_id AS card, 'text' AS path, lang, text FROM documents), {_x9('d')}")
def typography(m):
    return pr.typography(_docs(m))


@query("typography_cards", FN, f"WITH {sq.FIELD}, {_x9('f')}")
def typography_cards(m):
    return pr.typography(cd.fields(m))


_PROC = ", ".join(f"nullif(regexp_extract(text, {q(p)}, 0, 'i'), '')" for p in lx.PROCESS_PHRASES)


@query("process_phrases", FN, f"""WITH {sq.FIELD}, h AS (SELECT *, coalesce({_PROC}) AS hit FROM f WHERE kind IN ('bio', 'mapnote', 'tooltip', 'headline', 'pin', 'union'))
  SELECT 'X10' AS "check", 'low' AS sev, card, path, 'narrates the editing process ("' || hit || '")' AS msg FROM h WHERE hit IS NOT NULL""")
def process_phrases(m):
    return pr.process_phrases(cd.fields(m, pr.PROSE_KINDS))


def _c7(src):
    return f"""
  tt AS (SELECT *, {sq.sentences('text')} AS ss, regexp_extract(text, {q(lx.TOOLTIP_SOURCE)}, 0, 'i') AS hit FROM {src}),
  t AS (SELECT *, len(list_filter(ss, lambda s: regexp_matches(s, {q(lx.TOOLTIP_VERB)}, 'i') OR len(string_split_regex(s, '\\s+')) > 8)) AS n FROM tt)
  SELECT 'C7' AS "check", 'med' AS sev, card, path, 'tooltip is ' || n || ' sentences' AS msg FROM t WHERE n > 1
  UNION ALL SELECT 'C7', 'med', card, path, 'tooltip cites a source ("' || hit || '")' FROM t WHERE hit <> ''
  UNION ALL SELECT 'C7', 'low', card, path, 'tooltip is ' || len(text) || ' characters' FROM t WHERE len(text) > 240"""


@query("tooltip_shape", "", f"WITH d AS (SELECT doc_id AS card, 'text' AS path, text FROM documents), {_c7('d')}")
def tooltip_shape(m):
    return pr.tooltip_shape(_docs(m))


@query("tooltip_cards", FN, f"WITH {sq.FIELD}, n AS (SELECT * FROM f WHERE kind = 'tooltip'), {_c7('n')}")
def tooltip_cards(m):
    return pr.tooltip_shape(cd.fields(m, ["tooltip"]))


_WORDS = "list_filter(string_split_regex(regexp_replace({c}, '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


@query("headline_dup", "person", f"""WITH w AS (SELECT card, {_WORDS.format(c=sq.fold('headline'))} AS h, {_WORDS.format(c=sq.fold('bio[1]'))} AS b FROM person)
  SELECT 'X11' AS "check", 'med' AS sev, card, 'profile.headline' AS path, 'headline repeats the first words of bio[0] verbatim' AS msg FROM w WHERE len(h) >= 3 AND b[1:len(h)] = h""")
def headline_dup(m):
    return pr.headline_dup(m.person)


@query("unused_source", FN, f"""WITH {sq.FIELD},
  p AS (SELECT card, string_agg({sq.fold('text')}, ' ' || chr(10) || ' ') AS prose FROM f WHERE kind IN ('bio', 'mapnote', 'tooltip', 'union', 'pin', 'doccap') GROUP BY card),
  l AS (SELECT card, origin || '[' || pos || ']' AS path, list_filter(string_split_regex({sq.fold('label')}, '[^a-z0-9]+'), lambda w: len(w) > 4) AS ws FROM source WHERE origin IN ('src', 'profile.sources'))
  SELECT 'X12' AS "check", 'low' AS sev, l.card, path, 'source never referenced by any prose on the card' AS msg FROM l JOIN p ON l.card = p.card
  WHERE len(ws) > 0 AND NOT list_bool_or(list_transform(ws, lambda w: contains(prose, w)))""")
def unused_source(m):
    kinds = ["bio", "mapnote", "tooltip", "union", "pin", "doccap"]
    return pr.unused_source(m.person, m.source, cd.fields(m, kinds))


# ------------------------------------------------------------------ parity
def _one_sided(a, b):
    return f"array_to_string(list_sort(list_concat(list_filter({a}, lambda v: NOT list_contains({b}, v)), list_filter({b}, lambda v: NOT list_contains({a}, v)))), ', ')"


@query("pair_parity_missing", FN, f"""WITH {sq.PAIR} SELECT 'C6' AS "check", 'high' AS sev, card, label AS path, 'missing ' || CASE WHEN en IS NULL THEN 'EN' ELSE 'FR' END || ' text' AS msg FROM pair WHERE en IS NULL OR fr IS NULL""")
def pair_parity_missing(m):
    return pr.parity_missing(cd.pairs(m))


def _parity(name, a, b, sev, msg, cond="d <> ''"):
    return f"""WITH {sq.PAIR}, s AS (SELECT card, label, {a} AS a, {b} AS b FROM both_), x AS (SELECT card, label, {_one_sided('a', 'b')} AS d FROM s)
  SELECT 'C6' AS "check", '{sev}' AS sev, card, label AS path, '{msg}' || d AS msg FROM x WHERE d <> ''"""


def _yset(c):
    return _YSET.replace("text", sq.norm(c))


@query("pair_parity_years", FN, _parity("years", _yset("en"), _yset("fr"), "high", "year(s) in one language only: "))
def pair_parity_years(m):
    return pr.parity_years(cd.pairs(m))


@query("pair_parity_numbers", FN, _parity("numbers", _nums("en"), _nums("fr"), "med", "bare number(s) in one language only: "))
def pair_parity_numbers(m):
    return pr.parity_numbers(cd.pairs(m))


@query("pair_parity_sentences", FN, f"""WITH {sq.PAIR}, s AS (SELECT card, label, len({sq.sentences('en')}) AS a, len({sq.sentences('fr')}) AS b FROM both_)
  SELECT 'C6' AS "check", 'low' AS sev, card, label AS path, 'sentence count EN ' || a || ' vs FR ' || b AS msg FROM s WHERE a <> b""")
def pair_parity_sentences(m):
    return pr.parity_sentences(cd.pairs(m))


_TURNS = """turns AS (SELECT u.conv_id * 1000 + u.turn AS card, 'turn' AS label, u.text AS en, a.text AS fr
    FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _turns(m):
    u, a = m.conversations.alias("u"), m.conversations.alias("a")
    return u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)).where(
        (F.col("u.role") == "user") & (F.col("a.role") == "assistant")
    ).select((F.col("u.conv_id") * 1000 + F.col("u.turn")).alias("card"), F.lit("turn").alias("label"), F.lit("bio").alias("kind"), F.col("u.text").alias("en"), F.col("a.text").alias("fr"))


@query("pair_parity_length", FN, f"""WITH {_TURNS}, {sq.PAIR}, b AS (SELECT card, label, en, fr FROM both_ UNION ALL SELECT card, label, en, fr FROM turns WHERE en <> '' AND fr <> '')
  SELECT 'C6' AS "check", 'med' AS sev, card, label AS path, 'length ratio EN/FR ' || CAST(floor(len(en) * 100 / len(fr)) AS BIGINT) || '%' AS msg FROM b
  WHERE len(en) / len(fr) < 0.55 OR len(en) / len(fr) > 1.6""")
def pair_parity_length(m):
    return pr.parity_length(cd.pairs(m).unionByName(_turns(m)))


@query("pair_parity_hedges", FN, f"""WITH {sq.PAIR}, h AS (SELECT card, label, en, fr, {sq.hedged('en', 'en')} AS e, {sq.hedged('fr', 'fr')} AS g FROM both_)
  SELECT 'C6h' AS "check", 'review' AS sev, card, label AS path, 'EN hedges ("' || {sq.first_hedge('en', 'en')} || '") — check the FR carries the same doubt' AS msg FROM h WHERE e AND NOT g
  UNION ALL SELECT 'C6h', 'review', card, label, 'FR hedges ("' || {sq.first_hedge('fr', 'fr')} || '") — check the EN carries the same doubt' FROM h WHERE g AND NOT e""")
def pair_parity_hedges(m):
    return pr.parity_hedges(cd.pairs(m))


_LE = "concat_ws(', ', " + ", ".join(f"CASE WHEN regexp_matches(en, {q(e)}, 'i') AND NOT regexp_matches(fr, {q(f)}, 'i') THEN '{k}' END" for k, e, f in lx.LOADED_WORDS) + ")"
_LF = "concat_ws(', ', " + ", ".join(f"CASE WHEN regexp_matches(fr, {q(f)}, 'i') AND NOT regexp_matches(en, {q(e)}, 'i') THEN '{k}' END" for k, e, f in lx.LOADED_WORDS) + ")"


@query("pair_parity_words", FN, f"""WITH {sq.PAIR}, w AS (SELECT card, label, {_LE} AS a, {_LF} AS b FROM both_)
  SELECT 'C6h' AS "check", 'review' AS sev, card, label AS path, 'load-bearing word(s) matched in one language only — EN: ' || CASE WHEN a = '' THEN '—' ELSE a END || ' | FR: ' || CASE WHEN b = '' THEN '—' ELSE b END AS msg FROM w WHERE a <> '' OR b <> ''""")
def pair_parity_words(m):
    return pr.parity_words(cd.pairs(m))


_PROPS = "list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace({c}, '[^A-Za-zÀ-ÿ]+', '  ', 'g'), '(?:^| )[A-ZÀ-Ý][a-zà-ÿ]{{3,}}(?: |$)'), lambda v: v <> ''), lambda v: lower(strip_accents(trim(v)))))"
_COMMON = ", ".join(q(w) for w in [*lx.COMMON_NAMES, *lx.STOPWORDS, *lx.MONTH_WORDS])


@query("pair_parity_names", FN, f"""WITH {sq.PAIR},
  known AS (SELECT DISTINCT lower(strip_accents(w)) AS token FROM (SELECT unnest(string_split_regex(s, '[^A-Za-zÀ-ÿ]+')) AS w FROM (SELECT name AS s FROM person UNION ALL SELECT s FROM union_)) WHERE len(w) > 3 AND lower(strip_accents(w)) NOT IN ({_COMMON})),
  tk AS (SELECT card, label, 'e' AS side, unnest({_PROPS.format(c=sq.norm('en'))}) AS token FROM both_ UNION ALL SELECT card, label, 'f', unnest({_PROPS.format(c=sq.norm('fr'))}) FROM both_),
  p AS (SELECT card, label, coalesce(list(token) FILTER (side = 'e'), []) AS e, coalesce(list(token) FILTER (side = 'f'), []) AS g FROM tk WHERE token IN (SELECT token FROM known) GROUP BY card, label),
  o AS (SELECT card, label, array_to_string(list_sort(list_filter(e, lambda v: NOT list_contains(list_transform(g, lambda z: left(z, 4)), left(v, 4))))[1:6], ', ') AS a,
    array_to_string(list_sort(list_filter(g, lambda v: NOT list_contains(list_transform(e, lambda z: left(z, 4)), left(v, 4))))[1:6], ', ') AS b FROM p)
  SELECT 'C6' AS "check", 'med' AS sev, card, label AS path, 'name(s) present in one language only — EN: ' || CASE WHEN a = '' THEN '—' ELSE a END || ' | FR: ' || CASE WHEN b = '' THEN '—' ELSE b END AS msg FROM o WHERE a <> '' OR b <> ''""")
def pair_parity_names(m):
    return pr.parity_names(cd.pairs(m), pr.known_names(m.person, m.union_))


# ------------------------------------------------------------------ doubt
@query("hedge_hits", FN, f"""WITH {sq.FIELD}, {sq.UNIT}
  SELECT card, path, ord, {sq.first_hedge('sentence', 'en')} AS first_hit FROM unit WHERE lang = 'en' AND {sq.hedged('sentence', 'en')}
  UNION ALL SELECT card, path, ord, {sq.first_hedge('sentence', 'fr')} FROM unit WHERE lang = 'fr' AND {sq.hedged('sentence', 'fr')}""")
def hedge_hits(m):
    hits = tx.hedge_hits(F.col("sentence"), F.col("lang"))
    return cd.units(cd.fields(m)).select("card", "path", "ord", F.explode(F.slice(hits, 1, 1)).alias("first_hit"))


@query("negation_window", FN, f"""WITH {sq.FIELD}, {sq.UNIT},
  h AS (SELECT card, path, ord, {sq.norm('sentence')} AS t, regexp_extract({sq.norm('sentence')}, {q(lx.SOURCE_TYPES[0][1])}, 0, 'i') AS hit FROM unit WHERE kind IN ('tooltip', 'mapnote', 'headline', 'bio', 'union', 'pin')),
  w AS (SELECT card, path, ord, hit, substring(t, greatest(instr(t, hit) - 60, 1), instr(t, hit) - greatest(instr(t, hit) - 60, 1) + len(hit) + 45) AS win FROM h WHERE hit <> '')
  SELECT card, path, ord, hit, regexp_matches(win, {q(lx.NEGATOR_EN)}, 'i') OR regexp_matches(win, {q(lx.NEGATOR_FR)}, 'i') AS negated FROM w""")
def negation_window(m):
    p = lx.SOURCE_TYPES[0][1]
    u = cd.units(cd.fields(m, ["tooltip", "mapnote", "headline", "bio", "union", "pin"]))
    u = u.where(rx.matches(tx.norm(F.col("sentence")), p))
    return u.select("card", "path", "ord", rx.first_match(tx.norm(F.col("sentence")), p).alias("hit"), tx.negated(F.col("sentence"), p).alias("negated"))


_STOP = ", ".join(q(w) for w in lx.STOPWORDS)
_MONTHSQ = ", ".join(q(w) for w in lx.MONTH_WORDS)
_TOPIC = ", ".join(q(w) for w in sorted(set(lx.TOPIC_WORDS)))


def _tokens(src, key):
    """Token rows (key columns, token, w) of sentences in ``src``."""
    return f"""
  words0 AS (SELECT {key}, list_filter(string_split_regex({sq.norm('sentence')}, '[^A-Za-zÀ-ÿ''’-]+'), lambda v: v <> '') AS ws FROM {src}),
  words AS (SELECT {key}, j, ws[j] AS w, regexp_replace(ws[j], '[''’-].*$', '') AS bare FROM words0, unnest(range(1, len(ws) + 1)) u(j)),
  dts AS (SELECT {key}, unnest(regexp_extract_all({sq.norm('sentence')}, {q('(?i)' + lx.DATE)})) AS raw FROM {src}),
  tok0 AS (
    SELECT {key}, 'N' || lower(strip_accents(bare)) AS token, CASE WHEN j = 1 THEN 1 ELSE 2 END AS w FROM words WHERE len(bare) >= 3 AND regexp_matches(bare, '^[A-ZÀ-Ý]') AND lower(bare) NOT IN ({_STOP}) AND lower(bare) NOT IN ({_MONTHSQ})
    UNION ALL SELECT {key}, 'T' || lower(strip_accents(w)), 2 FROM words WHERE len(bare) >= 3 AND lower(strip_accents(w)) IN ({_TOPIC})
    UNION ALL SELECT {key}, 'Y' || unnest(regexp_extract_all({sq.norm('sentence')}, {q(lx.YEAR)})), 3 FROM {src}
    UNION ALL SELECT {key}, 'D' || CAST(regexp_extract(raw, '(\\d{{3,4}})$', 1) AS INT) || '-' || {_month_sql('raw')} || '-' || CAST(regexp_extract(raw, '^(\\d{{1,2}})', 1) AS INT), 5 FROM dts),
  tok AS (SELECT {key}, token, max(w) AS w FROM tok0 GROUP BY {key}, token)"""


def _month_sql(c):
    stem = f"left(lower(strip_accents(regexp_extract({c}, '([A-Za-zÀ-ÿ]{{3,}})', 1))), 4)"
    return f"CASE {stem} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dt._MONTHS.items()) + " END"


@query("weighted_tokens", "", f"""WITH s0 AS (SELECT doc_id, {sq.sentences('text')} AS ss FROM documents), s AS (SELECT doc_id, j - 1 AS ord, ss[j] AS sentence FROM s0, unnest(range(1, len(ss) + 1)) u(j)),
  {_tokens('s', 'doc_id, ord')} SELECT doc_id, ord, token, w FROM tok""")
def weighted_tokens(m):
    s = m.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence"))
    return pr.token_rows(pr.token_bags(s), "doc_id", "ord")


@query("hedge_vs_flat", FN, f"""WITH {sq.FIELD}, {sq.UNIT},
  un AS (SELECT *, CASE WHEN lang = 'fr' THEN {sq.hedged('sentence', 'fr')} ELSE {sq.hedged('sentence', 'en')} END AS h, kind IN ('tooltip', 'mapnote', 'headline', 'pin', 'union') AS short FROM unit WHERE kind NOT IN ('srclabel', 'psource', 'doctr', 'srcquote')),
  {_tokens('un', 'card, path, ord')},
  pr AS (SELECT a.card, a.path AS pa, a.ord AS oa, b.path AS pb, b.ord AS ob, sum(least(ta.w, tb.w)) AS score,
      count(*) FILTER (left(ta.token, 1) = 'D') AS nd, count(*) FILTER (left(ta.token, 1) = 'Y') AS ny, count(*) FILTER (left(ta.token, 1) = 'N') AS nn, count(*) FILTER (left(ta.token, 1) = 'T') AS nt
    FROM un a JOIN un b ON a.card = b.card AND a.lang = b.lang AND a.path <> b.path AND a.h AND NOT b.h AND NOT b.alt AND (a.short OR b.short) AND b.kind NOT IN ('doccap')
      AND regexp_matches(b.sentence, {q(lx.ASSERTIVE)}, 'i')
    JOIN tok ta ON ta.card = a.card AND ta.path = a.path AND ta.ord = a.ord JOIN tok tb ON tb.card = b.card AND tb.path = b.path AND tb.ord = b.ord AND tb.token = ta.token
    GROUP BY ALL),
  ok AS (SELECT *, row_number() OVER (PARTITION BY card, pa, pb ORDER BY oa, ob) AS rn FROM pr WHERE (nd >= 1 OR (ny >= 1 AND nn >= 1) OR nn >= 2) AND nt >= 1 AND score >= 10)
  SELECT 'C1' AS "check", CASE WHEN score >= 12 THEN 'high' ELSE 'med' END AS sev, ok.card, pa || ' ↔ ' || pb AS path,
    'hedged in ' || pa || ' ("' || CASE WHEN lang = 'fr' THEN {sq.first_hedge('sentence', 'fr')} ELSE {sq.first_hedge('sentence', 'en')} END || '") but stated flat in ' || pb AS msg
  FROM ok JOIN un ON un.card = ok.card AND un.path = pa AND un.ord = oa WHERE rn = 1""")
def hedge_vs_flat(m):
    return pr.hedge_vs_flat(cd.fields(m))
