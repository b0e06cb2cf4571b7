"""SQL fragments the checking queries share: fields, pairs, sentence split, patterns."""

from __future__ import annotations

from claimcheck.functions import lexicon as lx


def q(pattern: str) -> str:
    """Pattern as a SQL string literal in the checking database's dialect."""
    return "'" + pattern.replace("'", "''") + "'"


NORM = "translate({c}, chr(160) || chr(8239) || '‘’“”', '  ''''\"\"')"
WS = "' ' || chr(9) || chr(10) || chr(13)"


def norm(c: str) -> str:
    return NORM.format(c=c)


def fold(c: str) -> str:
    return f"lower(strip_accents({norm(c)}))"


_GAP = r"""([.!?])\s*["'»)\]]?\s+([A-ZÀ-Ý"'«(—])"""


def sentences(c: str) -> str:
    abbr = r"\b(" + "|".join(lx.ABBREVIATIONS) + r")\."
    held = (
        f"regexp_replace(regexp_replace(trim({norm(c)}, {WS}), {q(chr(92) + 'b([A-Z])' + chr(92) + '.')}, '\\1' || chr(3), 'g'), "
        f"{q(abbr)}, '\\1' || chr(3), 'gi')"
    )
    cut = f"regexp_replace({held}, {q(_GAP)}, '\\1' || chr(4) || '\\2', 'g')"
    return (
        f"list_filter(list_transform(string_split({cut}, chr(4)), "
        f"lambda zz: trim(replace(zz, chr(3), '.'), {WS})), lambda zz: zz <> '')"
    )


def any_of(c: str, literals: list[str], shapes: list[str]) -> str:
    import re

    pattern = "|".join([*[re.escape(h).replace("\\ ", " ") for h in literals], *shapes])
    return f"regexp_matches({c}, {q(pattern)}, 'i')"


def hedged(c: str, lang: str) -> str:
    if lang == "fr":
        return f"({any_of(fold(c), lx.HEDGE_FR, lx.HEDGE_FR_SHAPES)} AND NOT regexp_matches({fold(c)}, {q(lx.SUPPORTING_NEGATIVE_FR)}, 'i'))"
    return f"({any_of(fold(c), lx.HEDGE_EN, lx.HEDGE_EN_SHAPES)} AND NOT regexp_matches({fold(c)}, {q(lx.SUPPORTING_NEGATIVE_EN)}, 'i'))"


def first_hedge(c: str, lang: str) -> str:
    lits, shapes = (
        (lx.HEDGE_FR, lx.HEDGE_FR_SHAPES) if lang == "fr" else (lx.HEDGE_EN, lx.HEDGE_EN_SHAPES)
    )
    whens = " ".join(f"WHEN contains(hz, {q(h)}) THEN {q(h)}" for h in lits)
    shaped = ", ".join(f"nullif(regexp_extract(hz, {q(p)}, 0, 'i'), '')" for p in shapes)
    return f"(SELECT CASE {whens} ELSE coalesce({shaped}) END FROM (SELECT {fold(c)} AS hz))"


FIELD = """field AS (
  SELECT card, 'note' AS path, 'en' AS lang, 'tooltip' AS kind, note AS text, CAST(NULL AS BIGINT) AS i, false AS alt FROM person
  UNION ALL SELECT card, 'note_fr', 'fr', 'tooltip', note_fr, NULL, false FROM person
  UNION ALL SELECT card, 'mn', 'en', 'mapnote', mn, NULL, false FROM person
  UNION ALL SELECT card, 'mn_fr', 'fr', 'mapnote', mn_fr, NULL, false FROM person
  UNION ALL SELECT card, 'profile.headline', 'en', 'headline', headline, NULL, false FROM person
  UNION ALL SELECT card, 'profile.headline_fr', 'fr', 'headline', headline_fr, NULL, false FROM person
  UNION ALL SELECT card, 'bio[' || (j - 1) || ']', 'en', 'bio', bio[j], j - 1, false FROM person, unnest([1, 2, 3]) u(j)
  UNION ALL SELECT card, 'bio_fr[' || (j - 1) || ']', 'fr', 'bio', bio_fr[j], j - 1, false FROM person, unnest([1, 2, 3]) u(j)
  UNION ALL SELECT card, 'src[' || pos || '].l', 'en', 'srclabel', label, pos, false FROM source WHERE origin = 'src'
  UNION ALL SELECT card, 'src[' || pos || '].q', 'en', 'srcquote', quote, pos, false FROM source WHERE origin = 'src' AND quote IS NOT NULL
  UNION ALL SELECT card, 'profile.sources[' || pos || '].label', 'en', 'psource', label, pos, false FROM source WHERE origin = 'profile.sources'
  UNION ALL SELECT card, 'profile.sources[' || pos || '].label_fr', 'fr', 'psource', label_fr, pos, false FROM source WHERE origin = 'profile.sources'
  UNION ALL SELECT card, 'docs[' || pos || '].cap', 'en', 'doccap', cap, pos, false FROM doc
  UNION ALL SELECT card, 'docs[' || pos || '].cap_fr', 'fr', 'doccap', cap_fr, pos, false FROM doc WHERE cap_fr IS NOT NULL
  UNION ALL SELECT card, 'docs[' || pos || '].tr', 'en', 'doctr', tr, pos, false FROM doc
  UNION ALL SELECT card, 'docs[' || pos || '].tr_fr', 'fr', 'doctr', tr_fr, pos, false FROM doc
  UNION ALL SELECT card, 'union[' || union_idx || '].n', 'en', 'union', n, union_idx, false FROM union_ WHERE n IS NOT NULL
  UNION ALL SELECT card, 'union[' || union_idx || '].n_fr', 'fr', 'union', n_fr, union_idx, false FROM union_ WHERE n_fr IS NOT NULL
  UNION ALL SELECT card, 'pl[' || pos || '].w', 'en', 'pin', w, pos, x FROM event WHERE w IS NOT NULL
  UNION ALL SELECT card, 'pl[' || pos || '].w_fr', 'fr', 'pin', w_fr, pos, x FROM event WHERE w_fr IS NOT NULL),
  f AS (SELECT * FROM field WHERE text IS NOT NULL)"""
FIELD_NEEDS = "person source doc union_ event"
PAIR = """pair AS (SELECT * FROM (
  SELECT card, 'note' AS label, 'tooltip' AS kind, note AS en, note_fr AS fr FROM person
  UNION ALL SELECT card, 'mn', 'mapnote', mn, mn_fr FROM person
  UNION ALL SELECT card, 'headline', 'headline', headline, headline_fr FROM person
  UNION ALL SELECT card, 'bio[' || (j - 1) || ']', 'bio', bio[j], bio_fr[j] FROM person, unnest([1, 2, 3]) u(j)
  UNION ALL SELECT card, 'profile.sources[' || pos || ']', 'psource', label, label_fr FROM source WHERE origin = 'profile.sources'
  UNION ALL SELECT card, 'docs[' || pos || '].cap', 'doccap', cap, cap_fr FROM doc
  UNION ALL SELECT card, 'docs[' || pos || '].tr', 'doctr', tr, tr_fr FROM doc
  UNION ALL SELECT card, 'union[' || union_idx || '].n', 'union', n, n_fr FROM union_
  UNION ALL SELECT card, 'pl[' || pos || '].w', 'pin', w, w_fr FROM event) z WHERE en IS NOT NULL OR fr IS NOT NULL),
  both_ AS (SELECT * FROM pair WHERE en IS NOT NULL AND fr IS NOT NULL)"""
EVIDENCE = """evidence AS (
  SELECT card, 'src[' || pos || ']' AS path, concat_ws(' ', label, url) AS text FROM source WHERE origin = 'src'
  UNION ALL SELECT card, 'profile.sources[' || pos || ']', concat_ws(' ', label, label_fr, url) FROM source WHERE origin = 'profile.sources'
  UNION ALL SELECT card, 'docs[' || pos || ']', concat_ws(' ', cap, cap_fr, u, tr) FROM doc)"""
UNIT = f"""unit0 AS (SELECT card, path, lang, kind, i, alt, text, {sentences('text')} AS ss FROM f),
  unit AS (SELECT card, path, lang, kind, i, alt, text, j - 1 AS ord, ss[j] AS sentence FROM unit0, unnest(range(1, len(ss) + 1)) u(j))"""
