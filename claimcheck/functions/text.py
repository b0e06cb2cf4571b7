"""Text functions over Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx

BLANKS = " \t\n\r\u000b\f\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def norm(c: Column) -> Column:
    """Fold no-break spaces and curly quotes; a text without any is only searched, not built anew character by character."""
    for odd, plain in zip("\u00a0\u202f\u2018\u2019\u201c\u201d", "  \'\'\"\""):
        c = F.replace(c, F.lit(odd), F.lit(plain))
    return c


def _accent_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(
            ch for ch in unicodedata.normalize("NFD", chr(cp)) if not 0x0300 <= ord(ch) <= 0x036F
        )
        if base != chr(cp) and len(base) == 1:
            src.append(chr(cp))
            dst.append(base)
    marks = "".join(chr(c) for c in range(0x0300, 0x0370))
    return "".join(src) + marks, "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def deaccent(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def deaccent_str(s: str) -> str:
    return "".join(
        ch for ch in unicodedata.normalize("NFD", s) if not 0x0300 <= ord(ch) <= 0x036F
    )


def fold(c: Column) -> Column:
    return F.lower(deaccent(norm(c)))


_DOT, _CUT = "\u0003", "\u0004"


def sentences(c: Column) -> Column:
    """Split into sentences; initials and known abbreviations keep their dot."""
    # what stands before a gap is looked at once there; a part begins and ends with a mark or letter, so only the text is stripped
    end = lx.SENTENCE_GAP[: lx.SENTENCE_GAP.index(")") + 1]
    short = r"(?<!\b[A-Z]\.)(?<!\b(?iu:" + "|".join(lx.ABBREVIATIONS) + r")\.)"
    gap = rx.java(end + short + lx.SENTENCE_GAP.removeprefix(end), ignore_case=False)

    def split(t):
        def dots(x):
            return F.replace(x, F.lit(_DOT), F.lit("."))

        # a split at one plain character needs no pattern, which a split compiles for every row
        parts = F.split(dots(F.regexp_replace(t, gap, _CUT)), _CUT)
        parts = F.when(F.contains(t, F.lit(_CUT)), F.transform(F.split(t, gap), dots)).otherwise(parts)
        return F.when(t != "", parts).when(t == "", F.array().cast("array<string>"))

    return let(strip(norm(c)), split)


def clauses(c: Column) -> Column:
    return F.flatten(
        F.transform(sentences(c), lambda s: F.split(s, rx.java(r"\s*[;—]\s*", False)))
    )


def number_of(word: Column, strict: bool = False) -> Column:
    """Digits or English number words to an int; null when any part is unknown.

    Parts are added ("thirty-eight" = 38, "one hundred" = 101); ``strict`` multiplies by a
    following "hundred" instead.
    """
    low = F.translate(F.lower(word), "–—", "--")
    values = F.create_map(*[F.lit(v) for kv in lx.NUMBER_WORDS.items() for v in kv])
    parts = F.filter(F.split(low, rx.java(r"[-\s]+", False)), lambda p: p != "")
    looked_up = F.transform(parts, lambda p: F.try_element_at(values, p))
    if strict:
        total = F.aggregate(
            looked_up,
            F.lit(0),
            lambda a, v: F.when(v == 100, F.greatest(a, F.lit(1)) * 100).otherwise(a + v),
        )
    else:
        total = F.aggregate(looked_up, F.lit(0), lambda a, v: a + v)
    return F.when(low.rlike(r"^\d+$"), low.try_cast("int")).otherwise(
        F.when(F.size(parts) > 0, total)
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a lambda variable is not recomputed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hedge_hits(c: Column, lang: Column) -> Column:
    """Every doubt phrase found; empty when a supporting negative is present."""

    none = F.slice(F.array(F.lit("")), 1, 0)

    def hits(literals, patterns, support):
        lits = F.array(*[F.lit(h) for h in literals])

        def in_text(t):
            shapes = F.filter(F.array(*[rx.first_match(t, p) for p in patterns]), lambda m: m != "")
            # one pattern of all shapes tells whether any is there to be found
            shapes = F.when(rx.matches(t, "|".join(patterns)), shapes).otherwise(none)
            return F.when(~rx.matches(t, support), F.concat(F.filter(lits, lambda h: F.contains(t, h)), shapes))

        return let(fold(c), in_text)

    en = hits(lx.HEDGE_EN, lx.HEDGE_EN_SHAPES, lx.SUPPORTING_NEGATIVE_EN)
    fr = hits(lx.HEDGE_FR, lx.HEDGE_FR_SHAPES, lx.SUPPORTING_NEGATIVE_FR)
    return F.coalesce(F.when(lang == "fr", fr).otherwise(en), none)


def is_hedged(c: Column, lang: Column) -> Column:
    """Same decision as ``hedge_hits`` without building the list: plain substring tests first,
    then one regex in which all shapes share their leading word boundary."""

    def any_of(literals, shapes, support):
        tails = "|".join(f"(?:{p.removeprefix(chr(92) + 'b')})" for p in shapes)

        def test(t):
            found = F.contains(t, F.lit(literals[0]))
            for h in literals[1:]:
                found = found | F.contains(t, F.lit(h))
            return (found | rx.matches(t, rf"\b(?:{tails})")) & ~rx.matches(t, support)

        return let(fold(c), test)

    en = any_of(lx.HEDGE_EN, lx.HEDGE_EN_SHAPES, lx.SUPPORTING_NEGATIVE_EN)
    fr = any_of(lx.HEDGE_FR, lx.HEDGE_FR_SHAPES, lx.SUPPORTING_NEGATIVE_FR)
    return F.coalesce(F.when(lang == "fr", fr).otherwise(en), F.lit(False))


def negated(sentence: Column, pattern: str) -> Column:
    """A negator within 60 characters before or 45 after the first match of ``pattern``."""
    t = norm(sentence)
    hit = rx.first_match(t, pattern)
    at = F.instr(t, hit)
    begin = F.greatest(at - 60, F.lit(1))
    window = F.substring(t, begin, at - begin + F.length(hit) + 45)
    return (hit != "") & (rx.matches(window, lx.NEGATOR_EN) | rx.matches(window, lx.NEGATOR_FR))


def html_text(c: Column) -> Column:
    return rx.replace(rx.replace(c, r"<script[\s\S]*?</script>", " "), r"<[^>]+>", " ")


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), "\n", " ")


def names_in(c: Column) -> Column:
    """Folded capitalised words of four letters or more."""
    words = F.regexp_extract_all(
        norm(c), F.lit(r"(?<![A-Za-zÀ-ÿ])[A-ZÀ-Ý][a-zà-ÿ]{3,}(?![A-Za-zÀ-ÿ])"), F.lit(0)
    )
    stop = F.array(*[F.lit(w) for w in sorted({*lx.STOPWORDS, *lx.MONTH_WORDS})])
    return F.array_except(
        F.array_distinct(F.transform(words, lambda w: F.lower(deaccent(w)))), stop
    )
