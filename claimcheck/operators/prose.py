"""Rules over text fields: typography, style, parity between languages, doubt against certainty.

All rules here are row-local over ``fields``/``pairs``/``units`` except the three that need a
second input (names known to the data set, source labels, and the other sentences of a card).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions import dates as dt
from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx
from claimcheck.functions import text as tx
from claimcheck.operators import cards as cd
from claimcheck.operators.structure import emit, s
from claimcheck.session import cut_lineage, small_side


# ------------------------------------------------------------------ typography and style
def typography(fields: DataFrame) -> DataFrame:
    t = F.col("text")
    dp = rx.first_match(t, lx.DOUBLED_PUNCT, ignore_case=False)
    at = F.instr(t, dp)
    before = F.substring(t, F.greatest(at - 6, F.lit(1)), F.least(at, F.lit(7)))
    abbrev = before.rlike(rx.java(r"\b[A-Za-zÀ-ÿ]{1,4}\.\z", False))
    rw = rx.first_match(t, r"\b(\w{3,})\s+\1\b", 1)
    quotes = F.length(t) - F.length(F.translate(t, "“”\"", ""))
    return emit(
        fields,
        [
            (rx.matches(t, lx.MARKDOWN, False), "X9", "high", F.col("path"), "markdown syntax in user-visible text"),
            ((dp != "") & ~abbrev, "X9", "med", F.col("path"), "doubled punctuation"),
            ((rw != "") & ~F.lower(rw).isin(*lx.REPEAT_EXEMPT), "X9", "med", F.col("path"), F.concat(F.lit('repeated word "'), rw, F.lit('"'))),
            ((F.col("lang") == "en") & rx.matches(t, r"\s[,.]", False), "X9", "low", F.col("path"), "space before punctuation (EN)"),
            (rx.matches(t, r"\s{2,}", False), "X9", "low", F.col("path"), "double space"),
            (quotes % 2 == 1, "X9", "med", F.col("path"), "unbalanced quotation mark"),
        ],
    )


PROSE_KINDS = ["bio", "mapnote", "tooltip", "headline", "pin", "union"]


def process_phrases(fields: DataFrame) -> DataFrame:
    """Text that narrates the editing process: the first pattern of the list that matches."""
    t = F.col("text")
    hit = F.coalesce(*[F.nullif(rx.first_match(t, p), F.lit("")) for p in lx.PROCESS_PHRASES])
    any_hit = rx.matches(t, "|".join(lx.PROCESS_PHRASES))
    return emit(
        fields.where(F.col("kind").isin(PROSE_KINDS) & any_hit),
        [(F.lit(True), "X10", "low", F.col("path"), F.concat(F.lit('narrates the editing process ("'), hit, F.lit('")')))],
    )


def tooltip_shape(tooltips: DataFrame) -> DataFrame:
    t = F.col("text")
    spoken = F.filter(
        tx.sentences(t),
        lambda x: x.rlike(rx.java(lx.TOOLTIP_VERB)) | (F.size(F.split(x, rx.java(r"\s+", False))) > 8),
    )
    n = F.size(spoken)
    cited = rx.first_match(t, lx.TOOLTIP_SOURCE)
    return emit(
        tooltips.withColumn("_n", n),
        [
            (F.col("_n") > 1, "C7", "med", F.col("path"), F.concat(F.lit("tooltip is "), s("_n"), F.lit(" sentences"))),
            (cited != "", "C7", "med", F.col("path"), F.concat(F.lit('tooltip cites a source ("'), cited, F.lit('")'))),
            (F.length(t) > 240, "C7", "low", F.col("path"), F.concat(F.lit("tooltip is "), s(F.length(t)), F.lit(" characters"))),
        ],
    )


def headline_dup(person: DataFrame) -> DataFrame:
    def words(c):
        flat = F.regexp_replace(tx.fold(c), "[^a-z0-9 ]", " ")
        return F.filter(F.split(flat, r"\s+"), lambda w: w != "")

    h, b = words(F.col("headline")), words(F.get("bio", F.lit(0)))
    same = F.slice(b, 1, F.size(h)) == h
    return emit(
        person.where(F.col("headline").isNotNull()),
        [((F.size(h) >= 3) & same, "X11", "med", "profile.headline", "headline repeats the first words of bio[0] verbatim")],
    )


GRAM = 5


def unused_source(person: DataFrame, source: DataFrame, fields: DataFrame) -> DataFrame:
    """Sources of which no label word (5+ letters) occurs anywhere in the card's prose.

    A label word may occur inside a longer word, so prose words are cut into 5-letter grams and
    met by the label word's own first gram; only words sharing a gram are compared.
    """
    has_bio = person.where(F.size(F.coalesce("bio", F.array().cast("array<string>"))) > 0).select("card")
    labels = (
        source.where(F.col("origin").isin("src", "profile.sources") & (F.col("label") != ""))
        .join(has_bio, "card", "left_semi")
        .select(
            "card",
            F.format_string("%s[%d]", "origin", "pos").alias("path"),
            F.array_except(
                F.filter(F.split(tx.fold(F.col("label")), "[^a-z0-9]+"), lambda w: F.length(w) > 4),
                F.array(*[F.lit(w) for w in lx.STOPWORDS]),
            ).alias("words"),
        )
        .where(F.size("words") > 0)
    )
    asked = labels.select("card", "path", F.explode("words").alias("w")).withColumn(
        "gram", F.substring("w", 1, GRAM)
    )
    kinds = ["bio", "mapnote", "tooltip", "union", "pin", "doccap"]
    prose = fields.where(F.col("kind").isin(kinds)).join(
        labels.select("card").distinct(), "card", "left_semi"
    )
    words = prose.select(
        "card", F.explode(F.array_distinct(F.split(tx.fold(F.col("text")), "[^a-z0-9]+"))).alias("word")
    ).where(F.length("word") >= GRAM)
    grams = words.distinct().select(
        "card",
        "word",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length("word") - (GRAM - 1)),
                    lambda i: F.substring(F.col("word"), i, F.lit(GRAM)),
                )
            )
        ).alias("gram"),
    )
    used = (
        asked.join(grams, ["card", "gram"])
        .where(F.contains("word", F.col("w")))
        .select("card", "path")
        .distinct()
    )
    return emit(
        labels.join(used, ["card", "path"], "left_anti"),
        [(F.lit(True), "X12", "low", F.col("path"), "source never referenced by any prose on the card")],
    )


# ------------------------------------------------------------------ parity
def _both(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.coalesce("en", F.lit("")) != "") & (F.coalesce("fr", F.lit("")) != ""))


def _one_sided(pairs: DataFrame, values) -> DataFrame:
    """(card, label, _d): values found on one side of a pair only, sorted and joined."""
    df = _both(pairs).select("card", "label", values(F.col("en")).alias("a"), values(F.col("fr")).alias("b"))
    diff = F.array_sort(F.array_union(F.array_except("a", "b"), F.array_except("b", "a")))
    return df.select("card", "label", F.array_join(F.transform(diff, lambda v: v.cast("string")), ", ").alias("_d"))


def parity_missing(pairs: DataFrame) -> DataFrame:
    en, fr = F.coalesce("en", F.lit("")), F.coalesce("fr", F.lit(""))
    return emit(
        pairs,
        [((en == "") | (fr == ""), "C6", "high", F.col("label"), F.concat(F.lit("missing "), F.when(en == "", "EN").otherwise("FR"), F.lit(" text")))],
    )


def parity_years(pairs: DataFrame) -> DataFrame:
    df = _one_sided(pairs, dt.year_set)
    return emit(df, [(F.col("_d") != "", "C6", "high", F.col("label"), F.concat(F.lit("year(s) in one language only: "), "_d"))])


def parity_numbers(pairs: DataFrame) -> DataFrame:
    df = _one_sided(pairs, dt.bare_numbers)
    return emit(df, [(F.col("_d") != "", "C6", "med", F.col("label"), F.concat(F.lit("bare number(s) in one language only: "), "_d"))])


def parity_sentences(pairs: DataFrame) -> DataFrame:
    df = _both(pairs).select(
        "card", "label", F.size(tx.sentences(F.col("en"))).alias("a"), F.size(tx.sentences(F.col("fr"))).alias("b")
    )
    return emit(df, [(F.col("a") != F.col("b"), "C6", "low", F.col("label"), F.concat(F.lit("sentence count EN "), s("a"), F.lit(" vs FR "), s("b")))])


def parity_length(pairs: DataFrame) -> DataFrame:
    a, b = F.length("en"), F.length("fr")
    odd = (a / b < 0.55) | (a / b > 1.6)
    return emit(_both(pairs), [(odd, "C6", "med", F.col("label"), F.concat(F.lit("length ratio EN/FR "), s(F.floor(a * 100 / b)), F.lit("%")))])


def parity_hedges(pairs: DataFrame) -> DataFrame:
    df = _both(pairs).select(
        "card",
        "label",
        F.get(tx.hedge_hits(F.col("en"), F.lit("en")), F.lit(0)).alias("e"),
        F.get(tx.hedge_hits(F.col("fr"), F.lit("fr")), F.lit(0)).alias("f"),
    )
    e, f = F.col("e"), F.col("f")
    return emit(
        df,
        [
            (e.isNotNull() & f.isNull(), "C6h", "review", F.col("label"), F.concat(F.lit('EN hedges ("'), e, F.lit('") — check the FR carries the same doubt'))),
            (f.isNotNull() & e.isNull(), "C6h", "review", F.col("label"), F.concat(F.lit('FR hedges ("'), f, F.lit('") — check the EN carries the same doubt'))),
        ],
    )


def parity_words(pairs: DataFrame) -> DataFrame:
    """Load-bearing word classes matched on one side only."""
    words = [k for k, _, _ in lx.LOADED_WORDS]
    flagged = _both(pairs).select(
        "card", "label",
        *[c for k, e, f in lx.LOADED_WORDS for c in (rx.matches(F.col("en"), e).alias(f"en {k}"), rx.matches(F.col("fr"), f).alias(f"fr {k}"))],
    )

    def only(side, other):
        return F.concat_ws(", ", *[F.when(F.col(f"`{side} {k}`") & ~F.col(f"`{other} {k}`"), F.lit(k)) for k in words])

    df = flagged.select("card", "label", only("en", "fr").alias("a"), only("fr", "en").alias("b"))

    def shown(c):
        return F.when(F.col(c) == "", "—").otherwise(F.col(c))

    return emit(
        df,
        [((F.col("a") != "") | (F.col("b") != ""), "C6h", "review", F.col("label"), F.concat(F.lit("load-bearing word(s) matched in one language only — EN: "), shown("a"), F.lit(" | FR: "), shown("b")))],
    )


def known_names(person: DataFrame, union_: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Distinct folded name words of four or more letters, common words removed."""
    raw = person.select(F.col("name").alias("s")).unionByName(union_.select("s"))
    words = raw.select(F.explode(F.split(F.col("s"), "[^A-Za-zÀ-ÿ]+")).alias("w"))
    folded = words.select(F.lower(tx.deaccent(F.col("w"))).alias("token"))
    return folded.where(
        (F.length("token") > 3) & ~F.col("token").isin(*(lx.COMMON_NAMES + list(exclude or [])))
    ).distinct()


def parity_names(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Known names present on one side only, ignoring words that share four leading letters."""

    def side(c):
        return _both(pairs).select(
            "card", "label", F.lit(c).alias("side"), F.explode(tx.names_in(F.col(c))).alias("token")
        )

    hits = side("en").unionByName(side("fr")).join(small_side(known), "token", "left_semi")
    per = hits.groupBy("card", "label").agg(
        F.collect_set(F.when(F.col("side") == "en", F.col("token"))).alias("e"),
        F.collect_set(F.when(F.col("side") == "fr", F.col("token"))).alias("f"),
    )

    def alone(a, b):
        near = F.filter(
            F.array_except(F.col(a), F.col(b)),
            lambda x: ~F.exists(F.col(b), lambda y: F.left(y, F.lit(4)) == F.left(x, F.lit(4))),
        )
        return F.array_join(F.slice(F.array_sort(near), 1, 6), ", ")

    df = per.select("card", "label", alone("e", "f").alias("a"), alone("f", "e").alias("b"))

    def shown(c):
        return F.when(F.col(c) == "", "—").otherwise(F.col(c))

    return emit(
        df,
        [((F.col("a") != "") | (F.col("b") != ""), "C6", "med", F.col("label"), F.concat(F.lit("name(s) present in one language only — EN: "), shown("a"), F.lit(" | FR: "), shown("b")))],
    )


# ------------------------------------------------------------------ doubt against certainty
def token_bags(units: DataFrame) -> DataFrame:
    """Per sentence the distinct tokens by class: dates, years, names, topic words.

    A name weighs 2, or 1 when it only opens the sentence (``n2`` holds the former, ``n`` all).
    """
    t = F.col("_norm")
    words = F.filter(F.split(t, "[^A-Za-zÀ-ÿ'’-]+"), lambda w: w != "")
    cells = F.transform(
        words,
        lambda w, i: F.struct(
            F.substring_index(F.substring_index(F.substring_index(w, "'", 1), "’", 1), "-", 1).alias("bare"),
            F.lower(F.when(F.octet_length(w) == F.length(w), w).otherwise(tx.deaccent(w))).alias("low"),
            i.alias("i"),
        ),
    )
    stop = F.array(*[F.lit(w) for w in lx.STOPWORDS])
    months = F.array(*[F.lit(w) for w in lx.MONTH_WORDS])
    topics = F.array(*[F.lit(w) for w in sorted(set(lx.TOPIC_WORDS))])
    staged = units.withColumn("_norm", tx.norm(F.col("sentence"))).withColumn(
        "_cells", F.filter(cells, lambda c: F.length(c["bare"]) >= 3)
    )
    named = F.filter(
        F.col("_cells"),
        lambda c: c["bare"].rlike("^[A-ZÀ-Ý]")
        & ~F.array_contains(months, F.lower(c["bare"]))
        & ~F.array_contains(stop, F.lower(c["bare"])),
    )
    staged = staged.withColumn(
        "_names",
        F.transform(
            named,
            lambda c: F.struct(
                F.concat(F.lit("N"), F.lower(tx.deaccent(c["bare"]))).alias("token"), c["i"].alias("i")
            ),
        ),
    )
    dates = F.transform(dt.date_set(t), lambda d: F.format_string("D%d-%d-%d", d["y"], d["m"], d["d"]))
    years = F.transform(dt.find_years(t), lambda v: F.concat(F.lit("Y"), v.cast("string")))
    later = F.filter(F.col("_names"), lambda c: c["i"] > 0)
    low = F.transform(F.col("_cells"), lambda c: c["low"])
    return staged.withColumns(
        {
            "d": F.array_distinct(dates),
            "y": F.array_distinct(years),
            "n": F.array_distinct(F.transform(F.col("_names"), lambda c: c["token"])),
            "n2": F.array_distinct(F.transform(later, lambda c: c["token"])),
            "t": F.transform(F.array_intersect(low, topics), lambda v: F.concat(F.lit("T"), v)),
        }
    ).drop("_norm", "_cells", "_names")


def token_rows(bags: DataFrame, *keys: str) -> DataFrame:
    """Weighted tokens in long form."""

    def weighted(c, w):
        return F.transform(F.col(c), lambda v: F.struct(v.alias("token"), F.lit(w).alias("w")))

    opening = F.transform(
        F.array_except(F.col("n"), F.col("n2")), lambda v: F.struct(v.alias("token"), F.lit(1).alias("w"))
    )
    all_ = F.concat(weighted("d", 5), weighted("y", 3), weighted("n2", 2), opening, weighted("t", 2))
    return bags.select(*keys, F.inline(all_))


def _shared(c: str) -> Column:
    return F.size(F.array_intersect(F.col(f"a.{c}"), F.col(f"b.{c}")))


def overlap_score() -> Column:
    return 5 * _shared("d") + 3 * _shared("y") + 2 * _shared("t") + _shared("n") + _shared("n2")


#: Two sentences state the same fact when what they share weighs so much.
LEAST_SCORE = 10
#: Sentences of a card that hold one token are laid into blocks of about so many; a task's key is a pair of blocks.
BLOCK = 1024


def prefix_tokens(bags: DataFrame) -> DataFrame:
    """(card, uid, prefix): the tokens (n, token) at which a sentence has to be met, rarest in the card first.

    Tokens are in one order for the whole card: by the number of its sentences that hold them. What two sentences share
    weighs at least LEAST_SCORE only if the first token they share, in that order, has tokens of such a weight from there on in
    either sentence. So a sentence is met at these tokens alone, seldom at a frequent one, and not at all if everything it
    holds weighs less.
    """
    rows = token_rows(bags, "card", "lang", "uid").distinct()
    counts = rows.groupBy("card", "lang", "token").agg(F.count("*").alias("n"))
    held = rows.join(counts, ["card", "lang", "token"]).groupBy("card", "uid").agg(F.sort_array(F.collect_list(F.struct("n", "token", "w"))).alias("held"), F.sum("w").alias("left"))

    def step(state: Column, x: Column) -> Column:
        taken = F.when(state["left"] >= LEAST_SCORE, F.concat(state["prefix"], F.array(F.struct(x["n"].alias("n"), x["token"].alias("token"))))).otherwise(state["prefix"])
        return F.struct((state["left"] - x["w"]).alias("left"), taken.alias("prefix"))

    start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<n:bigint,token:string>>").alias("prefix"))
    return held.where(F.col("left") >= LEAST_SCORE).select("card", "uid", F.aggregate("held", start, step, lambda state: state["prefix"]).alias("prefix"))


def hedge_vs_flat(fields: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """A fact doubted in one field and stated flat in another field of the same card.

    A pair needs a shared topic word, a shared date or name, and a score that bounds where the two can meet: at their
    prefix tokens, see prefix_tokens. A pair sharing several of them is kept at the first. A token of many sentences is
    dealt out in pairs of blocks. ``units`` are the sentences of the fields, where a caller has them.
    """
    skip = ["srclabel", "psource", "doctr", "srcquote"]
    units = (cd.units(fields) if units is None else units).where(~F.col("kind").isin(skip))
    bags = token_bags(units).withColumn("uid", F.xxhash64("lang", "path", "ord", "sentence"))
    bags = cut_lineage(bags.where((F.size("t") > 0) & (F.size(F.array_union("d", "n")) > 0)))
    met_at = prefix_tokens(bags)
    bags = bags.withColumn("hedged", tx.is_hedged(F.col("sentence"), F.col("lang"))).withColumn(
        "short", F.col("kind").isin(lx.SHORT_KINDS)
    )

    def keyed(df, name, own, other, *also):
        row = F.struct("path", "ord", "short", "d", "y", "n", "n2", "t", "prefix", *also)
        blocks = F.ceil(F.col("at.n") / BLOCK).cast("int")
        out = df.join(met_at, ["card", "uid"]).withColumns({"ats": F.col("prefix"), "prefix": F.col("prefix.token")})
        out = out.select(row.alias(name), "card", "lang", "uid", F.explode("ats").alias("at"))
        return out.select(name, "card", "lang", F.col("at.token").alias("token"), F.pmod("uid", blocks).cast("int").alias(own), F.explode(F.sequence(F.lit(0), blocks - 1)).alias(other))

    doubted = keyed(bags.where(F.col("hedged")), "a", "block_a", "block_b", "sentence")
    flat = keyed(
        bags.where(
            ~F.col("hedged")
            & ~F.col("kind").isin(lx.LABEL_KINDS)
            & ~F.col("alt")
            & rx.matches(F.col("sentence"), lx.ASSERTIVE)
        ),
        "b", "block_b", "block_a",
    )
    first_met = F.get(F.filter("a.prefix", lambda x: F.array_contains(F.col("b.prefix"), x)), F.lit(0))
    met = doubted.join(flat, ["card", "lang", "token", "block_a", "block_b"]).where(
        (F.col("a.path") != F.col("b.path"))
        & (F.col("a.short") | F.col("b.short"))
        & (F.col("token") == first_met)
        & (_shared("t") >= 1)
    )
    same_fact = (_shared("d") >= 1) | ((_shared("y") >= 1) & (_shared("n") >= 1)) | (_shared("n") >= 2)
    scored = met.withColumn("score", overlap_score()).where(same_fact & (F.col("score") >= LEAST_SCORE))
    first = scored.groupBy("card", F.col("a.path").alias("pa"), F.col("b.path").alias("pb")).agg(
        F.min(F.struct(F.col("a.ord").alias("oa"), F.col("b.ord").alias("ob"), "score", F.col("a.sentence").alias("sent"), "lang")).alias("f")
    )
    hit = F.get(tx.hedge_hits(F.col("f.sent"), F.col("f.lang")), F.lit(0))
    return emit(
        first,
        [
            (
                F.lit(True), "C1", F.when(F.col("f.score") >= 12, "high").otherwise("med"),
                F.concat("pa", F.lit(" ↔ "), "pb"),
                F.concat(F.lit("hedged in "), "pa", F.lit(' ("'), hit, F.lit('") but stated flat in '), "pb"),
            )
        ],
    )
