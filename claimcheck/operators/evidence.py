"""Rules that set prose and pins against the evidence a card carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx
from claimcheck.functions import text as tx
from claimcheck.operators.findings import by_key
from claimcheck.operators.structure import emit, pin_path, s
from claimcheck.session import small_side

CITING_KINDS = ["tooltip", "mapnote", "headline", "bio", "union", "pin"]


def _labels(flags: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(key)) for cond, key in flags]))


def source_support(evidence: DataFrame, types=None) -> DataFrame:
    """One row per card: how many items, and which source types they can back.

    Flags are boolean maxima, so a card with very many items combines map-side.
    """
    types = types or lx.SOURCE_TYPES
    t = F.col("text")
    flags = [F.bool_or(rx.matches(t, inv)).alias(f"_{key}") for key, _, inv in types]
    per = evidence.groupBy("card").agg(F.count("*").alias("items"), *flags)
    return per.select(
        "card", "items", _labels([(F.col(f"_{key}"), key) for key, *_ in types]).alias("backed")
    )


def unsupported_types(units: DataFrame, evidence: DataFrame, types=None) -> DataFrame:
    """A source type named in prose which no evidence item of the card matches."""
    types = types or lx.SOURCE_TYPES
    x = F.col("sentence")
    named = _labels([(rx.matches(x, p) & ~tx.negated(x, p), key) for key, p, _ in types])
    any_type = rx.matches(x, "|".join(p for _, p, _ in types))
    cited = (
        units.where(F.col("kind").isin(CITING_KINDS) & any_type)
        .where(~rx.matches(tx.norm(x), lx.CROSS_CARD))
        .select("card", "path", F.explode(named).alias("type"))
        .distinct()
    )
    df = cited.join(source_support(evidence, types), "card", "left").where(
        F.col("backed").isNull() | ~F.array_contains("backed", F.col("type"))
    )
    sev = F.when(F.coalesce("items", F.lit(0)) == 0, "high").otherwise("med")
    msg = F.concat(F.lit('prose cites "'), "type", F.lit('" but nothing in this card\'s evidence matches it'))
    return emit(df, [(F.lit(True), "C2", sev, F.col("path"), msg)])


_CENSUS_YEARS = [str(y) for y in range(1700, 1951, 10)]


def census_unsupported(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """A dated census named in prose whose year is nowhere in the card's evidence."""
    t = tx.norm(F.col("sentence"))
    hits = rx.all_matches(t, lx.DATED_CENSUS, 1)
    cited = (
        units.where(F.col("kind").isin(CITING_KINDS) & rx.matches(t, lx.DATED_CENSUS))
        .where(~rx.matches(t, lx.CROSS_CARD))
        .select("card", "path", t.alias("t"), F.explode(F.array_distinct(hits)).alias("yr"))
    )
    at = F.instr(F.lower("t"), F.concat("yr", F.lit(" census")))
    begin = F.greatest(at - 60, F.lit(1))
    window = F.substring(F.col("t"), begin, at - begin + 11 + 45)
    denied = (at > 0) & (rx.matches(window, lx.NEGATOR_EN) | rx.matches(window, lx.NEGATOR_FR))
    cited = cited.where(~denied).select("card", "path", "yr").distinct()
    years = F.array(*[F.lit(y) for y in _CENSUS_YEARS])
    held = evidence.select(
        "card", F.explode(F.filter(years, lambda y: F.contains(F.col("text"), y))).alias("yr")
    ).distinct()
    df = cited.join(held, ["card", "yr"], "left_anti")
    msg = F.concat(F.lit("cites the "), "yr", F.lit(" census; no "), "yr", F.lit(" source or document on this card"))
    return emit(df, [(F.lit(True), "C2", "high", F.col("path"), msg)])


def cross_reference(units: DataFrame) -> DataFrame:
    """English sentences that say what another card says, once per field and phrase."""
    hit = F.trim(rx.first_match(tx.norm(F.col("sentence")), lx.CROSS_CARD))
    df = (
        units.where((F.col("lang") == "en") & F.col("kind").isin(CITING_KINDS))
        .select("card", "path", hit.alias("hit"))
        .where(F.col("hit") != "")
        .distinct()
    )
    msg = F.concat(F.lit('asserts what another card says ("'), "hit", F.lit('")'))
    return emit(df, [(F.lit(True), "C2x", "review", F.col("path"), msg)])


def source_count(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """"A single X" / "both Xs" in prose against the number of X items on the card."""
    t = F.col("text")
    said, held, rules = [], [], []
    for i, (key, inv, one, two) in enumerate(lx.SOURCE_FAMILIES):
        single = rf"\b(?:a single|only one|the only|one)\s+(?:online |compiled |family )*(?:{one})"
        both = rf"\b(?:both|the two)\s+(?:{two})\b"
        said += [F.bool_or(rx.matches(t, single)).alias(f"s{i}"), F.bool_or(rx.matches(t, both)).alias(f"b{i}")]
        held.append(F.count_if(rx.matches(t, inv)).alias(f"n{i}"))
        n = F.coalesce(f"n{i}", F.lit(0))
        rules += [
            (F.col(f"s{i}") & (n > 1), "C2", "review", "bio", F.concat(F.lit(f'prose says "a single {key}" but the card carries '), s(n))),
            (F.col(f"b{i}") & (n < 2), "C2", "review", "bio", F.concat(F.lit(f'prose says "both {key}s" but the card carries '), s(n))),
        ]
    prose = fields.where((F.col("lang") == "en") & F.col("kind").isin(CITING_KINDS)).groupBy("card").agg(*said)
    items = evidence.groupBy("card").agg(*held)
    return emit(prose.join(items, "card", "left"), rules)


def undocumented_pins(event: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cards with evidence, none of it documentary, that still carry [doc] pins."""
    per = evidence.groupBy("card").agg(F.bool_or(rx.matches(F.col("text"), lx.DOCUMENTARY)).alias("ok"))
    pins = event.where(F.col("c") == "doc").groupBy("card").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    df = pins.join(per.where(~F.col("ok")), "card")
    msg = F.concat(s("n"), F.lit(" pin(s) tagged [doc] but the card carries no documentary source"))
    return emit(df, [(F.lit(True), "C3", "high", pin_path(), msg)])


def evidence_classes(person: DataFrame, evidence: DataFrame, doc: DataFrame) -> DataFrame:
    """Evidence classes per card and the two verdicts drawn from them."""
    t = F.col("text")
    flags = []
    for key, p in lx.EVIDENCE_CLASSES:
        hit = rx.matches(t, p)
        if key == "register":  # a register only counts when its transcription series is named
            hit = hit & rx.matches(t, lx.TRANSCRIPTION_SERIES)
        flags.append(F.bool_or(hit).alias(key))
    per = evidence.groupBy("card").agg(*flags)
    scans = doc.select("card").distinct().withColumn("scan", F.lit(True))
    df = person.select("card").join(per, "card", "left").join(scans, "card", "left")
    keys = ["scan", *[k for k, _ in lx.EVIDENCE_CLASSES]]
    on = {k: F.coalesce(F.col(k), F.lit(False)) for k in keys}
    documentary = on["scan"] | on["archive"] | on["index"] | on["register"]
    classes = F.array_sort(_labels([(on[k], k) for k in keys]))
    df = df.select("card", classes.alias("classes"), documentary.alias("documentary"))
    weak = (
        F.array_contains("classes", F.lit("compiled"))
        | F.array_contains("classes", F.lit("family"))
        | (F.size("classes") == 0)
    )
    return df.withColumn("only_compiled", ~F.col("documentary") & weak)


def doc_pin_audit(classes: DataFrame, event: DataFrame, place: DataFrame) -> DataFrame:
    """[doc] pins on cards that rest on compiled or family evidence only."""
    note = F.concat_ws(" ", F.coalesce("w", F.lit("")), F.coalesce("w_fr", F.lit("")))
    pins = event.where((F.col("c") == "doc") & ~rx.matches(note, lx.CROSS_CITED_PIN))
    bad = pins.join(classes.where("only_compiled").select("card", "classes"), "card")
    counts = bad.groupBy("card").agg(F.count("*").alias("n_pins"))
    return (
        bad.join(counts, "card")
        .join(small_side(place.select("k", "n", "n_fr")), "k", "left")
        .select(
            "card", "n_pins", F.array_join("classes", "+").alias("classes"), "pos", "t", "k",
            F.col("n").alias("place"), F.col("n_fr").alias("place_fr"), "y", "y2", "d", "w", "w_fr",
        )
    )


def source_phrases(evidence: DataFrame, phrases=None, default=None) -> DataFrame:
    """What a card rests on, in words: "a, b and c" in both languages."""
    phrases, default = phrases or lx.SOURCE_PHRASES, default or lx.SOURCE_PHRASE_DEFAULT
    t = F.left(F.col("text"), F.lit(140))
    flags = [F.bool_or(rx.matches(t, p)).alias(f"f{i}") for i, (p, *_) in enumerate(phrases)]
    per = evidence.groupBy("card").agg(*flags)

    def joined(col, word, fallback):
        parts = F.array_compact(
            F.array(*[F.when(F.col(f"f{i}"), F.lit(p[col])) for i, p in enumerate(phrases)])
        )
        n = F.size(parts)
        head = F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", ")
        return (
            F.when(n == 0, F.lit(fallback))
            .when(n == 1, F.get(parts, F.lit(0)))
            .otherwise(F.concat(head, F.lit(f" {word} "), F.element_at(parts, -1)))
        )

    return per.select(
        "card", joined(1, "and", default[0]).alias("src_en"), joined(2, "et", default[1]).alias("src_fr")
    )


def retag_edits(audit: DataFrame, person: DataFrame, evidence: DataFrame) -> DataFrame:
    """The edit batch that turns audited [doc] pins into [inf], with notes where missing.

    Pins whose type has no template come back with ``skipped`` set and no value.
    """
    df = (
        audit.join(person.select("card", "g"), "card")
        .join(source_phrases(evidence), "card", "left")
        .withColumn("src_en", F.coalesce("src_en", F.lit(lx.SOURCE_PHRASE_DEFAULT[0])))
        .withColumn("src_fr", F.coalesce("src_fr", F.lit(lx.SOURCE_PHRASE_DEFAULT[1])))
    )
    she = F.col("g") == "f"

    def fill(side: int) -> Column:
        text = by_key({t: v[side] for t, v in lx.NOTE_TEMPLATES.items()}, F.col("t"))
        place = F.coalesce("place", s("k")) if side == 0 else F.coalesce("place_fr", "place", s("k"))
        for slot, value in [
            ("{place}", place),
            ("{src}", F.col("src_en" if side == 0 else "src_fr")),
            ("{Her}", F.when(she, "Her").otherwise("His")),
            ("{She}", F.when(she, "She").otherwise("He")),
            ("{her}", F.when(she, "her").otherwise("him")),
            ("{Elle}", F.when(she, "Elle est située").otherwise("Il est situé")),
        ]:
            text = F.replace(text, F.lit(slot), value)
        return text

    known = F.col("t").isin(*lx.NOTE_TEMPLATES)
    null = F.lit(None).cast("string")

    def edit(path, expect, value, why, skipped=False):
        return F.struct(
            path.alias("path"), expect.alias("expect"), value.alias("value"), why.alias("why"),
            F.lit(skipped).alias("skipped"),
        )

    why = F.concat(
        F.lit("the card carries no documentary source — only "), "src_en",
        F.lit(" — so [doc] claimed a document nobody has read"),
    )
    edits = F.array_compact(
        F.array(
            F.when(known, edit(pin_path(suffix=".c"), F.lit("doc"), F.lit("inf"), why)),
            F.when(known & (F.coalesce("w", F.lit("")) == ""), edit(pin_path(suffix=".w"), null, fill(0), F.lit("the site requires a bilingual note on every non-doc pin"))),
            F.when(known & (F.coalesce("w_fr", F.lit("")) == ""), edit(pin_path(suffix=".w_fr"), null, fill(1), F.lit("same, French side"))),
            F.when(~known, edit(pin_path(), null, null, F.concat(F.lit("no template for "), "t"), True)),
        )
    )
    return df.select("card", F.inline(edits))


# ------------------------------------------------------------------ contracts
def contract_findings(fields: DataFrame, contracts: list[dict], person: DataFrame | None = None) -> DataFrame:
    """A clause naming one source for a claim its sheet says it does not carry.

    ``contracts`` is the small rule list (key, name, excludes, exempt); clauses naming two
    sources, clauses that deny, and exempted names are silent. ``person`` (card, name) lets an
    exemption name the card itself.
    """
    clause = F.col("clause")
    named = F.array_compact(
        F.array(*[F.when(rx.matches(clause, c["name"]), F.lit(c["key"])) for c in contracts])
    )
    label = ~F.col("path").rlike(r"^(src|psrc|profile\.sources)\[")
    any_name = rx.matches(F.col("text"), "|".join(c["name"] for c in contracts))
    fields = fields.where(label & any_name)
    owner = F.lit("")
    if person is not None and any(c.get("exempt") for c in contracts):
        fields = fields.join(person.select("card", F.concat_ws(" ", "name", "years").alias("_who")), "card")
        owner = F.col("_who")
    df = (
        fields.withColumn("clause", F.explode(tx.clauses(F.col("text"))))
        .withColumn("named", named)
        .where((F.size("named") == 1) & ~rx.matches(clause, lx.CONTRACT_NEGATIVE))
        .withColumn("key", F.get("named", F.lit(0)))
    )
    rules = []
    for c in contracts:
        free = F.lit(False)
        for x in c.get("exempt", []):
            free = free | F.contains(clause, F.lit(x)) | F.contains(owner, F.lit(x))
        for cat in c["excludes"]:
            if cat in lx.CLAIM_CATEGORIES:
                rules.append(
                    (
                        (F.col("key") == c["key"]) & rx.matches(clause, lx.CLAIM_CATEGORIES[cat]) & ~free,
                        "S1", "high", F.col("path"),
                        f"names {c['key']} for a {cat} claim, which its sheet says it does not carry",
                    )
                )
    return emit(df, rules)


def contract_summary(fields: DataFrame, contracts: list[dict]) -> DataFrame:
    """Per source: status, excluded categories, and how many fields name it."""
    label = ~F.col("path").rlike(r"^(src|psrc|profile\.sources)\[")
    counts = [F.count_if(rx.matches(F.col("text"), c["name"])).alias(f"n{i}") for i, c in enumerate(contracts)]
    totals = fields.where(label).agg(*counts)
    rows = [
        F.struct(
            F.lit(c["key"]).alias("key"), F.lit(c.get("status", "UNKNOWN")).alias("status"),
            F.lit(", ".join(c["excludes"])).alias("excludes"), F.col(f"n{i}").alias("fields_naming"),
        )
        for i, c in enumerate(contracts)
    ]
    return totals.select(F.inline(F.array(*rows)))
