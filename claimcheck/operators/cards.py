"""Card tables to long form: fields, language pairs, evidence items and sentences.

Inputs are the typed tables described in the README (person, union_, event, place, source, doc).
Every function is one pass per input table, with no shuffle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions import text as tx
from claimcheck.session import written

FIELD_COLUMNS = ["card", "path", "lang", "kind", "text", "i", "alt"]


def _cell(path, lang: str, kind: str, text: Column, i=None) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.struct(
        path.alias("path"),
        F.lit(lang).alias("lang"),
        F.lit(kind).alias("kind"),
        text.alias("text"),
        (F.lit(None) if i is None else i).cast("bigint").alias("i"),
    )


def _at(prefix: str, pos: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix + "["), pos.cast("string"), F.lit("]" + suffix))


def _melt(df: DataFrame, cells: Column, alt: Column | None = None) -> DataFrame:
    alt = F.lit(False) if alt is None else F.coalesce(alt, F.lit(False))
    out = df.select("card", alt.alias("alt"), F.inline(cells))
    return out.where(F.col("text").isNotNull() & (tx.strip(F.col("text")) != "")).select(
        *FIELD_COLUMNS
    )


def _bio(column: str, lang: str) -> Column:
    c = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.transform(
        c, lambda t, i: _cell(_at(column, i), lang, "bio", t, i)
    )


def person_fields(person: DataFrame) -> DataFrame:
    scalars = F.array(
        _cell("note", "en", "tooltip", F.col("note")),
        _cell("note_fr", "fr", "tooltip", F.col("note_fr")),
        _cell("mn", "en", "mapnote", F.col("mn")),
        _cell("mn_fr", "fr", "mapnote", F.col("mn_fr")),
        _cell("profile.headline", "en", "headline", F.col("headline")),
        _cell("profile.headline_fr", "fr", "headline", F.col("headline_fr")),
    )
    return _melt(person, F.concat(scalars, _bio("bio", "en"), _bio("bio_fr", "fr")))


def source_fields(source: DataFrame) -> DataFrame:
    pos, o = F.col("pos"), F.col("origin")
    src = F.array(
        _cell(_at("src", pos, ".l"), "en", "srclabel", F.col("label"), pos),
        _cell(_at("src", pos, ".q"), "en", "srcquote", F.col("quote"), pos),
    )
    prof = F.array(
        _cell(_at("profile.sources", pos, ".label"), "en", "psource", F.col("label"), pos),
        _cell(_at("profile.sources", pos, ".label_fr"), "fr", "psource", F.col("label_fr"), pos),
    )
    return _melt(
        source.where(o.isin("src", "profile.sources")), F.when(o == "src", src).otherwise(prof)
    )


def doc_fields(doc: DataFrame) -> DataFrame:
    pos = F.col("pos")
    return _melt(
        doc,
        F.array(
            _cell(_at("docs", pos, ".cap"), "en", "doccap", F.col("cap"), pos),
            _cell(_at("docs", pos, ".cap_fr"), "fr", "doccap", F.col("cap_fr"), pos),
            _cell(_at("docs", pos, ".tr"), "en", "doctr", F.col("tr"), pos),
            _cell(_at("docs", pos, ".tr_fr"), "fr", "doctr", F.col("tr_fr"), pos),
        ),
    )


def union_fields(union_: DataFrame) -> DataFrame:
    pos = F.col("union_idx")
    return _melt(
        union_,
        F.array(
            _cell(_at("union", pos, ".n"), "en", "union", F.col("n"), pos),
            _cell(_at("union", pos, ".n_fr"), "fr", "union", F.col("n_fr"), pos),
        ),
    )


def event_fields(event: DataFrame) -> DataFrame:
    pos = F.col("pos")
    return _melt(
        event,
        F.array(
            _cell(_at("pl", pos, ".w"), "en", "pin", F.col("w"), pos),
            _cell(_at("pl", pos, ".w_fr"), "fr", "pin", F.col("w_fr"), pos),
        ),
        F.col("x"),
    )


_MAKERS = {
    "tooltip": "person", "mapnote": "person", "headline": "person", "bio": "person",
    "srclabel": "source", "srcquote": "source", "psource": "source", "doccap": "doc",
    "doctr": "doc", "union": "union_", "pin": "event",
}


class StoredTexts:
    """Card tables whose fields and sentences are written once, on first use, for all checks that read them."""

    def __init__(self, tables):
        self._tables = tables

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._tables, name)

    @cached_property
    def all_fields(self) -> DataFrame:
        return written(fields(self._tables), "fields")

    @cached_property
    def all_units(self) -> DataFrame:
        return written(units(self.all_fields), "units")


def units_of(t, kinds: list[str] | None = None) -> DataFrame:
    """The sentences of the fields of these kinds; split once for all checks that share stored texts."""
    if not isinstance(t, StoredTexts):
        return units(fields(t, kinds))
    return t.all_units.where(F.col("kind").isin(sorted(kinds))) if kinds else t.all_units


def fields(t, kinds: list[str] | None = None) -> DataFrame:
    """Every non-blank text of a card; ``kinds`` prunes whole input tables before the scan."""
    if isinstance(t, StoredTexts):
        return t.all_fields.where(F.col("kind").isin(sorted(kinds))) if kinds else t.all_fields
    wanted = set(kinds or _MAKERS)
    tables = {_MAKERS[k] for k in wanted}
    makers = [
        ("person", lambda: person_fields(t.person)),
        ("doc", lambda: doc_fields(t.doc)),
        ("source", lambda: source_fields(t.source)),
        ("union_", lambda: union_fields(t.union_)),
        ("event", lambda: event_fields(t.event)),
    ]
    parts = [make() for name, make in makers if name in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("kind").isin(sorted(wanted))) if kinds else out


def pairs(t) -> DataFrame:
    """English/French text pairs; a pair is kept when either side is non-blank."""

    def pair(label, kind, en, fr):
        label = F.lit(label) if isinstance(label, str) else label
        return F.struct(
            label.alias("label"), F.lit(kind).alias("kind"), en.alias("en"), fr.alias("fr")
        )

    col = F.col
    bio = F.transform(
        F.sequence(
            F.lit(0),
            F.greatest(
                F.coalesce(F.size("bio"), F.lit(0)), F.coalesce(F.size("bio_fr"), F.lit(0)), F.lit(1)
            )
            - 1,
        ),
        lambda i: pair(_at("bio", i), "bio", F.get(col("bio"), i), F.get(col("bio_fr"), i)),
    )
    person = t.person.select(
        "card",
        F.inline(
            F.concat(
                F.array(
                    pair("note", "tooltip", col("note"), col("note_fr")),
                    pair("mn", "mapnote", col("mn"), col("mn_fr")),
                    pair("headline", "headline", col("headline"), col("headline_fr")),
                ),
                bio,
            )
        ),
    )
    source = t.source.where(col("origin") == "profile.sources").select(
        "card",
        F.inline(
            F.array(
                pair(_at("profile.sources", col("pos")), "psource", col("label"), col("label_fr"))
            )
        ),
    )
    doc = t.doc.select(
        "card",
        F.inline(
            F.array(
                pair(_at("docs", col("pos"), ".cap"), "doccap", col("cap"), col("cap_fr")),
                pair(_at("docs", col("pos"), ".tr"), "doctr", col("tr"), col("tr_fr")),
            )
        ),
    )
    union_ = t.union_.select(
        "card",
        F.inline(F.array(pair(_at("union", col("union_idx"), ".n"), "union", col("n"), col("n_fr")))),
    )
    event = t.event.select(
        "card", F.inline(F.array(pair(_at("pl", col("pos"), ".w"), "pin", col("w"), col("w_fr"))))
    )
    out = person
    for p in (source, doc, union_, event):
        out = out.unionByName(p)

    def has(c):
        return F.coalesce(tx.strip(F.col(c)) != "", F.lit(False))

    return out.where(has("en") | has("fr"))


def evidence(t) -> DataFrame:
    """The sources a reader can see on a card: one row per item, text joined by spaces."""
    col = F.col

    def words(*cs):
        return F.concat_ws(" ", *[F.nullif(col(c), F.lit("")) for c in cs])

    source = t.source.select(
        "card",
        _at("", col("pos")).alias("at"),
        "origin",
        F.when(col("origin") == "src", words("label", "url"))
        .otherwise(words("label", "label_fr", "url"))
        .alias("text"),
    ).where(col("origin").isin("src", "profile.sources"))
    source = source.select("card", F.concat("origin", "at").alias("path"), "text")
    doc = t.doc.select(
        "card", _at("docs", col("pos")).alias("path"), words("cap", "cap_fr", "u", "tr").alias("text")
    )
    return source.unionByName(doc)


def units(fields_: DataFrame) -> DataFrame:
    """One row per sentence, in text order."""
    return fields_.select(
        *[c for c in fields_.columns if c != "text"],
        F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence"),
    )
