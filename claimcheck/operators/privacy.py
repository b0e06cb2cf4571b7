"""Leak scans: names in text, allow-blocks, hashed deny-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimcheck.functions import dates as dt
from claimcheck.functions import lexicon as lx
from claimcheck.functions import regex as rx
from claimcheck.functions import text as tx
from claimcheck.operators.names import word_runs
from claimcheck.session import small_side

BEGIN = r"allow-names-begin"
END = r"allow-names-end"
LINE_OK = r"allow-names\b"


def letters(c: Column) -> Column:
    return F.filter(F.split(tx.fold(c), r"[^\p{L}]+"), lambda w: w != "")


def name_index(person: DataFrame, union_: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """(token, tier): full names, surnames of 5+ letters, given names (4+) of the living."""
    own = person.select("name", "years")
    partner = union_.select(F.col("s").alias("name"), F.lit(None).cast("string").alias("years"))
    df = own.unionByName(partner).where(F.coalesce("name", F.lit("")) != "")
    words = F.filter(F.split(tx.norm(F.trim("name")), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    living = (dt.birth_year(F.col("years")) >= 1930) & dt.death_year(F.col("years")).isNull()
    df = df.select(words.alias("ws"), F.coalesce(living, F.lit(False)).alias("living"))

    def tier(c, name):
        return F.struct(c.alias("token"), F.lit(name).alias("tier"))

    n = F.size("ws")
    full = F.when(n > 1, tier(F.array_join(letters(F.array_join("ws", " ")), " "), "full"))
    last = tx.fold(F.element_at("ws", -1))
    surname = F.when(F.length(last) >= 5, tier(last, "surname"))
    given = F.when(
        F.col("living"),
        F.transform(
            F.filter(F.slice("ws", 1, F.greatest(n - 1, F.lit(0))), lambda w: F.length(w) >= 4),
            lambda w: tier(tx.fold(w), "living_given"),
        ),
    )
    none = F.slice(F.array(tier(F.lit(""), "")), 1, 0)
    out = df.where(n > 0).select(F.inline(F.concat(F.array_compact(F.array(full, surname)), F.coalesce(given, none)))).distinct()
    return out.where(~((F.col("tier") != "full") & F.col("token").isin(*(allow or [""]))))


def label_names(labels: DataFrame, column: str = "label") -> DataFrame:
    """Correspondents named in source labels ("letter from X Y"): full names and surnames."""
    phrases = F.regexp_extract_all(F.col(column), F.lit(rx.java(lx.NAMED_BY, False)), F.lit(1))
    df = labels.where(rx.matches(F.col(column), lx.CORRESPONDENCE)).select(F.explode(phrases).alias("p"))
    df = df.select(F.trim(F.regexp_replace(F.trim("p"), r"[,(].*$", "")).alias("p")).where(F.size(F.split("p", r"\s+")) >= 2)
    last = tx.fold(F.element_at(F.split("p", r"\s+"), -1))
    return df.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(F.array_join(letters(F.col("p")), " ").alias("token"), F.lit("full").alias("tier")),
                    F.when(F.length(last) >= 5, F.struct(last.alias("token"), F.lit("surname").alias("tier"))),
                )
            )
        )
    ).distinct()


def _numbered(runs: Column, n: int) -> Column:
    return F.transform(runs, lambda r: F.concat(F.lit(f"{n} "), r))


# Words of an index entry that a text must hold before the whole entry is looked for.
LEAD = 6


def leak_scan(texts: DataFrame, key: str, column: str, index: DataFrame) -> DataFrame:
    """Index entries that occur in a text: (key, token, tier).

    An entry and a text meet on the entry's first words, at most ``LEAD`` of them, by equality; the
    whole entry is then looked for in the text's words. So the number of passes over the texts does
    not depend on the lengths of the entries. Runs are made of the lengths that some entry asks for.
    """
    words = F.split("token", " ")
    entries = index.select("token", "tier", F.least(F.size(words), F.lit(LEAD)).alias("n"), F.array_join(F.slice(words, 1, LEAD), " ").alias("lead"))
    staged = texts.select(key, letters(F.col(column)).alias("_words"))
    lengths = [r["n"] for r in entries.select("n").distinct().orderBy("n").collect()] or [LEAD]
    runs = F.flatten(F.array(*[_numbered(word_runs(F.col("_words"), n), n) for n in lengths]))
    leads = staged.select(key, F.explode(F.array_distinct(runs)).alias("lead"))
    met = leads.join(small_side(entries.select("token", "tier", F.concat_ws(" ", F.col("n").cast("string"), "lead").alias("lead"))), "lead").select(key, "token", "tier").distinct()
    short = met.where(F.size(words) <= LEAD)
    long = met.where(F.size(words) > LEAD).join(staged, key)
    found = F.contains(F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")), F.concat(F.lit(" "), "token", F.lit(" ")))
    return short.unionByName(long.where(found).select(key, "token", "tier")).distinct()


def message_leak(messages: DataFrame, keys: list[str], column: str, tokens: DataFrame) -> DataFrame:
    """Per message the name tokens (3+ letters) found as written in lower case or folded."""

    def words(c):
        return F.filter(F.split(c, r"[^\p{L}]+"), lambda w: F.length(w) >= 3)

    both = F.array_union(words(F.lower(F.col(column))), words(tx.fold(F.col(column))))
    hits = messages.select(*keys, F.explode(both).alias("token")).join(small_side(tokens), "token", "left_semi").distinct()
    return hits.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("hits"))


def carry_last(df: DataFrame, group: str, order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Last non-null ``value`` at or before each row, per group, in two levels.

    Inside a block of the order column a window answers; blocks are summarised by their last
    value and chained per group, so one long file is spread over many tasks.
    """
    df = df.withColumn("_b", F.floor(F.col(order) / block))
    inner = W.partitionBy(group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    tails = (
        df.groupBy(group, "_b")
        .agg(F.max(F.when(F.col(value).isNotNull(), F.struct(order, value))).alias("_t"))
        .withColumn("_before", F.last(F.col(f"_t.{value}"), ignorenulls=True).over(outer))
        .select(group, "_b", "_before")
    )
    return (
        df.withColumn("_in", F.last(value, ignorenulls=True).over(inner))
        .join(tails, [group, "_b"])
        .withColumn(name, F.coalesce("_in", "_before"))
        .drop("_b", "_in", "_before")
    )


def strip_allowed(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) that no allow-marker exempts."""
    mark = F.when(rx.matches(F.col("line"), BEGIN), "begin").when(rx.matches(F.col("line"), END), "end")
    df = carry_last(lines.withColumn("mark", mark), "file", "line_no", "mark", "state")
    open_ = F.coalesce(F.col("state") == "begin", F.lit(False))
    return df.where(~open_ & F.col("mark").isNull() & ~rx.matches(F.col("line"), LINE_OK)).select("file", "line_no", "line")


def unclosed_blocks(lines: DataFrame) -> DataFrame:
    """Files whose last marker opens a block."""
    mark = F.when(rx.matches(F.col("line"), BEGIN), "begin").when(rx.matches(F.col("line"), END), "end")
    last = lines.withColumn("mark", mark).where("mark IS NOT NULL").groupBy("file").agg(F.max(F.struct("line_no", "mark")).alias("l"))
    return last.where("l.mark = 'begin'").select("file", F.col("l.line_no").alias("line_no"))


def event_key(name: Column, years: Column, t: Column, k: Column) -> Column:
    """First 16 hex digits of sha256("name|years:type:place")."""
    plain = F.concat(name, F.lit("|"), F.coalesce(years, F.lit("")), F.lit(":"), t, F.lit(":"), k.cast("string"))
    return F.substring(F.sha2(plain, 256), 1, 16)


def denied_events(event: DataFrame, person: DataFrame, deny: DataFrame) -> DataFrame:
    """Events whose hashed key is on the deny-list (column ``h``)."""
    df = event.join(person.select("card", "name", "years"), "card")
    df = df.withColumn("h", event_key(F.col("name"), F.col("years"), F.col("t"), F.col("k")))
    return df.join(small_side(deny.select("h")), "h", "left_semi").select("card", "pos", "t", "k", "h")
