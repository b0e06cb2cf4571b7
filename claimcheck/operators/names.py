"""Name keys, candidate resolution, search, mentions of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions import text as tx
from claimcheck.session import small_side


def _words(c: Column) -> Column:
    return F.filter(F.split(tx.norm(c), r"\s+"), lambda w: w != "")


def _join(words: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def name_keys(c: Column, spouse: bool = False) -> Column:
    """Keys a name answers to: whole, without its last word, first two words, first word."""
    w = _words(c)
    n = F.size(w)
    zero = F.lit(0)
    cuts = [n, F.greatest(n - 1, zero), *([] if spouse else [F.least(n, F.lit(2))]), F.least(n, F.lit(1))]
    keys = F.array(*[tx.fold(_join(w, cut)) for cut in cuts])
    return F.filter(keys, lambda k: F.length(k) >= 4)


def name_tokens(c: Column) -> Column:
    return F.array_sort(
        F.array_distinct(F.filter(F.split(tx.fold(c), "[^a-z]+"), lambda t: t != ""))
    )


def token_subsets(tokens: Column) -> Column:
    """Every non-empty subset of a sorted token array, as joined keys."""
    empty = F.array(F.slice(F.array(F.lit("")), 1, 0))
    grow = lambda acc, t: F.concat(acc, F.transform(acc, lambda x: F.array_append(x, t)))
    sets = F.filter(F.aggregate(tokens, empty, grow), lambda x: F.size(x) > 0)
    return F.transform(sets, lambda x: F.array_join(x, " "))


def token_key(name: Column) -> Column:
    """Search key of a queried name: its set of tokens; null without any."""
    tokens = name_tokens(name)
    return F.when(F.size(tokens) > 0, F.concat(F.lit("T:"), F.array_join(tokens, " ")))


def _rarest(sets: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """sets (name, tokens, ...) with the token of each that the fewest index keys have; none if no key has any."""
    each = sets.select(name, F.explode("tokens").alias("token")).join(counts, "token")
    least = each.groupBy(name).agg(F.min(F.struct("n", "token")).alias("r")).select(name, F.col("r.token").alias("token"))
    return sets.join(least, name)


def containments(queries: DataFrame, index: DataFrame, qcol: str = "name", icol: str = "key") -> DataFrame:
    """(skey, key): the index keys whose tokens contain those of a query, or are contained in them.

    Containment takes two tokens, or a query of one token of six letters or more. A contained set meets the other side
    on its rarest token and is then verified, so names of any length are found by one equality join in each direction.
    """
    asked = queries.select(token_key(F.col(qcol)).alias("skey"), name_tokens(F.col(qcol)).alias("tokens")).where("skey is not null").dropDuplicates(["skey"])
    held = index.select(F.col(icol).alias("key")).distinct().withColumn("tokens", name_tokens(F.col("key"))).where(F.size("tokens") > 0)
    held_tokens = held.select("key", F.col("tokens").alias("all"), F.explode("tokens").alias("token"))
    counts = held_tokens.groupBy("token").agg(F.count("*").alias("n"))
    inside = F.size(F.array_except("tokens", "all")) == 0
    wide = asked.where((F.size("tokens") >= 2) | (F.length(F.get("tokens", F.lit(0))) >= 6))
    within_key = _rarest(wide, counts, "skey").join(held_tokens, "token").where(inside).select("skey", "key")
    asked_tokens = asked.select("skey", F.col("tokens").alias("all"), F.explode("tokens").alias("token"))
    within_query = _rarest(held.where(F.size("tokens") >= 2), counts, "key").join(asked_tokens, "token").where(inside).select("skey", "key")
    return within_key.union(within_query).distinct()


def resolve(queries: DataFrame, index: DataFrame, qcol: str = "name", icol: str = "key") -> DataFrame:
    """Distinct query names with the search key that answers them and how (exact, containment).

    Candidates are counted per index key before any join, so a name borne by very many people is one
    row. ``index`` has one row per (key, person).
    """
    per_key = index.groupBy(F.col(icol).alias("key")).agg(F.count("*").alias("candidates"))
    q = queries.select(F.col(qcol).alias("name")).distinct().withColumn("key", tx.fold(F.col("name")))
    exact = q.join(per_key, "key").select("name", F.concat(F.lit("N:"), "key").alias("skey"), F.lit("exact").alias("how"), "candidates")
    rest = q.join(per_key, "key", "left_anti").select("name", token_key(F.col("name")).alias("skey"))
    answers = containments(rest, per_key).join(per_key, "key").groupBy("skey").agg(F.sum("candidates").alias("candidates"))
    loose = rest.join(answers, "skey").select("name", "skey", F.lit("containment").alias("how"), "candidates")
    return exact.unionByName(loose)


def _any_starts(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda t: F.startswith(t, F.lit(prefix)))


def word_runs(words: Column, n: int) -> Column:
    """All runs of n consecutive words, joined by spaces; none when there are fewer words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def search(names: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Name search: every query word must start some word of the name, in any order, accents
    and case ignored; ``via`` tells which partner name matched. Blank queries find nothing.

    ``names`` has (card, name, via) where via is null for the person's own name. ``limit`` is
    the feature's own result cap.
    """
    folded = [w for w in tx.deaccent_str(query).lower().split() if w]
    if not folded:
        return names.limit(0)
    words = F.split(tx.fold(F.col("name")), r"[\s'’-]+")
    cond = F.lit(True)
    for w in folded:
        cond = cond & _any_starts(words, w)
    own_first = F.when(F.col("via").isNull(), 0).otherwise(1)
    hits = names.where(cond).groupBy("card").agg(
        F.min(F.struct(own_first.alias("o"), "via", "name")).alias("b")
    )
    return hits.select("card", F.col("b.name").alias("name"), F.col("b.via").alias("via")).orderBy("card").limit(limit)


# ------------------------------------------------------------------ places in text
def _gram_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def place_mentions(units: DataFrame, place: DataFrame, keep: list[str], column: str = "sentence", ignore_case: bool = True) -> DataFrame:
    """Gazetteer places named in a text: word n-grams meet the place's base name.

    The base name is the part before " (", longer than three characters. A run of words is made only
    at a word that begins some base name, and only of the lengths that such names have.
    """
    base = F.split_part("n", F.lit(" ("), F.lit(1))
    shape = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    named = (
        place.where(F.col("n").isNotNull())
        .withColumn("base", base)
        .where(F.length("base") > 3)
        .select("k", shape(F.col("base")).alias("base"))
        .withColumn("_of", _gram_words(F.col("base")))
        .select("k", "base", F.array_join("_of", " ").alias("gram"), F.get("_of", F.lit(0)).alias("_word"), F.size("_of").alias("_n"))
    )
    starts = named.where(F.col("_word").isNotNull()).select("_word", "_n").distinct()
    # words pass through an expression: for a plain column, a filter of its size would go below and cut the words once more
    words = F.coalesce("_words", F.array().cast("array<string>"))
    staged = units.select(*keep, shape(F.col(column)).alias("_text")).withColumn("_words", _gram_words(F.col("_text")))
    begun = staged.select(*keep, "_text", "_words", F.posexplode(words).alias("_at", "_word")).join(small_side(starts), "_word")
    run = F.when(F.col("_n") == 1, F.col("_word")).otherwise(F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_n")), " "))
    met = begun.select(*keep, "_text", run.alias("gram")).join(small_side(named.select("k", "base", "gram")), "gram")
    return met.where(F.contains("_text", F.col("base"))).select(*keep, "k").distinct()
