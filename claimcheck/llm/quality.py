"""Quality rules as a short-circuit cascade, ordered by what a rule rejects for what it costs."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import words

#: Rules are measured on about so many documents, drawn from all and dealt out to so many tasks.
SAMPLE, SAMPLE_TASKS = 2_000, 8
#: Words of a window that is looked for again in the same text; a power of two.
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


class Text:
    """What rules read of a text: a column where it has been computed, else the expression that computes it."""

    def __init__(self, text: str, computed: bool) -> None:
        self._text, self._computed = F.coalesce(F.col(text), F.lit("")), computed
        self.words, self.n_words = F.col("_words"), F.size("_words").cast("long")

    def __getattr__(self, name: str) -> Column:
        if name not in METRICS:
            raise AttributeError(name)
        return F.col(name) if self._computed else METRICS[name](self._text, self.words)


class Rule(NamedTuple):
    """A document fails if `fails` holds."""

    name: str
    fails: Callable[[Text], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column, _: Column) -> Column:
    """The number of lines with a word, and of those that equal an earlier one."""
    found = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return _let(found, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def _next_runs(length: int) -> Callable[[Column], Column]:
    """From hashes of runs of `length` words at each word to those of runs twice as long."""
    return lambda h: F.zip_with(h, F.slice(h, length + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))


def _repeat_words(_: Column, word: Column) -> Column:
    """Windows are hashed; only where two of a text are equal are they put in order and the words under them counted.

    Hashes of runs of words are paired into those of runs twice as long, so the time grows with the text; cutting out each
    window by slice() would read the whole text for it.
    """
    runs, length = F.transform(word, lambda w: F.xxhash64(w)), 1
    while length < WINDOW:
        runs, length = _let(runs, _next_runs(length)), 2 * length
    covered = _let(F.slice(runs, 1, F.size(word) - WINDOW + 1), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))
    return F.when(F.size(word) > WINDOW, covered).otherwise(0).cast("long")


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "word_chars": lambda text, word: F.length(F.array_join(word, "")).cast("long"),
    "n_symbols": lambda text, word: F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    "lines": _lines,
    "n_repeat_words": _repeat_words,
}

#: Thresholds are shares of a document's own words or lines, in integers.
RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 30 * t.n_words),
    Rule("word_length", lambda t: _let(t.word_chars, lambda n: (n < 2 * t.n_words) | (n > 14 * t.n_words))),
    Rule("repeated_lines", lambda t: _let(t.lines, lambda x: 2 * x["dup"] > x["n"])),
    Rule("stutter", lambda t: 100 * F.size(F.filter(t.words, lambda w, i: (i > 0) & (w == F.get(t.words, i - 1)))) > 30 * t.n_words),
)
BASE_RULES = (Rule("too_short", lambda t: t.n_words < 20), Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words))


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words, n_words, word_chars, n_symbols, lines (n, dup), n_lines, n_dup_lines and n_repeat_words.

    A null text counts as empty: every number is 0.
    """
    t = Text(text, computed=False)
    found = _once(_once(docs, _words=words(F.col(text))), n_words=t.n_words, **{name: getattr(t, name) for name in METRICS})
    return found.withColumns({"n_lines": F.col("lines.n"), "n_dup_lines": F.col("lines.dup")})


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once; a later filter on them is not moved before them and computed again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _covered(windows: Column) -> Column:
    """Number of words under the windows whose hash occurs more than once; each step is computed once and sorted without a
    comparing function."""
    at = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    return _let(_let(at, _again), _under)


def _again(at: Column) -> Column:
    """The places of the windows whose hash the one before or behind them has, in (hash, place) order of all; sorted."""
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,k:int>")), at)
    same = F.zip_with(at, before, lambda x, y: F.struct(x["k"].alias("k"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("same")))
    kept = _let(same, lambda s: F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x["same"] | F.coalesce(y["same"], F.lit(False)), x["k"])), lambda k: k.isNotNull()))
    return F.sort_array(kept)


def _under(places: Column) -> Column:
    """Number of words under windows at these places."""
    gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)


def measure(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> list[tuple[int, int]]:
    """For each rule the rows of docs that it rejects, and the nanoseconds it takes on all of them, in one job.

    Each row runs every rule on its words and text, between two readings of the clock, so a rule's cost holds all that
    the rule computes itself, not the split into words, which all share.
    """
    t = Text(text, computed=False)
    clock = F.call_function("java_method", F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    timed = None
    for place, rule in enumerate(rules):
        run = F.struct(clock.alias("start"), rule.fails(t).alias("fails"), clock.alias("end"))
        timed = F.when(F.col("_rule") == place, run) if timed is None else timed.when(F.col("_rule") == place, run)
    each = _once(docs.select(text), _words=words(F.col(text))).withColumn("_rule", F.explode(F.sequence(F.lit(0), F.lit(len(rules) - 1))))
    runs = each.select("_rule", timed.alias("_run"))
    found = runs.groupBy("_rule").agg(F.count_if("_run.fails").alias("rejected"), F.sum(F.col("_run.end") - F.col("_run.start")).alias("cost")).collect()
    by_rule = {r["_rule"]: (r["rejected"], r["cost"]) for r in found}
    return [by_rule.get(place, (0, 0)) for place in range(len(rules))]


def cascade_order(measured: list[tuple[int, int]]) -> list[int]:
    """Places of the rules by what they reject for what they cost, most first; the cheaper first where they tie.

    Any order gives the same verdict; a better one computes less. Without measurements the given order stays.
    """
    return sorted(range(len(measured)), key=lambda k: (-measured[k][0] / (measured[k][1] + 1), measured[k][1], k))


def _sample(docs: DataFrame, text: str, sample: int) -> DataFrame:
    share = min(1.0, sample / max(docs.count(), 1))
    return docs.select(text).sample(share, 7).repartition(SAMPLE_TASKS)


def _chain(rules: list[Rule], t: Text) -> Column:
    """The name of the first rule that rejects; no rule is computed for a document that an earlier one rejects."""
    chain = F.lit(None).cast("string")
    for rule in reversed(rules):
        chain = F.when(rule.fails(t), rule.name).otherwise(chain)
    return chain


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, sample: int = SAMPLE) -> DataFrame:
    """docs with the metrics, base_failed, rejected_by (the first rule of the cascade that rejects, else null) and kept.

    The metrics are asked for, so all are computed for every document; the cascade saves what rules compute beyond them.
    Where only the verdict is wanted, `kept_documents` is cheaper. Costs and selectivities come from a sample of about
    `sample` rows; the verdict does not depend on them, only rejected_by can, where several rules reject a document. A null
    or empty text has no words and fails the base rules; a text of any length is read whole; an empty table gives an empty
    one. Added columns replace columns of the same name; others stay, repeated rows are judged alike.
    """
    own = ("n_words", "word_chars", "n_symbols", "lines", "n_lines", "n_dup_lines", "n_repeat_words", "_words", "base_failed", "rejected_by", "kept")
    docs = docs.drop(*own)
    order = cascade_order(measure(_sample(docs, text, sample), rules, text))
    t = Text(text, computed=True)
    found = metrics(docs, text)
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | rule.fails(t)
    found = found.withColumn("base_failed", base_failed)
    found = found.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(_chain([rules[k] for k in order], t)))
    return found.withColumn("kept", F.col("rejected_by").isNull()).drop("_words", "lines")


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that no rule rejects: those that `quality_rules` marks as kept, with their own columns only.

    All rules are in the cascade, and what a rule reads is computed from the text when the rule is asked, so a rejected
    document costs only the rules up to the one that rejects it. Nulls, empty tables, long texts and repeated rows as there.
    """
    order = cascade_order(measure(_sample(docs, text, sample), rules, text))
    chain = _chain([rules[k] for k in order], Text("_text", computed=False))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return _once(rows, _words=words(F.col("_text"))).where(chain.isNull()).select("_row.*")
