"""Judging URLs: host and path rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The model has so many weights; n-grams have 3 to 5 characters.
BUCKETS, NGRAMS = 1 << 16, (3, 4, 5)
#: At most so many labelled URLs of each verdict are taken for training; which ones depends on their hashes alone.
LABELLED = 2_000
ROUNDS, RATE, DECAY = 30, 0.5, 1e-6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part after the first :// up to / ? # or the end, A-Z lower-cased; and what follows up to ? or #. Else both empty."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; ties go to the rule that comes first by code point. Null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(sorted(rules, reverse=True), key=len):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + own_path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def _buckets(host: str, path: str) -> np.ndarray:
    found = [xxhash.xxh32_intdigest(kind + text[k : k + n].encode("utf-8", "surrogatepass")) % BUCKETS for kind, text in ((b"h", f"^{host}$"), (b"p", f"^{path}$")) for n in NGRAMS for k in range(max(0, len(text) - n + 1))]
    return np.unique(np.array(found, np.int64))


def train(hosts: list[str], paths: list[str], blocked: list[bool]) -> np.ndarray:
    """Weights, the bias last, by gradient steps with a per-weight step size over the labelled URLs in a fixed order."""
    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    rows = [np.r_[_buckets(h, p), BUCKETS] for h, p in zip(hosts, paths, strict=True)]
    order = np.argsort([xxhash.xxh64_intdigest(f"{h}{p}".encode("utf-8", "surrogatepass")) for h, p in zip(hosts, paths, strict=True)], kind="stable")
    for _ in range(ROUNDS if rows else 0):
        for k in order:
            row = rows[k]
            gap = 1 / (1 + np.exp(-np.clip(weights[row].sum() / np.sqrt(len(row)), -30, 30))) - blocked[k]
            step = gap / np.sqrt(len(row)) + DECAY * weights[row]
            squares[row] += step * step
            weights[row] -= RATE * step / np.sqrt(squares[row])
    return weights


def labelled_by_rules(urls: DataFrame, rules: dict[str, str], most: int = LABELLED) -> DataFrame:
    """A small labelled table (host, path, blocked): urls that the rules judge, up to `most` of each verdict, by hash."""
    host, path = host_and_path(F.col("url"))
    judged = urls.select(host.alias("host"), path.alias("path")).withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)[1]).where("verdict is not null").distinct()
    by_hash = [F.xxhash64("host", "path"), "host", "path"]
    parts = [judged.where(F.col("verdict") == v).orderBy(*by_hash).limit(most) for v in ("block", "allow")]
    return parts[0].union(parts[1]).select("host", "path", (F.col("verdict") == "block").alias("blocked"))


def judge_urls(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url) -> (page_id, host, path, rule, verdict, p_block).

    The regression is trained on the bounded table `labelled` (host, path, blocked), as that of labelled_urls.py; it
    decides where no rule fits, so a curated list reaches hosts and paths like those it names. Without a table it is
    trained on URLs of pages that the rules judge and only extends these rules. With no labelled URL every probability is 0.5, and 0.5 or more blocks. A null url or one without :// has an empty host and
    path and is judged like any other; repeated rows give repeated results; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = (labelled if labelled is not None else labelled_by_rules(pages, rules)).select("host", "path", "blocked").toPandas()
    model = spark.sparkContext.broadcast(train(rows["host"].tolist(), rows["path"].tolist(), rows["blocked"].tolist()))

    @F.pandas_udf("double")
    def p_block(host, path):
        import pandas as pd

        weights = model.value
        out = []
        for h, p in zip(host, path, strict=True):
            row = _buckets(h, p)
            out.append(1 / (1 + np.exp(-np.clip((weights[row].sum() + weights[BUCKETS]) / np.sqrt(len(row) + 1), -30, 30))))
        return pd.Series(out, dtype="float64")

    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "_verdict": verdict, "p_block": p_block("host", "path")})
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")
