"""Pattern helpers.

Patterns in this package are written once, in the plain subset shared by the common regex
dialects, with ASCII word boundaries and a wide ``\\s``. ``java`` turns such a pattern into
what ``rlike``/``regexp_*`` need, so that a rule means the same on accented text.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary; what stands behind it is looked at first, as looking back costs more.
WB = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
WIDE_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside its groups, in order."""
    out, depth, in_class, i, start = [], 0, False, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def shared_start(pattern: str) -> str:
    """The same pattern, in which neighbouring alternatives that begin with a word boundary share one.

    So a place inside a word is left after one look, not after one for each alternative. The order of the alternatives and the
    numbers of the groups stay.
    """
    out = []
    for bounded, run in groupby(alternatives(pattern), lambda a: a.startswith(r"\b")):
        run = list(run)
        out += [r"\b(?:" + "|".join(a[2:] for a in run) + ")"] if bounded and len(run) > 1 else run
    return "|".join(out)


def java(pattern: str, ignore_case: bool = True) -> str:
    pattern = shared_start(pattern)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                out.append(WB)
            elif nxt == "s":
                out.append(WIDE_SPACE if in_class else f"[{WIDE_SPACE}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(java(pattern, ignore_case))


def first_match(c: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """First match, or '' when there is none."""
    return F.regexp_extract(c, java(pattern, ignore_case), group)


def all_matches(c: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern, ignore_case)), F.lit(group))


def replace(c: Column, pattern: str, repl: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(c, java(pattern, ignore_case), repl)


OPEN, CLOSE = "\u0001", "\u0002"


def matches_with_pos(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """All matches as ``array<struct<raw string, pos int>>`` (pos is 0-based).

    Each match is fenced by two control characters, the text is split at the fences and
    the offsets are the running length of the pieces before each match.
    """
    clean = F.translate(c, OPEN + CLOSE, "")
    pieces = F.split(
        F.regexp_replace(clean, java(pattern, ignore_case), f"{OPEN}$0{CLOSE}"),
        f"[{OPEN}{CLOSE}]",
    )
    hit = F.struct(F.lit("").alias("raw"), F.lit(0).alias("pos"))
    empty = F.slice(F.array(hit), 1, 0)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), empty.alias("hits"))

    def step(acc: Column, piece: Column) -> Column:
        found = F.struct(piece.alias("raw"), acc["at"].alias("pos"))
        return F.struct(
            (acc["n"] + 1).alias("n"),
            (acc["at"] + F.length(piece)).alias("at"),
            F.when(acc["n"] % 2 == 1, F.array_append(acc["hits"], found))
            .otherwise(acc["hits"])
            .alias("hits"),
        )

    return F.when(
        matches(c, pattern, ignore_case), F.aggregate(pieces, start, step, lambda a: a["hits"])
    ).otherwise(F.when(c.isNotNull(), empty))
