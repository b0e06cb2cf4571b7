"""The check registry: named checks over card tables, built only when asked for."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from claimcheck.operators import arithmetic as ar
from claimcheck.operators import cards as cd
from claimcheck.operators import evidence as ev
from claimcheck.operators import findings as fi
from claimcheck.operators import prose as pr
from claimcheck.operators import structure as st
from claimcheck.session import written

Check = Callable[[object], list[DataFrame]]
CHECKS: dict[str, Check] = {}


def register_check(name: str):
    """Add a check: a function from the card tables to a list of finding tables."""

    def wrap(fn: Check) -> Check:
        CHECKS[name] = fn
        return fn

    return wrap


@register_check("C1")
def _c1(t):
    return [pr.hedge_vs_flat(cd.fields(t), cd.units_of(t))]


@register_check("C2")
def _c2(t):
    f, e = cd.fields(t, ev.CITING_KINDS), cd.evidence(t)
    u = cd.units_of(t, ev.CITING_KINDS)
    return [ev.unsupported_types(u, e), ev.census_unsupported(u, e), ev.cross_reference(u), ev.source_count(f, e)]


@register_check("C3")
def _c3(t):
    f = cd.fields(t, ["bio", "mapnote", "tooltip", "headline"])
    return [st.pin_notes(t.person, t.event), ar.pin_vs_prose(f, t.event, t.place)]


@register_check("C3d")
def _c3d(t):
    return [ev.undocumented_pins(t.event, cd.evidence(t))]


@register_check("C4")
def _c4(t):
    f = cd.fields(t, ar.DATED_KINDS)
    u = cd.units_of(t, ar.DATED_KINDS)
    return [
        ar.weekday_claims(u), ar.interval_claims(u), ar.age_check(f, t.person, t.union_, t.event), st.reversed_years(t.person),
    ]


@register_check("C5")
def _c5(t):
    return [
        st.event_vs_span(t.person, t.event), st.event_order(t.event), st.gap_days(t.event), st.parent_child(t.person, t.union_),
    ]


@register_check("C6")
def _c6(t):
    p = cd.pairs(t)
    return [
        pr.parity_missing(p), pr.parity_years(p), pr.parity_numbers(p), pr.parity_hedges(p), pr.parity_sentences(p),
        pr.parity_names(p, pr.known_names(t.person, t.union_)), pr.parity_words(p), pr.parity_length(p),
    ]


@register_check("C7")
def _c7(t):
    return [pr.tooltip_shape(cd.fields(t, ["tooltip"]))]


@register_check("C8")
def _c8(t):
    return [ar.distance_claims(cd.fields(t), t.event, t.place)]


@register_check("X")
def _x(t):
    f = cd.fields(t)
    return [pr.typography(f), pr.process_phrases(f), pr.headline_dup(t.person), pr.unused_source(t.person, t.source, f)]


@register_check("X13")
def _x13(t):
    n = ar.count_claims(cd.fields(t, ["bio", "mapnote", "tooltip", "union"]), t.person)
    return [ar.count_mismatch(n), ar.count_contradiction(n)]


@register_check("S1")
def _s1(t):
    """Asked only of tables that come with source contracts."""
    contracts = vars(t._tables if isinstance(t, cd.StoredTexts) else t).get("contracts")
    return [ev.contract_findings(cd.fields(t), contracts, t.person)] if contracts else []


#: So many checks are run at a time where each is run by itself.
AT_ONCE = 4

#: Checks that read no text: alone they need no stored fields.
TEXTLESS = {"C3d", "C5"}


def run_checks(t, only: list[str] | None = None) -> DataFrame:
    """Findings of the chosen checks; checks left out are never planned.

    Where several of them read texts, fields and sentences are written to the shared folder once, and then the findings of each
    rule. As one plan they would be planned anew as a whole whenever any of their stages ends.
    """
    names = [n for n in CHECKS if only is None or n in only]
    if len(set(names) - TEXTLESS) > 1:
        t = cd.StoredTexts(t)
        t.all_units  # stored before the checks that share them run side by side
        with ThreadPoolExecutor(AT_ONCE) as pool:
            parts = [df for dfs in pool.map(lambda n: [written(df, "findings") for df in CHECKS[n](t)], names) for df in dfs]
    else:
        parts = [df for n in names for df in CHECKS[n](t)]
    return fi.union_all(parts or [st.reversed_years(t.person).limit(0)])
