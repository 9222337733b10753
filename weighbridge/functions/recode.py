"""Recoding, labelling and set-membership expressions with missing-value rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(x: Column, pairs: Mapping[str, str]) -> Column:
    """Replace known codes through a literal map; unknown codes pass through."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])
    return F.coalesce(F.try_element_at(table, x), x)


def first_match(rules: Sequence[tuple[Column, Column | str]], default: Column | None = None) -> Column:
    """Value of the first rule that holds; an unknown condition counts as not holding."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if default is None else out.otherwise(default)


def outside(x: Column, members: Iterable) -> Column:
    """Negated membership that keeps NULL rows."""
    return ~F.coalesce(x.isin(list(members)), F.lit(False))


def without_text(x: Column, fragment: str) -> Column:
    """True unless x contains the fragment; NULL counts as not containing it."""
    return ~F.coalesce(x.contains(fragment), F.lit(False))


def level_index(x: Column, levels: Sequence[str]) -> Column:
    """1-based place of x in ``levels``; NULL when absent."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), x), F.lit(0).cast("bigint"))


def sector_from_funding(label: Column, share: Column, above: float, below: float, high: str, low: str) -> Column:
    """``high`` above one threshold, ``low`` below another, the old label otherwise."""
    return first_match([(share > above, high), (share < below, low)], default=label)


def band_of_cuts(x: Column, cuts: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label of the first cut point that x does not exceed; NULL stays NULL."""
    rules = [(x <= cut, label) for cut, label in zip(cuts, labels)]
    return first_match(rules + [(x > cuts[-1], labels[-1])])


def parity_zone(x: Column, low: float, high: float) -> Column:
    return first_match([(x < low, "below"), (x.between(low, high), "parity"), (x > high, "above")])


def sign_zone(x: Column, negative: str, positive: str) -> Column:
    return first_match([(x < 0, negative), (x > 0, positive)])
