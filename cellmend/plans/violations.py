"""Tuples that violate a denial constraint, as DataFrame plans.

A constraint of equalities and one more comparison between the tuples needs no self-join of
rows: one aggregate for each group of equal values, joined back, tells which tuples have a
partner. Others are left-semi joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TID
from .constraints import Attribute, Constraint, Predicate, apply, flip


def _all(predicates: list[Predicate], of) -> Column:
    return reduce(lambda a, b: a & b, (p.column(of) for p in predicates), F.lit(True))


def _plain(a: Attribute) -> Column:
    return F.col(f"`{a.name}`")


def split(dc: Constraint) -> tuple[list[Predicate], list[Predicate], list[Predicate]]:
    """Predicates of the first tuple alone, of the second alone, and between them."""
    first = dc.tuples[0]
    only = [[p for p in dc.predicates if p.tuples == {t}] for t in dc.tuples]
    between = [p for p in dc.predicates if len(p.tuples) == 2]
    # the first tuple stands left
    between = [p if p.left.tuple == first else Predicate(flip(p.op), p.right, p.left) for p in between]  # type: ignore[arg-type]
    return only[0], only[1] if len(only) > 1 else [], between


def violating(raw: DataFrame, dc: Constraint, self_pairs: bool = False) -> DataFrame:
    """(_tid_) of each tuple that violates ``dc`` in the role of its first tuple.

    self_pairs: may a tuple be its own partner?
    """
    first, second, between = split(dc)
    one = raw.where(_all(first, _plain)) if first else raw
    if not second and not between:
        return one.select(TID)
    two = raw.where(_all(second, _plain)) if second else raw
    equal = [p for p in between if p.op == "="]
    rest = [p for p in between if p.op != "="]
    if len(rest) == 1 and rest[0].op in ("<>", "<", ">") and (self_pairs or _never_self(rest[0])):
        return _by_group(one, two, equal, rest[0])
    return semi_join(one, two, between, self_pairs)


def _never_self(p: Predicate) -> bool:
    return isinstance(p.right, Attribute) and p.left.name == p.right.name


def _by_group(one: DataFrame, two: DataFrame, equal: list[Predicate], last: Predicate) -> DataFrame:
    """The largest or smallest partner value of each group decides."""
    mine, theirs = F.col("_value"), F.col(f"`{last.right.name}`")  # type: ignore[union-attr]
    keys = [F.col(f"`{p.left.name}`").alias(f"_k{i}") for i, p in enumerate(equal)]
    partner = [F.col(f"`{p.right.name}`").alias(f"_k{i}") for i, p in enumerate(equal)]  # type: ignore[union-attr]
    names = [f"_k{i}" for i in range(len(equal))]
    rows = one.select(TID, *keys, F.col(f"`{last.left.name}`").alias("_value"))
    groups = two.select(*partner, theirs.alias("_value")).groupBy(*names).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    test = {"<>": (F.col("_low") != mine) | (F.col("_high") != mine), "<": mine < F.col("_high"), ">": mine > F.col("_low")}[last.op]
    if names:
        return rows.join(groups, names).where(test).select(TID)
    bounds = groups.first()  # one row, null without partners
    return rows.withColumn("_low", F.lit(bounds["_low"])).withColumn("_high", F.lit(bounds["_high"])).where(test).select(TID)


def semi_join(one: DataFrame, two: DataFrame, between: list[Predicate], self_pairs: bool) -> DataFrame:
    """Tuples of ``one`` with a partner in ``two``; hash or merge join if there is an equality."""
    theirs = two.select(*(F.col(f"`{c}`").alias(f"_2_{c}") for c in two.columns))
    on = [apply(p.op, F.col(f"`{p.left.name}`"), F.col(f"`_2_{p.right.name}`")) for p in between]  # type: ignore[union-attr]
    if not self_pairs:
        on.append(F.col(TID) != F.col(f"_2_{TID}"))
    if not on:
        return one.select(TID) if two.limit(1).count() else one.select(TID).limit(0)
    return one.join(theirs, reduce(lambda a, b: a & b, on), "left_semi").select(TID)
