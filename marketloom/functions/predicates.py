"""Boolean building blocks over three-valued columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_false(c: Column) -> Column:
    """TRUE only for FALSE; NULL does not pass."""
    return c.eqNullSafe(F.lit(False))


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def not_true(c: Column) -> Column:
    """TRUE for FALSE and NULL."""
    return ~c.eqNullSafe(F.lit(True))


def null_or_in(c: Column, *values: object) -> Column:
    return c.isNull() | c.isin(*values)


def null_or_not_in(c: Column, *values: object) -> Column:
    return c.isNull() | ~c.isin(*values)


def ratio_below(numerator: Column, denominator: Column, bound: float) -> Column:
    """``numerator/denominator < bound``; an undefined ratio counts as 0."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0)) < bound


def contains_ci(text: Column, part: Column) -> Column:
    """Case-insensitive substring test, NULL-free for NULL input."""
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


# Names of the tests a rule table may use.
RULES = {
    "false": is_false,
    "true": is_true,
    "not_true": not_true,
    "null": lambda c: c.isNull(),
    "not_null": lambda c: c.isNotNull(),
}


def from_rules(rules: dict[str, str | tuple]) -> Column:
    """One predicate from ``{column: rule}``.

    A rule is a name in ``RULES`` or a tuple ``("in" | "null_or_in" |
    "null_or_not_in", value, ...)``.
    """
    conditions = []
    for name, rule in rules.items():
        c = F.col(name)
        if isinstance(rule, str):
            conditions.append(RULES[rule](c))
        else:
            test = {"in": Column.isin, "null_or_in": null_or_in, "null_or_not_in": null_or_not_in}[rule[0]]
            conditions.append(test(c, *rule[1:]))
    return all_of(conditions)
