"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` over ``values``, each evaluated once per row.

    The optimizer merges projections, and so moves ``lower(title)`` into the
    lambda that walks a word list, where it would run once per word. A value
    passed through a one-element array stays outside.
    """
    packed = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(packed, lambda x: body(**{k: x[k] for k in values})), F.lit(0))
