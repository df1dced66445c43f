"""Write a long formula once and use it in two ways.

A formula takes a ``let`` and names its intermediate results: ``g = let("g", expr)``. With
``columns(df)`` every name becomes a temporary column, so that it is computed once per row inside
generated code. With ``inline`` the formula folds into a single Column, usable anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Let = Callable[[str, Column], Column]


def inline(_name: str, expr: Column) -> Column:
    return expr


def together(let: Let, names, exprs) -> list[Column]:
    """Name several results that do not depend on each other, in one step."""
    exprs = dict(zip(names, exprs))
    return let.many(exprs) if isinstance(let, columns) else list(exprs.values())


class columns:
    def __init__(self, df: DataFrame, tag: str = ""):
        self.df, self.tag, self.names = df, tag, []

    def __call__(self, name: str, expr: Column) -> Column:
        return self.many({name: expr})[0]

    def many(self, exprs: dict[str, Column]) -> list[Column]:
        named = {f"_{self.tag}_{name}": e for name, e in exprs.items()}
        self.df = self.df.withColumns(named)
        self.names.extend(named)
        return [F.col(name) for name in named]

    def finish(self, **results: Column) -> DataFrame:
        """The frame with the results and without the intermediate columns.

        The results pass through a one-element ``inline``. Without it a filter or a join key on a
        result would be pushed below all the steps, each name replaced by its formula, and the
        expression would grow exponentially.
        """
        kept = [c for c in self.df.columns if c not in self.names and c not in results]
        row = F.struct(*(c.alias(name) for name, c in results.items()))
        return self.df.select(*kept, F.inline(F.array(row)))
