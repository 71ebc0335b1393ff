"""Values of an operand: a set of strings as array<string>, or one string (null: none), which stays within code generation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Values:
    col: Column
    many: bool = True
    #: Whether the values are what a measure has made of the texts, in which a null is a value that it can't read.
    prepared: bool = False

    def each(self, f: Callable[[Column], Column]) -> Values:
        """f of every value; a set stays a set. f maps no string to null."""
        return Values(F.array_distinct(F.transform(self.col, f)), True) if self.many else Values(f(self.col), False)

    def as_array(self) -> Column:
        """The set, empty where there is none, without nulls."""
        if self.prepared:
            return self.col if self.many else F.array(self.col)
        if self.many:
            return F.coalesce(F.filter(self.col, lambda v: v.isNotNull()), F.array().cast("array<string>"))
        return F.when(self.col.isNull(), F.array().cast("array<string>")).otherwise(F.array(self.col))

    def present(self) -> Column:
        """Whether there is any value."""
        return F.coalesce(F.size(self.col) > 0, F.lit(False)) if self.many else self.col.isNotNull()
