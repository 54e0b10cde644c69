"""Classifier specifications: named feature expressions that combine and compile to one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds from narrow to wide; each holds the ones before it.
KINDS = ("discrete", "discrete[]", "discrete%", "mixed%")


@dataclass(frozen=True)
class Classifier:
    """A feature expression; scalars give one value, lists and generators an array of values."""

    name: str
    expression: Callable[[], Column]
    kind: str = "discrete"

    def values(self) -> Column:
        """The values as an array."""
        return F.array(self.expression()) if self.kind == "discrete" else self.expression()

    def features(self) -> Column:
        """array<struct<id, value>>."""
        return F.transform(self.values(), lambda v: F.struct(F.lit(self.name).alias("id"), v.cast("string").alias("value")))

    def __and__(self, other: Classifier) -> Classifier:
        """Conjunction: all pairs of values; a classifier with itself skips equal pairs."""
        both = lambda: F.flatten(F.transform(self.values(), lambda x: F.transform(other.values(), lambda y: F.when((x != y) if self == other else F.lit(True), F.concat_ws("&",
            x.cast("string"), y.cast("string"))))))
        return Classifier(f"{self.name}&{other.name}", lambda: F.filter(both(), lambda v: v.isNotNull()), max(self.kind, other.kind, "discrete[]", key=KINDS.index))

    def cast(self, kind: str) -> Classifier:
        """The same values under a wider kind."""
        if KINDS.index(kind) < KINDS.index(self.kind):
            raise TypeError(f"{self.name}: {self.kind} doesn't fit into {kind}")
        return Classifier(self.name, self.values if self.kind == "discrete" != kind else self.expression, kind)

    def equals(self, value: str) -> Column:
        """Whether any value equals the given one."""
        return F.exists(self.values(), lambda v: v.cast("string") == value)


def extract(df: DataFrame, *classifiers: Classifier) -> DataFrame:
    """df with `features`, those of all classifiers one after another, in a single projection."""
    return df.withColumn("features", F.concat(*[c.features() for c in classifiers]))


def extract_once(df: DataFrame, *classifiers: Classifier) -> DataFrame:
    """As extract, kept in memory or on disk after its first use; call unpersist() when it is no longer needed."""
    return extract(df, *classifiers).persist()
