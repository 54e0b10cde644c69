"""Generators as table functions of the session's catalog, found by name and applied in SQL by a lateral join."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.features import FLAGS, _BOTH, _f
from corpusloom.sources.views import table

_ROW = "id STRING, value STRING, strength DOUBLE, array_place INT, array_length INT, place INT, total INT"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_LIST = f"ARRAY<STRUCT<{_ROW.replace(' ', ': ').replace(',: ', ', ')}>>"


@dataclass(frozen=True)
class Generator:
    """A table function `name(inputs)`: for each sense a feature `name:sense`.

    senses: the value of each sense as a SQL expression over the inputs, or None for what is merely sensed (`true`, or 1 for real
    features); a sense whose value is null has no row. kind: discrete or real. arrays: senses whose value is an array of
    numbers, a real feature for each place. domains: the allowed values of a sense, in order.
    """

    name: str
    inputs: Mapping[str, str]
    senses: Mapping[str, str | None]
    kind: str = "discrete"
    arrays: Sequence[str] = ()
    domains: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def sql(self) -> list[str]:
        """What defines `name_features`, the features as an array, which is an expression to the optimiser, and `name`, their table."""
        inputs = ", ".join(f"{k} {t}" for k, t in self.inputs.items())
        parts = ", ".join(self._features(sense, value) for sense, value in self.senses.items())
        return [
            f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}_features({inputs}) RETURNS {_LIST} RETURN CAST(filter(concat({parts}), x -> x IS NOT NULL) AS {_LIST})",
            f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({inputs}) RETURNS TABLE ({_ROW}) RETURN SELECT f.* FROM (SELECT {self.name}_features({', '.join(self.inputs)}) AS fs) LATERAL VIEW inline(fs) f",
        ]

    def _features(self, sense: str, value: str | None) -> str:
        """An array of the features of a sense, null in place of one that isn't sensed."""
        name = f"'{self.name}:{sense}'"
        if sense in self.arrays:
            return f"transform({value}, (x, i) -> {_struct(name, 'CAST(NULL AS STRING)', 'CAST(x AS DOUBLE)', 'i', f'size({value})', '-1', '0')})"
        domain = list(self.domains.get(sense, ()))
        place = f"CAST(array_position(array({', '.join(repr(x) for x in domain)}), {value}) - 1 AS INT)" if domain else "-1"
        given = value or ("'true'" if self.kind == "discrete" else "1.0D")
        text, strength = (f"CAST({given} AS STRING)", "1.0D") if self.kind == "discrete" else ("CAST(NULL AS STRING)", f"CAST({given} AS DOUBLE)")
        return f"array(CASE WHEN {given} IS NOT NULL THEN {_struct(name, text, strength, 'CAST(NULL AS INT)', 'CAST(NULL AS INT)', place, str(len(domain)))} END)"


def _struct(*values: str) -> str:
    return f"named_struct({', '.join(f'{n!r}, {v}' for n, v in zip(_NAMES, values, strict=True))})"


def register(spark: SparkSession, *generators: Generator) -> None:
    for g in generators:
        for text in g.sql():
            spark.sql(text)


def applied(df: DataFrame, keep: Sequence[str], calls: Mapping[str, Sequence[str]]) -> DataFrame:
    """keep and the features of every named generator, called with columns of df, in one pass over its rows. A name that the
    catalog doesn't have is refused."""
    spark = df.sparkSession
    for name in calls:
        if not spark.catalog.functionExists(f"{name}_features"):
            raise LookupError(f"no classifier is registered as {name}")
    view = f"rows_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    lists = ", ".join(f"{name}_features({', '.join(columns)})" for name, columns in calls.items())
    return spark.sql(f"SELECT {', '.join(keep)}, f.* FROM (SELECT {', '.join(keep)}, concat({lists}) AS _features FROM {view}) LATERAL VIEW inline(_features) f")


def _generators() -> list[Generator]:
    return [
        Generator("g", {"amount": "DOUBLE"}, {"seen": None, "heavy": "CASE WHEN amount > 40 THEN 'yes' END"}), Generator("r", {"amount": "DOUBLE"}, {"one": None}, "real"),
        Generator("s", {"discount": "DOUBLE", "tax": "DOUBLE"}, {"both": "array(discount, tax)"}, "real", arrays=["both"]), Generator("q", {"flag": "STRING"}, {"flag": "flag"}, domains={"flag": FLAGS}),
    ]


def registered_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of generator_defaults, by four registered table functions in one statement of SQL."""
    register(spark, *_generators())
    calls = {"g": ["l_quantity"], "r": ["l_quantity"], "s": ["l_discount", "l_tax"], "q": ["l_returnflag"]}
    return applied(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], calls).selectExpr("l_orderkey", "l_linenumber", "id", "value", "round(strength, 6) AS strength", "array_place", "array_length", "place", "total")


QUERIES = {"registered_generators": registered_generators}
SQL = {"registered_generators": " UNION ALL ".join([
    _f("'g:seen'", "'true'"), _f("'g:heavy'", "'yes'", where=" WHERE l_quantity > 40"), _f("'r:one'"), *[_f("'s:both'", strength=_BOTH[i], at=str(i), length="2") for i in (0, 1)],
    _f("'q:flag'", "l_returnflag", place="list_position(['A', 'N', 'R'], l_returnflag) - 1", total="3"),
])}
