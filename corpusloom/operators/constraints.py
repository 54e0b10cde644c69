"""First-order constraints over classifier outputs: evaluated as SQL booleans, or solved as a 0-1 program.

A constraint is a tree of tuples: ("is", var, value), ("not", c), ("and", c, ...), ("or", c, ...), ("implies", a, b),
("iff", a, b), ("atleast", m, c, ...), ("atmost", m, c, ...), ("const", bool). `forall` is an "and" over a collection,
`exists` an "or"; over nothing they are true and false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.coref import _P, pairs
from corpusloom.sources.views import mentions

UNKNOWN = None


def truth(c: tuple, values: dict) -> bool | None:
    """The constraint's value under a partial assignment; None while it is open."""
    kind = c[0]
    if kind == "const":
        return c[1]
    if kind == "is":
        return None if c[1] not in values else values[c[1]] == c[2]
    if kind == "not":
        inner = truth(c[1], values)
        return None if inner is None else not inner
    if kind == "implies":
        return truth(("or", ("not", c[1]), c[2]), values)
    if kind == "iff":
        a, b = truth(c[1], values), truth(c[2], values)
        return None if a is None or b is None else a == b
    if kind == "and":
        return truth(("atleast", len(c) - 1, *c[1:]), values)
    if kind == "or":
        return truth(("atleast", 1, *c[1:]), values)
    if kind == "atmost":
        inner = truth(("atleast", c[1] + 1, *c[2:]), values)
        return None if inner is None else not inner
    if kind == "atleast":
        found = [truth(x, values) for x in c[2:]]
        yes = sum(x is True for x in found)
        if yes >= max(0, c[1]):
            return True
        return False if yes + sum(x is None for x in found) < c[1] else None
    raise ValueError(f"unknown constraint {kind!r}")


def solve(scores: dict, constraints: list[tuple]) -> tuple[dict, float, bool]:
    """The assignment of one value for each variable with the highest total score under all constraints.

    scores: variable to {value: score}. Exact branch and bound, the bound being the best scores of open variables; ties
    go to the smaller values. The last item tells whether there is any solution.
    """
    order = sorted(scores, key=lambda v: (-(max(scores[v].values()) - min(scores[v].values())), str(v)))
    rest = [0.0]
    for v in reversed(order):
        rest.append(rest[-1] + max(scores[v].values()))
    rest.reverse()
    ranked = [sorted(scores[v].items(), key=lambda x: (-x[1], str(x[0]))) for v in order]
    best: tuple[dict, float, bool] = ({}, float("-inf"), False)
    open_ = [(0, 0.0, ())]  # branches to try, the next one last: place, total, the values up to that place
    while open_:
        at, total, own = open_.pop()
        if total + rest[at] <= best[1]:
            continue
        values = dict(zip(order, own, strict=False))
        if any(truth(c, values) is False for c in constraints):
            continue
        if at == len(order):
            best = (values, total, True)
            continue
        open_ += [(at + 1, total + score, (*own, value)) for value, score in reversed(ranked[at])]
    return best


def linearize(c: tuple, rows: list, helpers: dict) -> tuple:
    """Rows (coefficients, op, bound) of a 0-1 program that force the constraint's literal; returns (name, sign).

    Literals are ("is", var, value); each composite gets a helper variable shared by equal composites.
    """
    kind = c[0]
    if kind == "is":
        return c, 1
    if kind == "not":
        name, sign = linearize(c[1], rows, helpers)
        return name, -sign
    if kind == "implies":
        return linearize(("or", ("not", c[1]), c[2]), rows, helpers)
    if kind == "iff":
        return linearize(("or", ("and", c[1], c[2]), ("and", ("not", c[1]), ("not", c[2]))), rows, helpers)
    if kind == "atmost":
        return linearize(("not", ("atleast", c[1] + 1, *c[2:])), rows, helpers)
    if kind == "and":
        return linearize(("atleast", len(c) - 1, *c[1:]), rows, helpers)
    if kind == "or":
        return linearize(("atleast", 1, *c[1:]), rows, helpers)
    m = 0 if kind == "const" and c[1] else 1 if kind == "const" else max(0, c[1])
    parts = [linearize(x, rows, helpers) for x in (() if kind == "const" else c[2:])]
    key = ("helper", m, tuple(parts))
    if key not in helpers:
        helpers[key] = ("z", len(helpers))
        z, n, low = helpers[key], len(parts), sum(s < 0 for _, s in parts)
        rows.append(([*parts, (z, -m)], ">=", -low))  # z needs m of the parts
        rows.append(([*parts, (z, -(n - m + 1))], "<=", m - 1 - low))  # m parts force z
    return helpers[key], 1


def _forall(made: DataFrame) -> DataFrame:
    return made.groupBy("doc", "idx").agg(F.bool_and(F.col("score") > 0).alias("holds"))


def _exists(made: DataFrame) -> DataFrame:
    return made.groupBy("doc", "idx").agg(F.bool_or(F.col("score") > 8).alias("holds"))


def _atleast(made: DataFrame) -> DataFrame:
    return made.groupBy("doc", "idx").agg((F.sum((F.col("score") > 5).cast("int")) >= 2).alias("holds"))


def _atmost(made: DataFrame) -> DataFrame:
    return made.groupBy("doc", "idx").agg((F.sum((F.col("score") > 8).cast("int")) <= 1).alias("holds"))


def _no_error(made: DataFrame) -> DataFrame:
    return made.groupBy("doc", "idx").agg((~F.bool_or((F.col("score") > 8) & (F.col("mtype") != "error") & (F.col("prev_type") == "error"))).alias("holds"))


def constraint_forall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forall(pairs(mentions(spark, sf_dir)))


def constraint_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exists(pairs(mentions(spark, sf_dir)))


def constraint_atleast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atleast(pairs(mentions(spark, sf_dir)))


def constraint_atmost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atmost(pairs(mentions(spark, sf_dir)))


def no_link_to_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other types may not link to `error`: not exists (link and previous type)."""
    return _no_error(pairs(mentions(spark, sf_dir)))


def best_links(linked: DataFrame) -> DataFrame:
    """doc, sent, links, total, optimal of the 0-1 program over pairs: a link is worth score - 5, each mention has at most
    one, an `error` mention that has a choice must link.

    No rule names two mentions, so the program falls apart by idx: the best link of a mention is taken if it is worth
    more than none or has to be. This is the optimum `solve` finds, ties going to no link, at any number of mentions.
    """
    best = linked.groupBy("doc", "sent", "idx", "mtype").agg((F.max("score") - 5.0).alias("worth"))
    taken = (F.col("worth") > 0) | (F.col("mtype") == "error")
    return best.groupBy("doc", "sent").agg(F.count_if(taken).alias("links"), F.round(F.sum(F.when(taken, F.col("worth")).otherwise(0.0)), 4).alias("total"), F.lit(True).alias("optimal"))


def ilp_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each sentence's mentions to any earlier ones of the document: at most one for each, an `error` mention must link."""
    return best_links(pairs(mentions(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (constraint_forall, constraint_exists, constraint_atleast, constraint_atmost, no_link_to_error, ilp_inference)}
SQL = {
    "constraint_forall": f"{_P} SELECT doc, idx, bool_and(score > 0) AS holds FROM pairs GROUP BY 1, 2",
    "constraint_exists": f"{_P} SELECT doc, idx, bool_or(score > 8) AS holds FROM pairs GROUP BY 1, 2",
    "constraint_atleast": f"{_P} SELECT doc, idx, count(*) FILTER (score > 5) >= 2 AS holds FROM pairs GROUP BY 1, 2",
    "constraint_atmost": f"{_P} SELECT doc, idx, count(*) FILTER (score > 8) <= 1 AS holds FROM pairs GROUP BY 1, 2",
    "no_link_to_error": f"{_P} SELECT doc, idx, NOT bool_or(score > 8 AND mtype <> 'error' AND prev_type = 'error') AS holds FROM pairs GROUP BY 1, 2",
    "ilp_inference": f"""{_P}, b AS (SELECT doc, sent, idx, mtype, max(score) - 5.0 AS worth FROM pairs GROUP BY ALL), t AS (SELECT doc, sent, worth, worth > 0 OR mtype = 'error' AS taken FROM b)
        SELECT doc, sent, count(*) FILTER (taken) AS links, round(sum(CASE WHEN taken THEN worth ELSE 0.0 END), 4) AS total, true AS optimal FROM t GROUP BY ALL""",
}
