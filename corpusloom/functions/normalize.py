"""Score normalisation and numeric features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.views import MENTIONS_SQL, mentions


def softmax(score: Column, by: list[str]) -> Column:
    """exp(score) over its sum in the group, shifted by the group's largest score so that nothing overflows."""
    group = Window.partitionBy(*by)
    top = F.max(score).over(group)
    return F.exp(score - top) / F.sum(F.exp(score - top)).over(group)


def log_softmax(score: Column, by: list[str]) -> Column:
    """The logarithm of softmax, without the detour over a share that may be too small to hold."""
    group = Window.partitionBy(*by)
    top = F.max(score).over(group)
    return score - top - F.log(F.sum(F.exp(score - top)).over(group))


def sigmoid(score: Column, alpha: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-alpha * score))


def base_sigmoid(score: Column, base: float) -> Column:
    """1 / (1 + base ** -score); the score itself where base is 0."""
    return score if base == 0 else F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(float(base)), -score))


def log_of(normalised: Column) -> Column:
    return F.log(normalised)


def range_feature(value: Column, width: float) -> Column:
    """The two staggered buckets of a value."""
    low, mid = F.floor(value / width) * width, (F.floor(value / width + 0.5) - 0.5) * width
    return F.array(F.concat(F.lit("a"), F.round(low, 2).cast("string")), F.concat(F.lit("b"), F.round(mid, 2).cast("string")))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("doc", "mtype").agg((F.round(F.avg("v"), 4) / 10).alias("s"))


def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc", "mtype", F.round(softmax(F.col("s"), ["doc"]), 5).alias("p"))


def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _scores(spark, sf_dir).select("doc", "mtype", F.round(sigmoid(s, 2.0), 5).alias("p"), F.round(log_of(sigmoid(s)), 5).alias("log_p"), F.round(base_sigmoid(s, 3.0), 5).alias("q"))


def score_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type with the highest score, the smallest of equals."""
    best = _scores(spark, sf_dir).groupBy("doc").agg(F.min(F.struct((-F.col("s")).alias("s"), "mtype")).alias("b"))
    return best.select("doc", F.col("b.mtype").alias("best"))


def range_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of staggered bucket counts between even and odd entities."""
    rows = mentions(spark, sf_dir).select(F.explode(range_feature(F.col("v"), 5.0)).alias("bucket"), F.when(F.col("entity") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return rows.groupBy("bucket").agg(F.sum("sign").alias("n"))


_S = f"WITH {MENTIONS_SQL}, s AS (SELECT doc, mtype, round(avg(v), 4) / 10 AS s FROM mentions GROUP BY ALL)"
QUERIES = {f.__name__: f for f in (softmax_scores, sigmoid_scores, score_argmax, range_features)}
SQL = {
    "softmax_scores": f"{_S} SELECT doc, mtype, round(exp(s) / sum(exp(s)) OVER (PARTITION BY doc), 5) AS p FROM s",
    "sigmoid_scores": f"{_S} SELECT doc, mtype, round(1 / (1 + exp(-2 * s)), 5) AS p, round(ln(1 / (1 + exp(-s))), 5) AS log_p, round(1 / (1 + pow(3.0, -s)), 5) AS q FROM s",
    "score_argmax": f"{_S} SELECT doc, arg_min(mtype, (-s, mtype)) AS best FROM s GROUP BY 1",
    "range_features": f"""WITH {MENTIONS_SQL},
        b AS (SELECT unnest(['a' || round(floor(v / 5.0) * 5.0, 2)::VARCHAR, 'b' || round((floor(v / 5.0 + 0.5) - 0.5) * 5.0, 2)::VARCHAR]) AS bucket, CASE
        WHEN entity % 2 = 0 THEN 1 ELSE -1 END AS sign FROM mentions) SELECT bucket, sum(sign)::BIGINT AS n FROM b GROUP BY 1""",
}
