"""The training driver: specifications of learners, their order, cross-validation, rounds, metrics and evaluation.

A Learner names its label and its features as columns, and which other learners' predictions its features read. `train`
goes through them in that order: it predicts with those already trained, cross-validates, trains on all examples in
`rounds` passes, and keeps the weights as tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.analysis import SQL as ANALYSIS_SQL
from corpusloom.operators.analysis import bigram_differences
from corpusloom.operators.evaluate import kfold, random_folds
from corpusloom.operators.learners import STEP, _shown, _train_sql, coded, cross_validate, default_learner, examples, one_vs_all, score_rows, summary, train_groups, train_ids
from corpusloom.operators.learners import predict as argmax
from corpusloom.sources.views import mentions


@dataclass(frozen=True)
class Learner:
    """kind `binary` (label 0 or 1), `discrete` (any value, a network) or `real`; rule None: the default of the kind.

    evaluate: takes the columns score and target and gives the prediction instead of the usual one.
    """

    name: str
    label: Column
    features: Callable[[], Column]
    kind: str = "binary"
    rule: str | None = None
    parameters: dict = field(default_factory=dict)
    rounds: int = 1
    depends: tuple[str, ...] = ()
    evaluate: Callable[[Column, Column], Column] | None = None

    def settings(self) -> tuple[str, dict]:
        if self.rule is not None:
            return self.rule, dict(self.parameters)
        found = default_learner("real" if self.kind == "real" else "discrete") | self.parameters
        return found.pop("rule"), found


@dataclass
class Trained:
    """Weights by learner, and the summary of its cross-validation where there was one."""

    weights: dict[str, DataFrame]
    summaries: dict[str, DataFrame]


def in_order(learners: Sequence[Learner]) -> list[Learner]:
    """Learners after those they depend on; of a circle, and of what is free, the first in the given order comes first."""
    left, done, out = list(learners), set(), []
    known = {x.name for x in learners}
    while left:
        ready = next((x for x in left if all(d in done or d not in known for d in x.depends)), left[0])
        left.remove(ready)
        done.add(ready.name)
        out.append(ready)
    return out


def with_folds(rows: DataFrame, strategy: str, k: int, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """rows with `own`, the fold of each: sequential, kth or random, or manual: what the column `fold` says."""
    if strategy == "manual":
        return rows.withColumn("own", F.col("fold"))
    folds = random_folds(rows, key, k, seed) if strategy == "random" else kfold(rows, key, k).select(key, F.col(strategy).alias("fold"))
    return rows.join(folds.select(key, F.col("fold").alias("own")), key)


def selected(rows: DataFrame, fold: int, training: bool) -> DataFrame:
    """The rows (own) of a fold, or of all the others for training."""
    return rows.where(F.col("own") != fold if training else F.col("own") == fold)


def predictions(learner: Learner, rows: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, prediction of rows (doc_id, features)."""
    rule, given = learner.settings()
    scored = score_rows(rows, weights, given.get("start", 1.0 if rule == "winnow" else 0.0))
    threshold = given.get("threshold", 16.0 if rule == "winnow" else 0.0)
    if learner.evaluate is not None:
        return scored.select("doc_id", learner.evaluate(F.col("score") - threshold, F.col("target")).alias("prediction"))
    if learner.kind == "discrete":
        return argmax(scored)
    if learner.kind == "real":
        return scored.select("doc_id", F.col("score").alias("prediction"))
    return scored.select("doc_id", (F.col("score") >= threshold).cast("int").alias("prediction"))


def train(rows: DataFrame, learners: Sequence[Learner], k: int = 0, strategy: str = "kth", alpha: float = 0.05, metric: Callable[[DataFrame], Column] | None = None, pre_extract: bool = False) -> Trained:
    """Trains all learners on rows (doc_id, idx and what their columns read).

    A learner's features may read a column `predicted_NAME` of each learner it depends on. k folds of cross-validation
    come first for binary learners; metric: from rows (fold, hits, tested) to a column, accuracy if it isn't given. pre_extract: features are first replaced by
    ids of a lexicon, and units are dense vectors; the weights are the same.
    """
    weights, summaries = {}, {}
    for learner in in_order(learners):
        rule, given = learner.settings()
        own = rows.withColumns({"features": learner.features(), "y": learner.label, "target": F.lit(learner.name)})
        if k and learner.kind == "binary":
            folds = cross_validate(with_folds(own, strategy, k), k, rule, learner.rounds, **given)
            summaries[learner.name] = summary(folds if metric is None else folds.select("fold", metric(folds).alias("hits"), F.lit(1).alias("tested")), alpha)
        if learner.kind == "discrete":
            made = one_vs_all(own.withColumn("label", learner.label), "label", rule, learner.rounds, **given)
        elif pre_extract:
            made = train_ids(*coded(own.select("target", "idx", "features", "y")), rule, learner.rounds, **given)
        else:
            made = train_groups(own, rule, learner.rounds, **given)
        weights[learner.name] = made
        if any(learner.name in x.depends for x in learners):
            rows = rows.join(predictions(learner, own.select("doc_id", "features"), made).withColumnRenamed("prediction", f"predicted_{learner.name}"), "doc_id")
    return Trained(weights, summaries)


def _chain() -> list[Learner]:
    """Quality from word ends; then toxicity from these and the predicted quality. Given in the wrong order."""
    toxic = Learner("toxic", F.col("toxic"), lambda: F.concat(F.col("features"), F.array(F.concat(F.lit("quality="), F.col("predicted_quality").cast("string")))),
        rule="perceptron", parameters={"rate": STEP}, depends=("quality",))
    return [toxic, Learner("quality", F.col("quality"), lambda: F.col("features"), rule="perceptron", parameters={"rate": STEP}, rounds=2)]


def training_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, feature, weight of both learners of the chain, without weights of 0."""
    trained = train(examples(spark, sf_dir), _chain())
    return trained.weights["quality"].unionByName(trained.weights["toxic"]).where(F.col("feature").isNull() | (F.col("weight") != 0))


def cross_validation_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, accuracy, mean, std, half of the perceptron on quality, over four random folds."""
    quality = Learner("quality", F.col("quality"), lambda: F.col("features"), rule="perceptron", parameters={"rate": STEP})
    return train(examples(spark, sf_dir), [quality], 4, "random").summaries["quality"]


def coherence_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, feature, weight of the averaged perceptron that tells a document from its shuffled copy by the differences of
    their grid and chain bigrams, a real feature for each gram; every second pair is turned round."""
    turned = F.col("doc").cast("long") % 2 == 1
    grams = bigram_differences(mentions(spark, sf_dir))
    each = grams.select("doc", F.struct(F.concat("kind", F.lit(":"), "gram").alias("f"), F.when(turned, -F.col("diff")).otherwise(F.col("diff")).cast("double").alias("s")).alias("x"))
    rows = each.groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = rows.select(F.lit("coherent").alias("target"), F.col("doc").cast("long").alias("idx"), F.col("x.f").alias("features"), F.col("x.s").alias("strengths"), F.when(turned, 0).otherwise(1).alias("y"))
    return _shown(train_groups(rows, "averaged", rounds=2, rate=STEP))


def _coherence_sql() -> str:
    add = "list_transform(list_zip(w, x), lambda p: p[1] + step * p[2])"
    return f"""{ANALYSIS_SQL["coherence_features"].replace("WITH", "WITH RECURSIVE", 1).replace(" SELECT * FROM (SELECT coalesce", ", diffs AS (SELECT * FROM (SELECT coalesce", 1)}),
        each AS (SELECT doc::BIGINT AS d, kind || ':' || gram AS f, CASE WHEN doc::BIGINT % 2 = 1 THEN -diff ELSE diff END::DOUBLE AS s FROM diffs WHERE kind IN ('grid2', 'chain2')),
        voc AS (SELECT list(f ORDER BY f) AS v FROM (SELECT DISTINCT f FROM each)),
        maps AS (SELECT d, map_from_entries(list({{'k': f, 'v': s}})) AS m FROM each GROUP BY 1),
        dense AS (SELECT d, row_number() OVER (ORDER BY d) AS k, (d % 2 = 0)::INT AS y, list_transform(v, lambda f: coalesce(m[f], 0.0)::DOUBLE) AS x FROM maps, voc),
        turns AS (SELECT k + t * (SELECT count(*) FROM dense) AS k, x, y FROM dense, (SELECT unnest([0, 1]) AS t)),
        run AS (
            SELECT 0::BIGINT AS k, list_transform(v, lambda f: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b, list_transform(v, lambda f: 0.0::DOUBLE) AS late, 0.0::DOUBLE AS late_b FROM voc
            UNION ALL
            SELECT k + 1, {add}, b + step, list_transform(list_zip(late, x), lambda p: p[1] + k * step * p[2]), late_b + k * step
            FROM (SELECT *, (CASE WHEN y = 1 AND s < 6 THEN {STEP} WHEN y = 0 AND s >= -6 THEN -{STEP} ELSE 0.0 END)::DOUBLE AS step
                FROM (SELECT r.*, t.x, t.y, list_dot_product(r.w, t.x) + r.b AS s FROM run r JOIN turns t ON t.k = r.k + 1))),
        final AS (SELECT k AS n, w, b, late, late_b FROM run QUALIFY k = max(k) OVER ())
        SELECT * FROM (SELECT 'coherent' AS target, v[i] AS feature, round((n * w[i] - late[i]) / n, 6) AS weight FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM final), voc) WHERE weight <> 0
        UNION ALL SELECT 'coherent', NULL, round((n * b - late_b) / n, 6) FROM final"""


def _driver_sql() -> str:
    """Both chains of updates, the second over the features and the first's prediction."""
    first = _train_sql("perceptron", "SELECT 'quality' AS target, idx, doc_id, quality AS y, 0 AS first FROM docs", 2)
    add = "list_transform(list_zip(w, x), lambda p: p[1] + step * p[2])"
    return f"""{first},
        guess AS (SELECT doc_id, 'quality=' || (list_dot_product(w, x) + b >= 0)::INT AS f FROM dense, final),
        voc2 AS (SELECT list_concat(v, ['quality=0', 'quality=1']) AS v FROM voc),
        dense2 AS (SELECT doc_id, list_concat(x, [(f = 'quality=0')::INT::DOUBLE, (f = 'quality=1')::INT::DOUBLE]) AS x FROM dense JOIN guess USING (doc_id)),
        run2 AS (
            SELECT 0::BIGINT AS k, list_transform(v, lambda f: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b FROM voc2
            UNION ALL
            SELECT k + 1, {add}, b + step FROM (SELECT *, (CASE WHEN toxic = 1 AND s < 0 THEN {STEP} WHEN toxic = 0 AND s >= 0 THEN -{STEP} ELSE 0.0 END)::DOUBLE AS step
                FROM (SELECT r.*, t.toxic, d.x, list_dot_product(r.w, d.x) + r.b AS s FROM run2 r JOIN docs t ON t.idx = r.k JOIN dense2 d USING (doc_id)))),
        final2 AS (SELECT w, b FROM run2 QUALIFY k = max(k) OVER ())
        SELECT * FROM (SELECT 'quality' AS target, v[i] AS feature, w[i] AS weight FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM final), voc) WHERE weight <> 0
        UNION ALL SELECT 'quality', NULL, b FROM final
        UNION ALL SELECT * FROM (SELECT 'toxic', v[i], w[i] AS weight FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM final2), voc2) WHERE weight <> 0
        UNION ALL SELECT 'toxic', NULL, b FROM final2"""


def _random_sql() -> str:
    from corpusloom.operators.learners import t_quantile

    folds = "(SELECT doc_id, ntile(4) OVER (ORDER BY md5(doc_id || ':7'), doc_id) - 1 AS own FROM docs)"
    targets = f"SELECT f::VARCHAR AS target, idx, d.doc_id, quality AS y, 0 AS first FROM docs d JOIN {folds} o USING (doc_id), (SELECT unnest(range(4)) AS f) WHERE own <> f"
    return f"""{_train_sql("perceptron", targets, 1)},
        tested AS (SELECT target::BIGINT AS fold, (list_dot_product(w, x) + b >= 0) = (quality = 1) AS hit FROM final, docs JOIN dense USING (doc_id) JOIN {folds} o USING (doc_id) WHERE own = target::BIGINT),
        folds AS (SELECT fold, avg(hit::INT) AS a FROM tested GROUP BY 1), s AS (SELECT avg(a) AS m, stddev_samp(a) AS d, count(*) AS k FROM folds)
        SELECT fold, round(a, 5) AS accuracy, round(m, 5) AS mean, round(d, 5) AS std, round({t_quantile(3, 0.05)!r} * d / sqrt(k), 5) AS half FROM folds, s"""


QUERIES = {f.__name__: f for f in (training_driver, cross_validation_random, coherence_learner)}
SQL = {"training_driver": _driver_sql(), "cross_validation_random": _random_sql(), "coherence_learner": _coherence_sql()}
