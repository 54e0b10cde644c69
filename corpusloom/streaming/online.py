"""Streams: counts, windowed counts, and learners whose state outlives a batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.learners import STEP, UNITS, _shown, _train_sql
from corpusloom.sources.shared import shared_path
from corpusloom.sources.views import WORDS_SQL, split_words, table


def streamed_counts(stream: DataFrame) -> DataFrame:
    """label, feature, n of a stream of (label, features): the counts of naive Bayes, kept up to date."""
    return stream.select("label", F.explode("features").alias("feature")).groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """window, event_type, n; rows later than `late` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def streamed_learner(stream: DataFrame, rule: str = "perceptron", **given) -> DataFrame:
    """target, seen, feature, weight (feature null for the bias) after each batch, of a stream of (target, idx, features, y).

    A target's unit is the state of its key; examples of a batch are learned from in the order of idx.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        unit = pickle.loads(state.get[0]) if state.exists else UNITS[rule](**given)
        rows = pd.concat(list(frames)).sort_values("idx")  # one batch of one target
        for x, y in zip(rows["features"], rows["y"], strict=True):
            unit.learn(dict.fromkeys(x, 1.0), y)
        state.update((pickle.dumps(unit),))
        weights, bias = unit.averages()
        made = [(key[0], unit.n, None, float(bias)), *[(key[0], unit.n, f, float(w)) for f, w in sorted(weights.items())]]
        yield pd.DataFrame(made, columns=["target", "seen", "feature", "weight"])

    rows = stream.select("target", "idx", "features", F.col("y").cast("double").alias("y"))
    return rows.groupBy("target").applyInPandasWithState(run, "target string, seen long, feature string, weight double", "unit binary", "update", "NoTimeout")


def saving(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's rows as a table of its own below path, so that a model is saved as it grows."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return save


# ------------------------------------------------------------------------------------------- versions over a table


class VersionedUnit(StatefulProcessor):
    """A learner's unit for each target as one row of state (version, unit): the version is the largest idx that it has learned from,
    so an example that comes again, as when a batch is repeated, changes nothing. Examples of a batch are learned from in the order
    of idx; a batch's examples of one target are held together, so the source's batches bound what a task holds."""

    def __init__(self, rule: str, given: dict):
        self.rule, self.given = rule, given

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("unit", "version long, unit binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, unit = self.state.get() if self.state.exists() else (None, None)
        unit = UNITS[self.rule](**self.given) if unit is None else pickle.loads(unit)
        fresh = []
        for frame in rows:
            fresh += [(i, list(x), y) for i, x, y in zip(frame["idx"].tolist(), frame["features"], frame["y"].tolist(), strict=True) if version is None or i > version]
        if not fresh:
            return
        last = version
        for i, x, y in sorted(fresh, key=lambda r: r[0]):
            if i != last:  # an example that is twice in a batch counts once
                unit.learn(dict.fromkeys(x, 1.0), y)
                last = i
        self.state.update((last, pickle.dumps(unit)))
        weights, bias = unit.averages()
        made = [(key[0], last, None, float(bias)), *[(key[0], last, f, float(w)) for f, w in sorted(weights.items())]]
        yield pd.DataFrame(made, columns=["target", "version", "feature", "weight"])

    def close(self) -> None:
        pass


def versioned_learner(stream: DataFrame, rule: str = "perceptron", **given) -> DataFrame:
    """target, version, feature, weight (feature null for the bias) whenever a target has learned something, of a stream of (target, idx, features, y)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select("target", "idx", "features", F.col("y").cast("double").alias("y"))
    return rows.groupBy("target").transformWithStateInPandas(VersionedUnit(rule, given), "target string, version long, feature string, weight double", "Update", "None")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream gives until its source's end, with `batch`, the number of the batch they came in: each batch is a folder of its own, written over
    when it is repeated, so that reading them is as good as the stream."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.outputMode("update").foreachBatch(saving(f"{path}/rows")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in stream.dtypes)}, batch long").parquet(f"{path}/rows")


def latest(rows: DataFrame, keys: list[str], version: str = "batch") -> DataFrame:
    """Of the rows of each key, those of the highest version."""
    top = rows.groupBy(*keys).agg(F.max(version).alias("_top"))
    return rows.join(top, keys).where(F.col(version) == F.col("_top")).drop("_top")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a stream, beside the stored labels."""
    docs = spark.readStream.schema("doc_id long, text string").parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may stand for a file or a folder
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def streamed_nb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, feature, n: words of labelled documents, counted by a stream that is run to the table's end."""
    rows = _labelled(spark, sf_dir).select(F.col("quality").cast("string").alias("label"), F.flatten(F.transform(F.split("text", "\n"), split_words)).alias("features"))
    return latest(run_to_end(streamed_counts(rows), "counts"), ["label", "feature"]).drop("batch")


def streamed_perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, feature, weight of the perceptron on quality after one pass of the stream, without weights of 0."""
    ends = F.array_sort(F.array_distinct(F.transform(split_words(F.regexp_replace("text", "\n", " ")), lambda w: F.substring(w, -2, 2))))
    rows = _labelled(spark, sf_dir).select(F.lit("quality").alias("target"), F.col("doc_id").alias("idx"), ends.alias("features"), F.col("quality").alias("y"))
    return _shown(latest(run_to_end(versioned_learner(rows, rate=STEP), "perceptron"), ["target"], "version").drop("batch"))


QUERIES = {f.__name__: f for f in (streamed_nb_counts, streamed_perceptron)}
SQL = {
    "streamed_nb_counts": f"WITH {WORDS_SQL} SELECT quality::VARCHAR AS label, form AS feature, count(*) AS n FROM words JOIN labels USING (doc_id) GROUP BY ALL",
    "streamed_perceptron": f"""{_train_sql("perceptron", "SELECT 'quality' AS target, idx, doc_id, quality AS y, 0 AS first FROM docs", 1)}
        SELECT * FROM (SELECT 'quality' AS target, v[i] AS feature, w[i] AS weight FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM final), voc) WHERE weight <> 0 UNION ALL SELECT 'quality', NULL, b FROM final""",
}
