"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions import normalize, split
from corpusloom.operators import analysis, bayes, constraints, coref, evaluate, extract, grounding, inference, intervals, learners, merging, training
from corpusloom.plans import catalog, features, files
from corpusloom.streaming import online

_MODULES = (extract, bayes, evaluate, coref, constraints, normalize, learners, split, features, analysis, inference, training, intervals, merging, grounding, files, catalog, online)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words, naive Bayes, predictions, and precision and recall by label."""
    labels, _ = bayes.examples(spark, sf_dir)
    guessed = bayes.nb_predict(spark, sf_dir).join(labels, "doc_id")
    return evaluate.prf(guessed.select(guessed.label.alias("gold"), guessed.prediction.alias("pred")))
