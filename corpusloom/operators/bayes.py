"""Naive Bayes as relational counts: everything is a group-by and a join, so training and scoring are distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.lexing import counted
from corpusloom.sources.shared import kept
from corpusloom.sources.views import WORDS_SQL, all_words, table, unfolded, words

SMOOTHING = -15.0
#: A feature is frequent if it is more than one of HEAD labelled ones; so there are fewer than HEAD such features, whatever the corpus.
HEAD = 20_000


def examples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, label) and (doc_id, feature) of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return labels, words(table(spark, sf_dir, "documents")).select("doc_id", F.col("form").alias("feature"))


def text_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, label) of labelled documents, and doc_id, bag of each text: its words, counted inside the row."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return labels, table(spark, sf_dir, "documents").select("doc_id", counted(all_words(F.col("text"))).alias("bag"))


def kept_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """text_bags(), counted once and kept in the shared folder, as training and scoring read them."""
    labels, texts = text_bags(spark, sf_dir)
    return labels, kept(texts, "bags")


def rows_of(texts: DataFrame, *more: str) -> DataFrame:
    """feature, times of each bag beside the columns named."""
    each = unfolded(texts.select(*more, F.col("bag").alias("x")), "x")
    return each.select(*more, F.col("x.form").alias("feature"), F.col("x.times").alias("times"))


def fit_texts(labels: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prior counts by label and counts by (label, feature): labels meet texts, and what is shuffled are sums."""
    counts = rows_of(texts.join(labels, "doc_id"), "label").groupBy("label", "feature").agg(F.sum("times").alias("n"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("prior")), counts


def scores(texts: DataFrame, priors: DataFrame, counts: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, label, score: (1 - T) log prior + the sum over features of log count, or log prior + smoothing if unseen.

    T is the number of features plus the label. The sum over unseen features follows from the number of features, so
    joins are inner ones. Frequent features, fewer than HEAD, are sent to the texts, whose rows for them are added up in their
    tasks; only rows of the others are shuffled, to the counts of those. Labels, one row each, are put beside each document as a literal.
    """
    held = priors.collect()
    label = F.explode(F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.lit(r["prior"]).alias("prior")) for r in held]))
    size = F.aggregate("bag", F.lit(0).cast("long"), lambda a, x: a + x["times"])
    sizes = texts.where(F.size("bag") > 0).groupBy("doc_id").agg(F.sum(size).alias("size"))
    counts = kept(counts, "counts")
    by = counts.groupBy("feature").agg(F.collect_list(F.struct("label", F.log("n").alias("log"))).alias("units"), F.sum("n").alias("all"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    head, tail = F.broadcast(by.where(F.col("all") * HEAD > total).select("feature", "units")), by.where(F.col("all") * HEAD <= total).select("feature", "units")
    rows = rows_of(texts, "doc_id")
    rare = rows.join(head.select("feature"), "feature", "left_anti")
    met = rows.join(head, "feature").unionByName(rare.join(tail, "feature"))
    each = met.select("doc_id", "times", F.explode("units").alias("u"))
    seen = each.groupBy("doc_id", F.col("u.label").alias("label")).agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.col("u.log")).alias("logs"))
    every = sizes.withColumn("_l", label).select("doc_id", "size", "_l.label", "_l.prior") if held else sizes.where("false").select("doc_id", "size", F.lit("").alias("label"), F.lit(1).alias("prior"))
    every = every.join(seen, ["doc_id", "label"], "left")
    known, logs = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    value = -F.col("size") * F.log("prior") + logs + (F.col("size") - known) * (F.log("prior") + smoothing)
    return every.select("doc_id", "label", value.alias("score"))


def nb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_texts(*text_bags(spark, sf_dir))[1]


def nb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, texts = kept_bags(spark, sf_dir)
    return scores(texts, *fit_texts(labels, texts)).select("doc_id", "label", F.round("score", 3).alias("score"))


def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, prediction; ties go to the smallest label."""
    labels, texts = kept_bags(spark, sf_dir)
    best = scores(texts, *fit_texts(labels, texts)).groupBy("doc_id").agg(F.min(F.struct((-F.round("score", 6)).alias("s"), "label")).alias("b"))
    return best.select("doc_id", F.col("b.label").alias("prediction"))


_BASE = f"""WITH {WORDS_SQL}, lab AS (SELECT doc_id, quality::VARCHAR AS label FROM labels),
    counts AS (SELECT label, form AS feature, count(*) AS n FROM words JOIN lab USING (doc_id) GROUP BY ALL),
    priors AS (SELECT label, count(*) AS prior FROM lab GROUP BY 1),
    scored AS (SELECT w.doc_id, p.label, -count(*) * ln(p.prior) + sum(coalesce(ln(c.n), ln(p.prior) - 15.0)) AS score
        FROM words w CROSS JOIN priors p LEFT JOIN counts c ON c.label = p.label AND c.feature = w.form GROUP BY w.doc_id, p.label, p.prior)"""
QUERIES = {f.__name__: f for f in (nb_counts, nb_scores, nb_predict)}
SQL = {
    "nb_counts": f"{_BASE} SELECT * FROM counts",
    "nb_scores": f"{_BASE} SELECT doc_id, label, round(score, 3) AS score FROM scored",
    "nb_predict": f"{_BASE} SELECT doc_id, arg_min(label, (-round(score, 6), label)) AS prediction FROM scored GROUP BY 1",
}
