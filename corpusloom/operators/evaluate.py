"""Evaluation: confusion counts, precision and recall, segments, clusterings, moments, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.shared import numbered
from corpusloom.sources.views import MENTIONS_SQL, mentions, split_words, table


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def prf(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """label, n_gold, n_pred, n_hit, precision, recall, f of rows (gold, pred); one shuffle of partial counts."""
    counts = pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    each = counts.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), F.when(F.col("gold") == F.col("pred"),
        F.col("n")).otherwise(0).alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"),
        F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    total = each.groupBy("label").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum("h").alias("n_hit"))
    p, r, b = ratio(F.col("n_hit"), F.col("n_pred")), ratio(F.col("n_hit"), F.col("n_gold")), beta * beta
    return total.select("label", "n_gold", "n_pred", "n_hit", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide((b + 1) * p * r, b * p + r), 6).alias("f"))


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gold and predicted language of documents, by one frequent word each."""
    text = F.col("text")
    guess = F.when(text.contains(" the "), "en").when(text.contains(" der "), "de").when(text.contains(" les "), "fr").when(text.contains(" que "), "es").otherwise("none")
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("gold"), guess.alias("pred"))


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guesses(spark, sf_dir).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def prf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prf(guesses(spark, sf_dir))


def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro precision, recall and F1 over labels that aren't `none`, and accuracy."""
    pairs = guesses(spark, sf_dir)
    hit, real = F.col("gold") == F.col("pred"), F.col("pred") != "none"
    sums = pairs.agg(F.sum((hit & real).cast("int")).alias("h"), F.sum(real.cast("int")).alias("p"), F.sum((F.col("gold") != "none").cast("int")).alias("g"), F.avg(hit.cast("int")).alias("accuracy"))
    p, r = ratio(F.col("h"), F.col("p")), ratio(F.col("h"), F.col("g"))
    return sums.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


def segments(rows: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """keys, first, last of each maximal run of tagged words (gaps and islands) in a sentence array of booleans."""
    flags = F.col(tag)
    starts = F.filter(F.transform(flags, lambda x, i: F.when(x & ((i == 0) | ~F.coalesce(F.get(flags, i - F.lit(1)), F.lit(False))), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(flags, lambda x, i: F.when(x & ~F.coalesce(F.get(flags, i + F.lit(1)), F.lit(False)), i)), lambda i: i.isNotNull())
    return rows.select(*keys, F.inline(F.arrays_zip(starts.alias("first"), ends.alias("last"))))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", split_words(F.col("text")).alias("w"))
    return rows.select("conv_id", "turn", F.transform("w", lambda x: x.rlike(r"^\p{Lu}")).alias("gold"), F.transform("w", lambda x: x.rlike(r"^\p{Lu}") & (F.length(x) > 3)).alias("guess"))


def bio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(_tagged(spark, sf_dir), "gold", ["conv_id", "turn"])


def bio_segment_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-match precision, recall and F1 of predicted segments."""
    rows, keys = _tagged(spark, sf_dir), ["conv_id", "turn"]
    gold = segments(rows, "gold", keys).withColumn("g", F.lit(1))
    guess = segments(rows, "guess", keys).withColumn("p", F.lit(1))
    both = gold.join(guess, [*keys, "first", "last"], "full_outer").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_pred"), F.sum((F.col("g").isNotNull() & F.col("p").isNotNull()).cast("int")).alias("n_hit"))
    p, r = ratio(F.col("n_hit"), F.col("n_pred")), ratio(F.col("n_hit"), F.col("n_gold"))
    return both.select("n_gold", "n_pred", "n_hit", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def bcubed_rows(rows: DataFrame, gold: str = "entity", pred: str = "pred", doc: str = "doc") -> DataFrame:
    """B-cubed sums from the sizes of overlaps; overlaps are counted once for each pair of clusters, not each mention."""
    overlap = rows.groupBy(doc, gold, pred).agg(F.count(F.lit(1)).alias("n"))
    g, p = F.sum("n").over(Window.partitionBy(doc, gold)), F.sum("n").over(Window.partitionBy(doc, pred))
    each = overlap.select(doc, "n", (F.col("n") * F.col("n") / p).alias("pp"), (F.col("n") * F.col("n") / g).alias("rr"))
    sums = each.groupBy(doc).agg(F.sum("n").alias("mentions"), F.sum("pp").alias("p"), F.sum("rr").alias("r"))
    return sums.select(doc, "mentions", F.round(ratio(F.col("p"), F.col("mentions")), 6).alias("precision"), F.round(ratio(F.col("r"), F.col("mentions")), 6).alias("recall"),
        F.round(F.try_divide(2 * F.col("p") * F.col("r"), (F.col("p") + F.col("r")) * F.col("mentions")), 6).alias("f1"))


def bcubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bcubed_rows(mentions(spark, sf_dir))


def bcubed_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir)
    w = lambda *c: F.count(F.lit(1)).over(Window.partitionBy("doc", *c))
    each = rows.select("mtype", (w("entity", "pred") / w("pred")).alias("p"), (w("entity", "pred") / w("entity")).alias("r"))
    return each.groupBy("mtype").agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation, bias-corrected skewness and excess kurtosis of values by day; null for tiny or constant samples."""
    n = F.col("n").cast("double")
    sums = mentions(spark, sf_dir).groupBy("doc").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    skew = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(F.col("n") > 3, ((n + 1) * (F.col("g2") + 3) - 3 * (n - 1)) * (n - 1) / ((n - 2) * (n - 3)))
    return sums.select("doc", *[F.round(c, 4).alias(a) for c, a in ((F.col("mean"), "mean"), (F.col("std"), "std"), (skew, "skew"), (kurt, "kurt"))])


def fitted(y: str, x: str, places: int) -> list[Column]:
    """r, slope and intercept of y on x; one point lies on a level line: 1, 0 and itself; null where x or, for r, y is
    the same at several points."""
    one = F.count(y) == 1
    return [(F.round(F.when(one, single).otherwise(c), places) + F.lit(0.0)).alias(n) for n, single, c in (("r", F.lit(1.0), F.try_divide(F.covar_pop(y, x), F.sqrt(F.var_pop(y) * F.var_pop(x)))), ("slope", F.lit(0.0), F.regr_slope(y, x)), ("intercept", F.max(y), F.regr_intercept(y, x)))]


def fitted_sql(y: str, x: str, places: int) -> str:
    return f"""round(CASE WHEN count({y}) = 1 THEN 1 ELSE corr({y}, {x}) END, {places}) + 0.0 AS r, round(CASE WHEN count({y}) = 1 THEN 0 ELSE regr_slope({y}, {x}) END, {places}) + 0.0 AS slope,
        round(CASE WHEN count({y}) = 1 THEN max({y}) ELSE regr_intercept({y}, {x}) END, {places}) + 0.0 AS intercept"""


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation, slope and intercept of value on the place in the day, by type."""
    return mentions(spark, sf_dir).groupBy("mtype").agg(*fitted("v", "idx", 6))


def kfold(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """key, idx, sequential, kth, random: fold numbers by three strategies (the random one by a hash of the key)."""
    rows = numbered(df.select(key), [key])
    return _cut(rows, k).select(key, "idx", F.col("fold").alias("sequential"), F.pmod("idx", F.lit(k)).alias("kth"), F.pmod(F.xxhash64(key), F.lit(k)).alias("random"))


def _cut(rows: DataFrame, k: int) -> DataFrame:
    """rows (idx, ...) with `fold`: k runs of equal length, the first ones longer by one row if the number doesn't divide."""
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    q, r = F.floor(F.col("_total") / k), F.col("_total") % k
    edge = r * (q + 1)
    fold = F.when(F.col("idx") < edge, F.floor(F.col("idx") / (q + 1))).otherwise(r + F.floor((F.col("idx") - edge) / F.greatest(q, F.lit(1))))
    return rows.crossJoin(F.broadcast(total)).withColumn("fold", fold.cast("long")).drop("_total")


def kfold_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "idx", F.col("sequential").alias("fold"))


def kfold_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "idx", F.col("kth").alias("fold"))


def random_folds(df: DataFrame, key: str, k: int = 5, seed: int = 7) -> DataFrame:
    """key, fold: contiguous folds of the rows in the order of a digest of key and seed, which any engine repeats."""
    rows = df.select(key, F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))).alias("_d"))
    return _cut(numbered(rows, ["_d", key]), k).select(key, "fold")


def kfold_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_folds(table(spark, sf_dir, "documents"), "doc_id")


def plain_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, accuracy: the share of rows whose lists of values are equal, here language and its guess."""
    rows = guesses(spark, sf_dir).select((F.array("gold") == F.array("pred")).cast("int").alias("hit"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))


def kfold_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds cut by separator rows (documents over 9000 characters): the number of separators up to a row."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce((F.col("n_chars") > 9000).cast("long"), F.lit(0)).alias("sep"))
    return numbered(rows, ["doc_id"], "before", F.col("sep")).select("doc_id", (F.col("before") + F.col("sep")).alias("fold"))


_GUESS = "WITH g AS (SELECT lang AS gold, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' les ') THEN 'fr' WHEN contains(text, ' que ') THEN 'es' ELSE 'none' END AS pred FROM documents)"
_F = "round(2 * p * r / nullif(p + r, 0), 6)"
_SEG = r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations),
    u AS (SELECT conv_id, turn, unnest(range(0, len(w))) AS pos, w FROM t),
    tags AS (SELECT conv_id, turn, pos, regexp_matches(w[pos + 1], '^\p{Lu}') AS gold, regexp_matches(w[pos + 1], '^\p{Lu}') AND len(w[pos + 1]) > 3 AS guess FROM u),
    gold AS (SELECT conv_id, turn, min(pos) AS first, max(pos) AS last FROM (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS k FROM tags WHERE gold) GROUP BY conv_id, turn, k),
    guess AS (SELECT conv_id, turn, min(pos) AS first, max(pos) AS last FROM (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS k FROM tags WHERE guess) GROUP BY conv_id, turn, k)"""
QUERIES = {f.__name__: f for f in (confusion_counts, prf_table, overall_stats, bio_segments, bio_segment_prf, bcubed, bcubed_by_type, moments, correlation, kfold_sequential,
    kfold_kth, kfold_random, kfold_manual, plain_accuracy)}
SQL = {
    "confusion_counts": f"{_GUESS} SELECT gold, pred, count(*) AS n FROM g GROUP BY ALL",
    "prf_table": f"""{_GUESS}, s AS (SELECT label, sum(g) AS n_gold, sum(p) AS n_pred, sum(h) AS n_hit FROM (
        SELECT gold AS label, 1 AS g, 0 AS p, (gold = pred)::INT AS h FROM g UNION ALL SELECT pred, 0, 1, 0 FROM g) GROUP BY 1),
        x AS (SELECT *, n_hit / nullif(n_pred, 0) AS p, n_hit / nullif(n_gold, 0) AS r FROM s)
        SELECT label, n_gold::BIGINT AS n_gold, n_pred::BIGINT AS n_pred, n_hit::BIGINT AS n_hit, round(p, 6) AS precision, round(r, 6) AS recall, {_F} AS f FROM x""",
    "overall_stats": f"""{_GUESS}, x AS (SELECT sum((gold = pred AND pred <> 'none')::INT) / nullif(sum((pred <> 'none')::INT), 0) AS p, sum((gold = pred
            AND pred <> 'none')::INT) / nullif(sum((gold <> 'none')::INT), 0) AS r, avg((gold = pred)::INT) AS a FROM g)
        SELECT round(p, 6) AS precision, round(r, 6) AS recall, {_F} AS f1, round(a, 6) AS accuracy FROM x""",
    "bio_segments": f"{_SEG} SELECT * FROM gold",
    "bio_segment_prf": f"""{_SEG}, s AS (SELECT (SELECT count(*) FROM gold) AS n_gold, (SELECT count(*) FROM guess) AS n_pred, (SELECT count(*) FROM gold JOIN guess USING (conv_id, turn, first, last)) AS n_hit),
        x AS (SELECT *, n_hit / nullif(n_pred, 0) AS p, n_hit / nullif(n_gold, 0) AS r FROM s) SELECT n_gold, n_pred, n_hit, round(p, 6) AS precision, round(r, 6) AS recall, {_F} AS f1 FROM x""",
    "bcubed": f"""WITH {MENTIONS_SQL}, o AS (SELECT doc, count(*) OVER (PARTITION BY doc, entity, pred) AS o, count(*) OVER (PARTITION BY doc, pred) AS p, count(*) OVER (PARTITION BY doc, entity) AS g FROM mentions),
        s AS (SELECT doc, count(*) AS mentions, avg(o / p) AS p, avg(o / g) AS r FROM o GROUP BY 1) SELECT doc, mentions, round(p, 6) AS precision, round(r, 6) AS recall, {_F} AS f1 FROM s""",
    "bcubed_by_type": f"""WITH {MENTIONS_SQL}, o AS (SELECT mtype, count(*) OVER (PARTITION BY doc, entity, pred) AS o, count(*) OVER (PARTITION BY doc, pred) AS p,
            count(*) OVER (PARTITION BY doc, entity) AS g FROM mentions)
        SELECT mtype, count(*) AS mentions, round(avg(o / p), 6) AS precision, round(avg(o / g), 6) AS recall FROM o GROUP BY 1""",
    "moments": f"WITH {MENTIONS_SQL} SELECT doc, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(skewness(v), 4) AS skew, round(kurtosis(v), 4) AS kurt FROM mentions GROUP BY 1",
    "correlation": f"WITH {MENTIONS_SQL} SELECT mtype, {fitted_sql('v', 'idx', 6)} FROM mentions GROUP BY 1",
    "kfold_sequential": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, ntile(5) OVER (ORDER BY doc_id) - 1 AS fold FROM documents",
    "kfold_kth": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS fold FROM documents",
    "kfold_random": "SELECT doc_id, ntile(5) OVER (ORDER BY md5(doc_id || ':7'), doc_id) - 1 AS fold FROM documents",
    "plain_accuracy": f"{_GUESS} SELECT count(*) AS n, round(avg(([gold] = [pred])::INT), 6) AS accuracy FROM g",
    "kfold_manual": "SELECT doc_id, sum((n_chars > 9000)::INT) OVER (ORDER BY doc_id)::BIGINT AS fold FROM documents",
}
