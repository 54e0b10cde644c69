"""Feature extraction: windows, affixes, conjunctions, composites, dot products. No operator here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.views import SENTENCES_SQL, sentences, table


def window_features(rows: DataFrame, value, radius: int = 2) -> DataFrame:
    """For each word, value(word) of the words at offsets -radius..radius inside its sentence (null beyond).

    A sentence is one row with an array, so neighbours are array places and no window shuffle is needed.
    """
    rows = rows.withColumn("_v", F.transform("words", value))
    names = [f"m{-o}" if o < 0 else f"p{o}" if o else "own" for o in range(-radius, radius + 1)]

    def at(i: Column, o: int) -> Column:
        return F.when(i + o >= 0, F.get("_v", i + o))

    packed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), *[at(i, o).alias(n) for o, n in zip(range(-radius, radius + 1), names, strict=True)]))
    return rows.select("doc_id", "sent", F.inline(packed))


def capitalized(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}").cast("string")


def word_type(word: Column) -> Column:
    """`c` for all capitals, `d` for all digits, `p` for no letter."""
    return F.concat(*[F.when(word.rlike(p), F.lit(c)).otherwise("") for c, p in (("c", r"^\p{Lu}+$"), ("d", r"^\p{Nd}+$"), ("p", r"^\P{L}+$"))])


def affixes(word: Column) -> Column:
    """Prefixes of 3 and 4 letters, suffixes of 1 to 4, where the word is strictly longer."""
    made = [(n, F.concat(F.lit("p|"), F.substring(word, 1, n))) for n in (3, 4)] + [(n, F.concat(F.lit("s|"), F.substring(word, -n, n))) for n in (1, 2, 3, 4)]
    return F.filter(F.array(*[F.when(F.length(word) > n, x) for n, x in made]), lambda x: x.isNotNull())


def conjunction(left: Column, right: Column) -> Column:
    """All pairs of two feature lists of a row, values joined by `&`."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.concat_ws("&", x, y))))


def composite(*lists: Column) -> Column:
    """The feature lists one after another."""
    return F.concat(*lists)


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two equally long arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def forms_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features(sentences(table(spark, sf_dir, "documents")), lambda w: w)


def capitalization_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features(sentences(table(spark, sf_dir, "documents")), capitalized)


def word_type_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features(sentences(table(spark, sf_dir, "documents")), word_type)


def _per_word(spark: SparkSession, sf_dir: str, made) -> DataFrame:
    rows = sentences(table(spark, sf_dir, "documents"))
    packed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.array_join(made(w, i), " ").alias("features")))
    return rows.select("doc_id", "sent", F.inline(packed))


def affix_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_word(spark, sf_dir, lambda w, i: affixes(w))


def conjunction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = lambda i: F.coalesce(F.when(i > 0, F.get("words", i - F.lit(1))), F.lit("^"))
    return _per_word(spark, sf_dir, lambda w, i: conjunction(F.array(previous(i), w), F.array(capitalized(w))))


def composite_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_word(spark, sf_dir, lambda w, i: composite(F.array(w), affixes(w), F.array(capitalized(w))))


def subject_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sent, pos, form: the words of a line that look like subjects: the first, and the one behind the first word
    that ends in a comma, or the next where that is an article."""
    rows = sentences(table(spark, sf_dir, "documents")).where(F.size("words") > 0)
    comma = F.array_position(F.transform("words", lambda w: w.endswith(",")), True)  # from 1; 0 without
    behind = F.when(comma > 0, comma + F.when(F.lower(F.get("words", comma.cast("int"))).isin("a", "the"), 1).otherwise(0)).cast("int")
    spots = F.array_distinct(F.array_compact(F.array(F.lit(0), F.when(behind < F.size("words"), behind))))
    return rows.select("doc_id", "sent", "words", F.explode(spots).alias("pos")).select("doc_id", "sent", "pos", F.get("words", "pos").alias("form"))


def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product of each vector with that of the next id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(other, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("next")), 4).alias("dot"))


def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2"))


def _window_sql(value: str) -> str:
    at = ", ".join(f"CASE WHEN i + {o} BETWEEN 1 AND len(v) THEN v[i + {o}] END AS {n}" for o, n in ((-2, "m2"), (-1, "m1"), (0, "own"), (1, "p1"), (2, "p2")))
    return f"""WITH {SENTENCES_SQL}, vals AS (SELECT doc_id, sent, list_transform(words, lambda w: {value}) AS v FROM sentences),
        spots AS (SELECT doc_id, sent, v, unnest(range(1, len(v) + 1)) AS i FROM vals) SELECT doc_id, sent, i - 1 AS pos, {at} FROM spots"""


_CAP = r"CASE WHEN regexp_matches(w, '^\p{Lu}') THEN 'true' ELSE 'false' END"
_AFFIX = "list_filter([CASE WHEN len(w) > 3 THEN 'p|' || w[1:3] END, CASE WHEN len(w) > 4 THEN 'p|' || w[1:4] END, " + ", ".join(f"CASE WHEN len(w) > {n} THEN 's|' || right(w, {n}) END" for n in (1,
    2, 3, 4)) + "], lambda x: x IS NOT NULL)"


def _per_word_sql(features: str) -> str:
    return f"""WITH {SENTENCES_SQL}, spots AS (SELECT doc_id, sent, words, unnest(range(1, len(words) + 1)) AS i FROM sentences), each AS (SELECT *, words[i] AS w FROM spots)
        SELECT doc_id, sent, i - 1 AS pos, array_to_string({features}, ' ') AS features FROM each"""


QUERIES = {f.__name__: f for f in (forms_window, capitalization_window, word_type_window, affix_features, conjunction_features, composite_features, subject_words, sparse_dot, l2_norm)}
SQL = {
    "forms_window": _window_sql("w"),
    "capitalization_window": _window_sql(_CAP),
    "word_type_window": _window_sql(r"CASE WHEN regexp_matches(w, '^\p{Lu}+$') THEN 'c' ELSE '' END || CASE WHEN regexp_matches(w, '^\p{Nd}+$') THEN 'd' ELSE '' END || CASE WHEN regexp_matches(w, '^\P{L}+$') THEN 'p' ELSE '' END"),
    "affix_features": _per_word_sql(_AFFIX),
    "conjunction_features": _per_word_sql(f"[CASE WHEN i > 1 THEN words[i - 1] ELSE '^' END || '&' || {_CAP}, w || '&' || {_CAP}]"),
    "composite_features": _per_word_sql(f"list_concat(list_concat([w], {_AFFIX}), [{_CAP}])"),
    "subject_words": f"""WITH {SENTENCES_SQL}, c AS (SELECT *, coalesce(list_position(list_transform(words, lambda w: ends_with(w, ',')), true), 0) AS k FROM sentences WHERE len(words) > 0),
        b AS (SELECT *, CASE WHEN k > 0 THEN k + CASE WHEN lower(words[k + 1]) IN ('a', 'the') THEN 1 ELSE 0 END END AS p FROM c)
        SELECT doc_id, sent, 0 AS pos, words[1] AS form FROM b UNION ALL SELECT doc_id, sent, p, words[p + 1] FROM b WHERE p < len(words)""",
    "sparse_dot": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "l2_norm": "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm2 FROM embeddings",
}
