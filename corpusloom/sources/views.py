"""Word, mention and example tables over the stored tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unfolded(df: DataFrame, column: str, place: str | None = None) -> DataFrame:
    """A row for each element of an array of no nulls, in the array's column; `place`, if given, is the element's.

    Of an explode, Spark drops rows of empty arrays first and makes the array anew for that; where it is costly to make, outer rows that are dropped after are cheaper.
    """
    rest = [c for c in df.columns if c != column]
    each = F.explode_outer(column).alias(column) if place is None else F.posexplode_outer(column).alias(place, column)
    return df.select(*rest, each).where(F.col(column).isNotNull())


def split_words(line: Column) -> Column:
    """The words of a line: what stands between spaces."""
    return F.filter(F.split(line, " "), lambda w: w != "")


def all_words(text: Column) -> Column:
    """The words of all lines of a text."""
    return F.filter(F.split(text, "[ \n]"), lambda w: w != "")


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sent, words: a row for each line of a text, empty lines too."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("sent", "line")).select("doc_id", "sent", split_words(F.col("line")).alias("words"))


def words(docs: DataFrame) -> DataFrame:
    """doc_id, sent, pos, form."""
    return sentences(docs).select("doc_id", "sent", F.posexplode("words").alias("pos", "form"))


SENTENCES_SQL = """lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS sent, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    sentences AS (SELECT doc_id, sent, list_filter(string_split(line, ' '), lambda w: w <> '') AS words FROM lines)"""
WORDS_SQL = f"""{SENTENCES_SQL},
    words AS (SELECT doc_id, sent, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS form FROM sentences)"""

#: Mention types by rank, most specific first.
TYPES = ("purchase", "signup", "click", "view", "error")


def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in TYPES]), kind) - F.lit(1)


#: Mentions of a stand-in document and of one of its sentences; documents grow in number with the data, not in size.
DOCUMENT, SENTENCE = 120, 5
SENTENCES = DOCUMENT // SENTENCE


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, sent, idx (place in the document), entity, pred, mtype, rank, v of each event; every tenth mention is a cluster
    of its own in pred. A projection: nothing is shuffled."""
    events = table(spark, sf_dir, "events")
    place, own = F.pmod("event_id", F.lit(DOCUMENT)), F.col("event_id") % 10 == 3
    sent = F.floor(place / SENTENCE)
    return events.select(
        F.lpad(F.floor(F.col("event_id") / DOCUMENT).cast("string"), 8, "0").alias("doc"), sent.cast("int").alias("sent"), place.cast("int").alias("idx"),
        F.col("user_id").alias("entity"), F.when(own, place + 1000).otherwise(F.pmod(F.col("user_id") * 3 + sent % 3, F.lit(7))).alias("pred"), F.col("event_type").alias("mtype"),
        rank_of(F.col("event_type")).alias("rank"), F.col("value").alias("v"),
    )


MENTIONS_SQL = f"""mentions AS (
    SELECT lpad((event_id // {DOCUMENT})::VARCHAR, 8, '0') AS doc, (event_id % {DOCUMENT} // {SENTENCE})::INT AS sent, (event_id % {DOCUMENT})::INT AS idx,
           user_id AS entity, CASE WHEN event_id % 10 = 3 THEN event_id % {DOCUMENT} + 1000 ELSE (user_id * 3 + (event_id % {DOCUMENT} // {SENTENCE}) % 3) % 7 END AS pred, event_type AS mtype,
           list_position(['purchase', 'signup', 'click', 'view', 'error'], event_type) - 1 AS rank, value AS v FROM events)"""
