"""Filter interaction audit: what each filter of a chain removes in every order that the filters could have.

Every document gets the set of filters that it fails, as bits. The documents are crossed with a table of all orders of
the filters (120 for five, a fixed number of rows, sent to every task), the step of the first failure is found in each
order, the steps are exploded, and conditional counts are added up: inside each task first, so that only one row of
counts for each part, order and step leaves a task, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, saved

#: A filter's letter, and whether a text with these words fails it. SAME stands for texts that a smaller id has too.
SAME = "E"
WORD = r"[^\x20\x09-\x0D]+"
MOST_FILTERS = 6


def _uncommon_words(text: Column, words: Column) -> Column:
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * 50


def _capitals(text: Column, words: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 3


FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": _uncommon_words,
    "C": _capitals,
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}


def failing_bits(docs: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, bits of each row of docs: bit i for the i-th filter, the next one for a text that a smaller doc_id has.

    Texts are compared by SHA-256. Of each text only the smallest id is kept, and documents meet it by text and id
    together, so the copies of one text are spread over all tasks.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    own = [F.when(fails(body, words), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("same"),
        reduce(Column.__add__, own, F.lit(0)).alias("bits"))
    rows = saved(rows, "flags")
    firsts = rows.where("doc_id IS NOT NULL").groupBy(F.col("same").alias("_same")).agg(F.min("doc_id").alias("_first"))
    met = rows.join(firsts, (F.col("same") == F.col("_same")) & (F.col("doc_id") == F.col("_first")), "left")
    later = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return met.select("doc_id", "part", (F.col("bits") + F.when(later, 1 << len(own)).otherwise(0)).alias("bits"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each value of `part`, order of the filters' letters and step, also where all counts are zero. At a step
    stands one filter, and a document is removed at the first step whose filter it fails. kept: not removed at this step or
    before; removed: at this step; redundant: fails this filter but was removed before; unique_fails: fails this filter
    alone; good_lost and toxic_lost: removed here with quality 1 or toxic 1 in labels; shapley: removed by this step's
    filter, added up over all orders.

    Null text counts as empty, a null part as the empty string. Texts are read whole. Repeated rows count as documents of
    their own; rows that share an id don't make each other copies, nor does a row without an id. An id with several labels has quality
    1 or toxic 1 if any of them says so; labels without an id are of no document. Other columns are ignored, whatever
    their names. A table without documents gives no rows; without labels, none is good or toxic.
    """
    letters = [*filters, SAME]
    if len(set(letters)) != len(letters) or any(len(x) != 1 for x in letters) or len(letters) > MOST_FILTERS:
        raise ValueError(f"filters have letters of their own, other than {SAME}, and there are fewer than {MOST_FILTERS}")
    spark, steps = docs.sparkSession, len(letters)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flags = failing_bits(docs, filters, key, text, part).join(known, F.col("doc_id") == F.col("_labelled"), "left")
    flags = flags.select("part", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).repartition(partitions(spark))
    table = [(i, "".join(letters[j] for j in order), [1 << j for j in order]) for i, order in enumerate(permutations(range(steps)))]
    orders = spark.createDataFrame(table, "order_no int, filter_order string, masks array<int>")
    masks = [F.col("masks")[i] for i in range(steps)]
    first = reduce(lambda rest, i: F.when(F.col("bits").bitwiseAND(masks[i]) != 0, i).otherwise(rest), reversed(range(steps)), F.lit(steps))
    crossed = flags.crossJoin(F.broadcast(orders.select("order_no", "masks")))
    replayed = crossed.select("part", "order_no", "bits", "good", "toxic", first.alias("first"), F.posexplode("masks").alias("at", "mask"))
    here, fails = F.col("first") == F.col("at"), F.col("bits").bitwiseAND(F.col("mask")) != 0
    counts = {
        "kept": F.col("first") > F.col("at"), "removed": here, "redundant": fails & (F.col("first") < F.col("at")), "unique_fails": F.col("bits") == F.col("mask"),
        "good_lost": here & (F.col("good") == 1), "toxic_lost": here & (F.col("toxic") == 1),
    }
    added = replayed.groupBy("part", "order_no", "at", "mask").agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(k) for k, c in counts.items()])
    shares = added.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "mask")))
    return shares.join(F.broadcast(orders.select("order_no", "filter_order")), "order_no").select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), *counts, "shapley")
