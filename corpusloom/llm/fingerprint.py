"""Order MinHash fingerprints in DataFrame functions only.

Symbols are the white-space separated words of the text, cut into pieces of at most PIECE characters, so that text
without white space has many symbols too. A k-mer is K symbols in a row; equal k-mers are numbered by occurrence, and
each (k-mer, number) has a hash. There are ORDERS independent hash orders, and each serves for SIZE / ORDERS of the
orders of the sketch by rotation: they start at points dealt evenly over the hash range and wrap around. The first PICKS
k-mers of an order are put back in text order, and the hash of their tuple is the t-th component, which thus depends on
which k-mers a text has, on how often and on their order: it follows edit distance where a set sketch does not (Marcais
et al., 2019). By symmetry each order is a uniform one over the choice of hash; only rotations of one hash order depend
on each other.

All is done inside a row: one sort of the k-mers, one for each hash order, binary searches after that; any text length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, saved

K, PICKS, SIZE, ORDERS, PIECE = 3, 2, 32, 4, 12
_LOW = 0x7FFFFFFF  # the low bits hold a position


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _key(packed: Column) -> Column:
    return F.shiftright(packed, 31)


def _pack(key: Column, at: Column) -> Column:
    """The upper 33 bits of a hash, then a position."""
    return key.bitwiseAND(F.lit(~_LOW)).bitwiseOR(at.cast("long"))


def _steps(n: Column) -> Column:
    """Powers of two from at least n down to 1."""
    return F.transform(F.sequence(F.ceil(F.log2(n + F.lit(1))).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))


def order_minhash(text: Column, k: int = K, picks: int = PICKS, size: int = SIZE, piece: int = PIECE, orders: int = ORDERS) -> Column:
    """array<long> of `size` components of 32 bits each, `orders` of which divide them. Null counts as empty; text without symbols has one k-mer."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"\\S{{1,{piece}}}"), F.lit(0))
    symbols = F.transform(words, lambda w: F.xxhash64(w))
    symbols = _let(symbols, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(0).cast("long"))))

    def kmers(s: Column) -> Column:
        starts = F.slice(s, F.lit(1), F.greatest(F.size(s) - F.lit(k - 1), F.lit(1)))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(s, i + F.lit(j)) for j in range(1, k)]))

    def numbered(sorted_: Column, steps: Column) -> Column:
        def repeats(x: Column, j: Column) -> Column:
            def step(n, s):
                back = j - n - s
                return F.when((back >= 0) & (_key(F.get(sorted_, back)) == _key(x)), n + s).otherwise(n)

            return F.aggregate(steps, F.lit(0), step)

        def rank(x: Column, j: Column) -> Column:
            first = (j == 0) | (_key(F.get(sorted_, j - F.lit(1))) != _key(x))
            return _pack(F.xxhash64(_key(x), F.when(first, F.lit(0)).otherwise(repeats(x, j))), x.bitwiseAND(F.lit(_LOW)))

        return F.transform(sorted_, rank)

    turns = size // orders
    points = F.array(*[F.lit(-(1 << 63) + t * ((1 << 64) // turns)).cast("long") for t in range(turns)])

    def signature(grams: Column, order: Column, steps: Column, salt: int) -> Column:
        n = F.size(order)

        def component(point: Column, t: Column) -> Column:
            def step(at, s):
                return F.when((at + s <= n) & (F.get(order, at + s - F.lit(1)) < point), at + s).otherwise(at)

            begin = F.aggregate(steps, F.lit(0), step)

            def chosen(b: Column) -> Column:
                spots = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(picks)) - F.lit(1)), lambda r: F.get(order, (b + r) % n).bitwiseAND(F.lit(_LOW)).cast("int"))
                return F.xxhash64(t + F.lit(salt * turns), F.transform(F.sort_array(spots), lambda p: F.get(grams, p))).bitwiseAND(F.lit(0xFFFFFFFF))

            return _let(begin, chosen)

        return F.transform(points, component)

    def sketched(grams: Column, steps: Column, found: Column) -> Column:
        again = lambda salt: F.sort_array(F.transform(found, lambda x: _pack(F.xxhash64(_key(x), F.lit(salt)), x.bitwiseAND(F.lit(_LOW)))))
        of = lambda salt: lambda order: signature(grams, order, steps, salt)
        return F.concat(*[_let(again(salt), of(salt)) for salt in range(orders)])

    def whole(s: Column) -> Column:
        return _let(kmers(s), lambda g: _let(_steps(F.size(g)), lambda steps: _let(F.sort_array(F.transform(g, lambda h, i: _pack(h, i))), lambda p: _let(numbered(p, steps), lambda found: sketched(g, steps, found)))))

    return _let(symbols, whole)


def as_text(components: Column) -> Column:
    """Components as one string of 8 hexadecimal digits each."""
    return F.array_join(F.transform(components, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal components, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same.cast("double") / F.size(a)


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, prev_id, prev_f for each distinct doc_id of docs (doc_id, f), in descending order (null last).

    The last is followed by the first. prev_f: the largest f of the id before. Ids are dealt by range; only the ends of
    each range meet in one place.
    """
    ids = docs.groupBy("doc_id").agg(F.max("f").alias("f"))
    down = F.col("doc_id").desc_nulls_last()
    ids = ids.repartitionByRange(partitions(docs.sparkSession), down).select(F.spark_partition_id().alias("part"), "doc_id", F.struct("doc_id", "f").alias("own"))
    ids = saved(ids, "neighbours")
    inside = Window.partitionBy("part").orderBy(down)
    local = ids.withColumns({"next": F.lead("own").over(inside), "prev": F.lag("own").over(inside)})
    heads = local.where(F.col("prev").isNull()).select("part", F.col("own").alias("head"))
    tails = local.where(F.col("next").isNull()).select(F.col("part").alias("_part"), F.col("own").alias("tail"))
    parts, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = heads.join(tails, F.col("part") == F.col("_part")).select(
        F.col("part").alias("_part"),
        F.coalesce(F.lead("head").over(parts), F.first("head").over(every)).alias("_next"),
        F.coalesce(F.lag("tail").over(parts), F.last("tail").over(every)).alias("_prev"),
    )
    joined = local.join(ends, F.col("part") == F.col("_part"))
    after, before = F.coalesce("next", "_next"), F.coalesce("prev", "_prev")
    return joined.select("doc_id", after["doc_id"].alias("next_id"), before["doc_id"].alias("prev_id"), before["f"].alias("prev_f"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, text, edited: the last third of each text replaced by the start of the next document's.

    Of rows that share a doc_id, the donor is the one whose donated text sorts first.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    near = neighbours(docs.select("doc_id", third.alias("f"))).withColumnRenamed("doc_id", "_id")
    both = docs.join(near, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    given = both.select(F.col("prev_id").alias("_to"), F.expr("substring(text, 1, prev_f)").alias("given"))
    given = given.groupBy("_to").agg(F.min("given").alias("given"))
    both = both.join(given, F.col("doc_id").eqNullSafe(F.col("_to"))).withColumn("f", third)
    return both.select("doc_id", "next_id", "text", F.expr("concat(substring(text, 1, length(text) - f), substring(given, 1, f))").alias("edited"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    Null text counts as empty; a null doc_id comes last. Of rows that share the next doc_id, near_next takes the one
    with the smallest fingerprint. A table of one id is its own next document. An empty table gives no rows. Other columns
    are ignored.
    """
    pairs = edited_pairs(docs)
    prints = pairs.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash(F.col("text")).alias("own"), order_minhash(F.col("edited")).alias("changed"))
    prints = saved(prints, "fingerprints")
    by_id = prints.groupBy(F.col("doc_id").alias("_id")).agg(F.min("own").alias("following"))
    joined = prints.join(by_id, F.col("next_id").eqNullSafe(F.col("_id")))
    return joined.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
