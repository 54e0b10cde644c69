"""Near-duplicate documents: fast similarity sketches, banding and exact verification.

A document's set holds its distinct shingles of five words, as 64-bit hashes. Documents of equal sets are one class,
represented by the smallest id. A class is sketched by fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017):
in round i every element is hashed to one of T bins with the value i + v, a bin keeps its least value, and rounds stop
when all bins are full; the last T rounds, of which round T + j puts all elements into bin j, fill what is left, so no
coordinate stays empty. BANDS bands of ROWS coordinates make buckets; with 32 bands of 4, a pair of similarity 0.75
shares no bucket with probability 5e-6.

Buckets are not expanded into pairs. In the first star turn each member is compared with one centre, the smallest id of
the bucket that it shares most often; in the second with CENTRES hashed members of each of its buckets. Members of one
component are no longer compared, so groups of copies shrink to a few stars. What is left, pairs of members of one
bucket whose components still differ, is compared in full, so no link between bucket partners is lost.

Sets lie in the shared folder, dealt by id, and are not shuffled whole. For a turn, each member's set goes to the task
of its centre, and the centre's set goes to as many tasks as its members fill, at most PART of them in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import MAX_BROADCAST_BYTES, bucketed, forget, mix64, partitions, saved, seeds, trimmed

WIDTH, T, BANDS, ROWS = 5, 128, 32, 4
PERCENT = 75
CENTRES, PART = 4, 256
CROWD, COMMON = 32, 64
_COEFFICIENTS = seeds(WIDTH, 11) | np.uint64(1)
_ROUNDS = seeds(2 * T, 23)
_BAND = seeds(ROWS, 37) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence if there are fewer words, none without."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII white spaces
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WIDTH:
        return mix64((h * _COEFFICIENTS[:n]).sum(keepdims=True) + np.uint64(n))
    total = h[: n - WIDTH + 1] * _COEFFICIENTS[0]
    for j in range(1, WIDTH):
        total += h[j : n - WIDTH + 1 + j] * _COEFFICIENTS[j]
    return np.unique(mix64(total))


def sketch(elements: np.ndarray) -> np.ndarray:
    """T coordinates of a set that isn't empty; the part of equal coordinates estimates Jaccard similarity."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(T, full)
    step = max(1, 700 // len(elements))
    for i in range(0, T, step):
        x = mix64(elements[None, :] ^ _ROUNDS[i : min(T, i + step), None])
        rounds = np.arange(i, min(T, i + step), dtype=np.uint64)[:, None] << np.uint64(55)
        np.minimum.at(out, (x & np.uint64(T - 1)).ravel().astype(np.intp), (rounds | (x >> np.uint64(9))).ravel())
        empty = out == full
        if not empty.any():
            return out
    for j in np.flatnonzero(out == full):
        out[j] = (np.uint64(T + j) << np.uint64(55)) | (mix64(elements ^ _ROUNDS[T + j]) >> np.uint64(9)).min()
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """A bucket key for each band."""
    grid = coordinates.reshape(BANDS, ROWS) * _BAND
    return mix64(grid.sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, buckets = [], [], []
            for value in batch.column(1):
                own = shingles(value.as_py())
                counts.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                buckets.append(bands(sketch(own)).view(np.int64) if len(own) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "buckets"])
        trimmed()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, buckets array<long>")


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([shingles(x.as_py()).tobytes() for x in own.column(1)], pa.binary())], names=["id", "elements"])
        trimmed()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, elements binary")


def bounded(ids: DataFrame) -> DataFrame:
    """ids, to be sent to every executor if the counted rows are within the bound, else as they are."""
    return F.broadcast(ids) if 24 * ids.count() <= MAX_BROADCAST_BYTES else ids


def _stars(links: DataFrame) -> bool:
    """Whether every node is either the centre of a star or linked to one centre."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"),
        F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for each id u of edges (a, b) that isn't the smallest id v it reaches, by alternating stars.

    Each step replaces a node's links by links to its smallest neighbour, until all links are stars; steps are written
    to the shared folder. No step gathers a node's neighbours, so nodes with many links are no special case.
    """
    links, last = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        links = saved(small, "links")
        forget(last)
        if _stars(links):
            return links
        last = links


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Sets of b come to the task of a; a's own comes once to each task that holds a part of its partners.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.empty(0, np.uint64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (b, own) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if not b.is_valid:
                    centre = own.copy()
                    continue
                at = np.searchsorted(centre, own)
                at[at == len(centre)] = 0
                common = int(np.count_nonzero(centre[at] == own))
                keep[i] = 100 * common >= PERCENT * (len(centre) + len(own) - common)
            if keep.any():
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))
        trimmed()

    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    partners = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "b", "elements", "part")
    centres = parts.join(sets.withColumnRenamed("id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "elements", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = centres.unionByName(partners).repartition(partitions(sets.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "elements").mapInArrow(run, "a long, b long")


def _profiles(sets: DataFrame) -> DataFrame:
    """_id, common, rare: how many elements of each set are in COMMON sets or more, and the others, in one order for all sets.

    Tasks send one count for each element and batch. The common elements, at most a COMMON-th of all, go to the
    executors if they are within the bound, and are joined otherwise.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)] or [np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(n)], names=["e", "n"])

    often = saved(sets.select("elements").mapInArrow(count, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).select("e"), "often")
    if 8 * often.count() <= MAX_BROADCAST_BYTES // 2:
        known = sets.sparkSession.sparkContext.broadcast(np.sort(often.toArrow()["e"].to_numpy()))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
                inside = [np.isin(x, known.value) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(i.sum()) for i in inside], pa.int64()), pa.array([x[~i] for x, i in zip(found, inside,
                    strict=True)], pa.list_(pa.int64()))], names=["_id", "common", "rare"])

        return sets.select("id", "elements").mapInArrow(split, "_id long, common long, rare array<long>")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(own.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], names=["id", "e"])

    each = sets.select("id", "elements").mapInArrow(spread, "id long, e long")
    marked = each.join(often.withColumn("often", F.lit(True)), "e", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    return marked.groupBy(F.col("id").alias("_id")).agg(F.sum(F.col("often").cast("int")).alias("common"), F.array_sort(F.collect_list(F.when(~F.col("often"), F.col("e")))).alias("rare"))


def _starred(placed: DataFrame, fits, centres: int) -> DataFrame:
    """Pairs (a, b) of a bucket's centre and a member of another component.

    With one centre, the smallest id, only the centre that b meets in most buckets; with more, the first by hash in each
    of so many parts of the bucket, and all that b meets.
    """
    one = F.struct((F.col("id") if centres == 1 else F.xxhash64("id", F.lit(1))).alias("o"), "id", "n", "comp")
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(centres))
    firsts = [F.min(F.when(part == i, one)).alias(f"c{i}") for i in range(centres)]
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), *firsts).where("_low < _high")
    mixed = mixed.select("bucket", F.explode(F.array_compact(F.array(*[f"c{i}" for i in range(centres)]))).alias("c"))
    mixed = mixed.select("bucket", F.col("c.id").alias("a"), F.col("c.n").alias("m"), F.col("c.comp").alias("other"))
    met = placed.join(mixed, "bucket").where((F.col("comp") != F.col("other")) & fits).groupBy("a", F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    if centres > 1:
        return met.select("a", "b")
    return met.groupBy("b").agg(F.min(F.struct((-F.col("times")).alias("t"), "a")).alias("x")).select("x.a", "b")


def _crossing(placed: DataFrame, sets: DataFrame, fits) -> DataFrame:
    """Pairs (a, b) of two components that may reach the similarity; `held` is a bucket's size.

    In buckets of up to CROWD members, all pairs of the bucket. In larger ones a set is read with its rare elements first (those
    in fewer than COMMON sets, so none makes many pairs), in one order for all sets. A pair that reaches the similarity shares
    PERCENT of either set at least, so its first shared element is within the first 100 - PERCENT of each and one more. If that is rare, the
    pair is found by it; if not, both sets consist of common elements to PERCENT, and only such members of a bucket are paired.
    """
    few, many = placed.where(F.col("held") <= CROWD).drop("held"), placed.where(F.col("held") > CROWD).drop("held")
    differ = F.col("comp") < F.col("other")

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({"id": "a", "n": "m", "comp": "other", "common": "common_a", "rare": "rare_a"})

    pairs = few.join(renamed(few), "bucket").where(differ & fits).select("a", F.col("id").alias("b"))
    if many.isEmpty():
        return pairs
    profiles = saved(_profiles(sets.join(many.select("id").distinct(), "id", "left_semi")), "profiles")
    many = many.join(profiles, F.col("id") == F.col("_id")).drop("_id")
    enough = "7 * (least(common, common_a) + {}) >= 3 * (n + m)"  # the overlap of two sets of similarity 3/4, at most
    first = F.expr(f"cast(n - ceil({PERCENT} * n / 100) + 1 as int)")
    each = many.dropDuplicates(["id"]).select("id", "n", "comp", F.explode(F.slice("rare", F.lit(1), first)).alias("element"))
    by_rare = each.join(renamed(each), "element").where(differ & fits).select("a", F.col("id").alias("b")).distinct()
    plain = many.where(100 * F.col("common") >= PERCENT * F.col("n"))
    bound = F.expr(f"CASE WHEN {enough.format('least(size(rare), size(rare_a))')} THEN {enough.format('size(array_intersect(rare, rare_a))')} ELSE false END")
    by_common = plain.join(renamed(plain), "bucket").where(differ & fits & bound).select("a", F.col("id").alias("b"))
    return pairs.union(by_rare).union(by_common)


def _placed(members: DataFrame, merged: DataFrame | None) -> DataFrame:
    """members with the component of each, the id itself where nothing was linked."""
    if merged is None:
        return members.withColumn("comp", F.col("id"))
    return members.join(merged, F.col("id") == F.col("u"), "left").withColumn("comp", F.coalesce("v", "id")).drop("u", "v")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; other columns are ignored.

    Linked are documents with 100 * intersection >= 75 * union; component_id is the smallest id reachable. Null and
    empty texts are linked with nothing. Rows that repeat an id are one document: their links count together, and all of
    them are kept if the id is its component's smallest. A row without id is never linked by others and is kept unless
    its set is that of a row with an id. Texts are read whole, however long: a text's set is held by one task, as 8 bytes
    for each distinct shingle. A table without rows gives none.
    """
    found = saved(_sketches(docs, key, text), "sketches")
    classes = found.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = found.join(classes.select(F.col("set_key").alias("_key"), "rep"), (F.col("set_key") == F.col("_key")) & (F.col("doc_id") == F.col("rep")))
    spread = reps.select(F.explode("buckets").alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    shared = spread.groupBy("bucket").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low < _high").select("bucket")
    members = saved(spread.join(shared, "bucket").distinct(), "members")
    ids = members.select(F.col("id").alias("_id")).distinct()
    own = docs.select(F.col(key).cast("long").alias(key), text)
    sets = bucketed(_sets(own.join(bounded(ids), F.col(key) == F.col("_id"), "left_semi"), key, text), "sets", "id")
    fits = F.expr(f"100 * least(n, m) >= {PERCENT} * greatest(n, m)")
    merged = None
    for turn in ("nearest", "hashed", "rest"):
        placed = _placed(members, merged)
        if turn == "rest":
            mixed = placed.groupBy("bucket").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("held")).where("_low < _high")
            held = saved(placed.join(mixed.select("bucket", "held"), "bucket"), "placed")
            crossing = _crossing(held, sets, fits).distinct()
        else:
            crossing = _starred(placed, fits, 1 if turn == "nearest" else CENTRES)
        pairs = saved(crossing, "pairs")
        if pairs.isEmpty():
            forget(pairs)
            if turn == "nearest":
                break
            continue
        fresh = saved(_verified(pairs, sets), "verified")
        forget(pairs)
        if not fresh.isEmpty():
            last, merged = merged, components(fresh if merged is None else merged.select(F.col("u").alias("a"), F.col("v").alias("b")).union(fresh))
            forget(last)
        forget(fresh)
    forget(sets, members)
    rows = classes.select(F.col("set_key").alias("_key"), "rep")
    placed = rows.select("_key", F.col("rep").alias("_comp")) if merged is None else rows.join(merged, F.col("rep") == F.col("u"), "left").select("_key", F.coalesce("v", "rep").alias("_comp"))
    slim = found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key"))
    out = slim.join(placed, F.col("set_key") == F.col("_key"), "left")
    component = F.coalesce("_comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component; of rows that share a kept id, one.

    Null and empty texts are components of their own and stay; so do rows without id, unless an id has their set. All
    columns stay as they were, whatever their names; a table without rows gives none.
    """
    marked = saved(near_duplicates(docs, key, text), "near-duplicates")
    gone = marked.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(bounded(gone), F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
    again = marked.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again")
    if again.isEmpty():
        return left
    again = bounded(again)
    return left.join(again, F.col(key) == F.col("_again"), "left_anti").unionByName(left.join(again, F.col(key) == F.col("_again"), "left_semi").dropDuplicates([key]))
