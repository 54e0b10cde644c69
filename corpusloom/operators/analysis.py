"""Document statistics, pronoun company, alignment, shuffled copies, coherence features, merge candidates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.coref import _allowed, _clusters, chain_grams, chased, merged_labels, nearest, pairs, representative_grams, subject_grams
from corpusloom.operators.evaluate import _F, _GUESS, bcubed_rows, fitted, fitted_sql, guesses, prf, ratio
from corpusloom.sources.shared import kept
from corpusloom.sources.views import MENTIONS_SQL, TYPES, mentions, split_words, table


def moments_of(value: str, prefix: str = "") -> list[Column]:
    """Mean, sample deviation, bias-corrected skewness and excess kurtosis; null for tiny or constant samples."""
    n = F.count(value).cast("double")
    skew = F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * (F.kurtosis(value) + 3) - 3 * (n - 1)) * (n - 1) / ((n - 2) * (n - 3)))
    return [(F.round(c, 4) + F.lit(0.0)).alias(prefix + a) for a, c in (("mean", F.avg(value)), ("std", F.stddev_samp(value)), ("skew", skew), ("kurt", kurt))]


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, entities, per_entity, moments of chain sizes, and mean and deviation of the longest chain's relative places."""
    rows = mentions(spark, sf_dir)
    chains = rows.groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("size"), F.min("idx").alias("first"))
    sizes = chains.groupBy("doc").agg(F.count(F.lit(1)).alias("entities"), F.round(F.sum("size") / F.count(F.lit(1)), 4).alias("per_entity"), *moments_of("size", "size_"))
    longest = chains.groupBy("doc").agg(F.min(F.struct((-F.col("size")).alias("s"), "first", "entity")).alias("c")).select("doc", "c.entity")
    length = F.max("idx").over(Window.partitionBy("doc")) + 1
    places = rows.withColumn("place", F.col("idx") / length).join(longest, ["doc", "entity"]).groupBy("doc").agg(F.round(F.avg("place"), 9).alias("top_mean"), F.round(F.stddev_samp("place"), 9).alias("top_std"))
    return sizes.join(places, "doc")


def chain_places(rows: DataFrame, least: int = 5, top: int = 3) -> DataFrame:
    """doc, place, entity, size, std, skew, kurt: moments of the relative places of a document's `top` longest chains of `least`
    mentions or more, the earlier of equals; among these, chains of one size stand by rising deviation."""
    length = rows.groupBy("doc").agg((F.max("idx") + 1).alias("_length"))
    chains = rows.groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("size"), F.min("idx").alias("first")).where(F.col("size") >= least)
    order = lambda *c: F.row_number().over(Window.partitionBy("doc").orderBy(F.col("size").desc(), *c))
    longest = chains.withColumn("_n", order("first")).where(F.col("_n") <= top).drop("_n")
    each = rows.join(length, "doc").select("doc", "entity", (F.col("idx") / F.col("_length")).alias("at")).join(longest, ["doc", "entity"])
    found = each.groupBy("doc", "entity", "size", "first").agg(*moments_of("at"))
    return found.withColumn("place", order("std", "first")).select("doc", "place", "entity", "size", "std", "skew", "kurt")


def top_chain_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_places(mentions(spark, sf_dir))


def company(rows: DataFrame, cluster: str, pronoun: str = "error") -> DataFrame:
    """kind, count: pronoun mentions by what stands in their cluster: nothing else, pronouns only, or other types too."""
    own = Window.partitionBy("doc", cluster)
    size, others = F.count(F.lit(1)).over(own), F.count_if(F.col("mtype") != pronoun).over(own)
    kind = F.when(size == 1, "alone").when(others == 0, "pronouns").otherwise("others")
    made = rows.select("mtype", kind.alias("kind"))
    return made.where(F.col("mtype") == pronoun).groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def pronoun_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (gold or predicted clusters), kind, count."""
    rows = mentions(spark, sf_dir)
    return company(rows, "entity").withColumn("source", F.lit("gold")).unionByName(company(rows, "pred").withColumn("source", F.lit("predicted")))


def pronoun_company_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after singletons were merged."""
    rows = mentions(spark, sf_dir)
    return company(rows.drop("pred").join(merged_labels(rows).select("doc", "idx", "pred"), ["doc", "idx"]), "pred").withColumn("source", F.lit("merged"))


def best_link_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, idx, cluster: the clusters of best links that go from no other type to a pronoun, after singletons were merged."""
    rows = mentions(spark, sf_dir)
    linked = _clusters(rows, _allowed(pairs(rows)), best=True)
    again = rows.drop("pred").join(linked.select("doc", "idx", F.col("cluster").alias("pred")), ["doc", "idx"])
    return merged_labels(again).select("doc", "idx", F.col("pred").alias("cluster"))


def gold_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, matched, missing, extra of gold and predicted mentions put side by side by their place in the sentence.

    Predicted are all mentions but every seventh; gold, all but every eleventh."""
    place = F.row_number().over(Window.partitionBy("doc", "sent").orderBy("idx"))
    rows = mentions(spark, sf_dir).select("doc", "sent", "idx")
    gold = rows.where("idx % 11 <> 0").withColumn("at", place).select("doc", "sent", "at", F.lit(1).alias("g"))
    predicted = rows.where("idx % 7 <> 0").withColumn("at", place).select("doc", "sent", "at", F.lit(1).alias("p"))
    both = gold.join(predicted, ["doc", "sent", "at"], "full_outer")
    return both.groupBy("doc").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"))


def shifted(scores: DataFrame, threshold: float = -5.5) -> DataFrame:
    """rows with true_score and false_score: the score less the threshold, and its opposite."""
    return scores.withColumns({"true_score": F.col("score") - threshold, "false_score": threshold - F.col("score")})


def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention with the next: their stored score by the pair's names, in either order; pairs without one are false."""
    rows = mentions(spark, sf_dir)
    stored = pairs(rows).where("(idx + prev) % 3 <> 0").select("doc", F.col("idx").alias("m1"), F.col("prev").alias("m2"), F.round("score", 4).alias("score"))
    stored = stored.unionByName(stored.select("doc", F.col("m2").alias("m1"), F.col("m1").alias("m2"), "score"))
    asked = rows.select("doc", F.col("idx").alias("m1"), F.lead("idx").over(Window.partitionBy("doc").orderBy("idx")).alias("m2")).where("m2 IS NOT NULL")
    found = shifted(asked.join(stored, ["doc", "m1", "m2"], "left"))
    return found.select("doc", "m1", "m2", "score", F.round("true_score", 4).alias("true_score"), F.round("false_score", 4).alias("false_score"), (F.coalesce("true_score", F.lit(-1.0)) >= 0).alias("linked"))


def weighted_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mtype, mentions, precision, recall, f1 of B-cubed by type, and a row `total` weighted by mentions."""
    rows = mentions(spark, sf_dir)
    w = lambda *c: F.count(F.lit(1)).over(Window.partitionBy("doc", *c))
    each = rows.select("mtype", (w("entity", "pred") / w("pred")).alias("p"), (w("entity", "pred") / w("entity")).alias("r"))
    sums = each.groupBy("mtype").agg(F.count(F.lit(1)).alias("mentions"), F.avg("p").alias("p"), F.avg("r").alias("r"))
    total = sums.agg(F.lit("total").alias("mtype"), F.sum("mentions").alias("mentions"), (F.sum(F.col("p") * F.col("mentions")) / F.sum("mentions")).alias("p"),
        (F.sum(F.col("r") * F.col("mentions")) / F.sum("mentions")).alias("r"))
    p, r = F.col("p"), F.col("r")
    return sums.unionByName(total).select("mtype", "mentions", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def typed_segments(rows: DataFrame, tags: str, keys: list[str]) -> DataFrame:
    """keys, type, first, last of the segments of an array of tags `B-type`, `I-type`, `O`.

    A segment opens at B- or where the type changes, and goes on over I- tags of its type.
    """
    t = F.col(tags)
    kind = lambda x: F.when(x != "O", F.substring(x, 3, 1000))
    before = lambda i: kind(F.coalesce(F.when(i > 0, F.get(t, i - F.lit(1))), F.lit("O")))
    opens = lambda x, i: (x != "O") & (x.startswith("B-") | ~kind(x).eqNullSafe(before(i)))
    after = lambda i: F.coalesce(F.get(t, i + F.lit(1)), F.lit("O"))
    closes = lambda x, i: (x != "O") & (after(i).startswith("B-") | ~kind(x).eqNullSafe(kind(after(i))))
    starts = F.array_compact(F.transform(t, lambda x, i: F.when(opens(x, i), F.struct(kind(x).alias("type"), i.alias("first")))))
    ends = F.array_compact(F.transform(t, lambda x, i: F.when(closes(x, i), i)))
    made = rows.select(*keys, F.explode(F.arrays_zip(starts.alias("s"), ends.alias("last"))).alias("x"))
    return made.select(*keys, "x.s.type", "x.s.first", "x.last")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gold and guess tags of conversation words: CAP and NUM words; a guess takes short words for none."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", split_words(F.col("text")).alias("w"))
    kind = lambda x, least: F.when(F.length(x) < least, "O").when(x.rlike(r"^\p{Lu}"), "CAP").when(x.rlike("^[0-9]"), "NUM").otherwise("O")

    def tagged(least: int) -> Column:
        k = F.transform("w", lambda x: kind(x, least))
        return F.transform(k, lambda x, i: F.when(x == "O", x).when((i > 0) & (F.get(k, i - F.lit(1)) == x) & (i % 4 != 0), F.concat(F.lit("I-"), x)).otherwise(F.concat(F.lit("B-"), x)))

    return rows.select("conv_id", "turn", tagged(1).alias("gold"), tagged(4).alias("guess"))


def typed_segment_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, n_gold, n_pred, n_hit, precision, recall, f1 of exact segments."""
    rows, keys = _tags(spark, sf_dir), ["conv_id", "turn"]
    gold = typed_segments(rows, "gold", keys).withColumn("g", F.lit(1))
    guess = typed_segments(rows, "guess", keys).withColumn("p", F.lit(1))
    both = gold.join(guess, [*keys, "type", "first", "last"], "full_outer").groupBy("type").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_pred"),
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("n_hit"))
    p, r = ratio(F.col("n_hit"), F.col("n_pred")), ratio(F.col("n_hit"), F.col("n_gold"))
    return both.select("type", "n_gold", "n_pred", "n_hit", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def performance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, label, precision, recall, f1 in percent (0 where undefined), n_gold, n_pred; null labels behind the others,
    then `Overall` over the labels that aren't null and `Accuracy`."""
    rows = guesses(spark, sf_dir)
    percent = lambda c: F.round(100 * F.coalesce(c, F.lit(0.0)), 3)
    null = F.col("label") == "none"
    each = prf(rows).select("label", percent(F.col("precision")).alias("precision"), percent(F.col("recall")).alias("recall"), percent(F.col("f")).alias("f1"), "n_gold", "n_pred",
        F.when(null, 1).otherwise(0).alias("place"))
    real = lambda c: F.col(c) != "none"
    hit = F.col("gold") == F.col("pred")
    sums = rows.agg(F.count_if(hit & real("pred")).alias("h"), F.count_if(real("pred")).alias("p"), F.count_if(real("gold")).alias("g"), F.count_if(hit).alias("a"), F.count(F.lit(1)).alias("n"))
    p, r = ratio(F.col("h"), F.col("p")), ratio(F.col("h"), F.col("g"))
    overall = sums.select(F.lit("Overall").alias("label"), percent(p).alias("precision"), percent(r).alias("recall"), percent(F.try_divide(2 * p * r, p + r)).alias("f1"),
        F.col("g").alias("n_gold"), F.col("p").alias("n_pred"), F.lit(2).alias("place"))
    accuracy = sums.select(F.lit("Accuracy").alias("label"), *[percent(ratio(F.col("a"), F.col("n"))).alias(c) for c in ("precision", "recall", "f1")], F.col("n").alias("n_gold"),
        F.col("n").alias("n_pred"), F.lit(3).alias("place"))
    return each.unionByName(overall).unionByName(accuracy)


_MARKERS = {"en": " the ", "de": " der ", "fr": " les ", "es": " que "}


def mass_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classifier, s0 to s7: the share of right answers of each one-word language test on eight parts of the documents."""
    rows = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(8)).alias("setting"), "lang", "text")
    each = rows.select("setting", F.explode(F.array(*[F.struct(F.lit(k).alias("classifier"), ((F.col("lang") == k) == F.coalesce(F.col("text").contains(m),
        F.lit(False))).cast("int").alias("hit")) for k, m in _MARKERS.items()])).alias("x"))
    made = each.groupBy("x.classifier").pivot("setting", list(range(8))).agg(F.round(F.avg("x.hit"), 6))
    return made.select("classifier", *[F.col(str(i)).alias(f"s{i}") for i in range(8)])


def timing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and greatest value over documents, and which documents have them (the first of equals); values stand for times."""
    each = mentions(spark, sf_dir).groupBy("doc").agg(F.round(F.sum("v"), 4).alias("time"))
    first = F.min(F.struct("time", "doc"))
    last = F.min(F.struct((-F.col("time")).alias("time"), "doc"))
    return each.agg(F.round(F.avg("time"), 4).alias("mean"), F.min("time").alias("least"), F.max("time").alias("greatest"), first["doc"].alias("fastest"), last["doc"].alias("slowest"))


def drawn(*parts: Column | str) -> Column:
    """A number of 32 bits from the digest of the parts: the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def shuffled_copies(rows: DataFrame, copies: int = 1, seed: int = 7) -> DataFrame:
    """rows with `copy` from 1: in each copy every mention's entity is drawn anew, with replacement, from the document's.

    A document of s sentences (a column `sent`) has at most s * (s - 1) / 4 copies.
    """
    most = F.floor(F.count_distinct("sent") * (F.count_distinct("sent") - 1) / 4) if "sent" in rows.columns else F.lit(copies)
    ids = rows.groupBy("doc").agg(F.array_sort(F.collect_set("entity")).alias("ids"), F.least(most, F.lit(copies)).cast("int").alias("_most"))
    made = rows.join(ids, "doc").where("_most > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_most")))).drop("_most")
    return made.withColumn("entity", _redrawn(F.col("copy"), seed)).drop("ids")


def _redrawn(copy: Column, seed: int) -> Column:
    """Of a mention beside the sorted entities `ids` of its document: the one drawn for it in a copy."""
    return F.get("ids", F.pmod(drawn("doc", "idx", copy, F.lit(seed)), F.size("ids")).cast("int"))


def entity_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, copy, idx, entity of two copies of each document."""
    return shuffled_copies(mentions(spark, sf_dir).select("doc", "idx", "entity"), 2).select("doc", "copy", "idx", "entity")


def sentence_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, sent, place, start: sentences in drawn order, and the mentions before each in the new order."""
    sizes = mentions(spark, sf_dir).groupBy("doc", "sent").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("doc").orderBy(drawn("doc", "sent", F.lit(7)), "sent")
    return sizes.select("doc", "sent", (F.row_number().over(order) - 1).alias("place"), (F.sum("n").over(order) - F.col("n")).alias("start"))


def document_pairs(one: DataFrame, other: DataFrame, key: str = "doc") -> DataFrame:
    """key, first, second: rows of two tables of documents with equal keys, side by side."""
    pack = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    return pack(one, "first").join(pack(other, "second"), key)


def bigram_differences(rows: DataFrame, seed: int = 7) -> DataFrame:
    """doc, kind, gram, diff of the grid and chain bigrams of coherence_features; places of a document rise with its sentences.

    Documents are dealt once: entities are drawn anew, chains and grids read in one order and grams counted where a document's rows are. A sentence that
    has an entity begins one gram of the grid, and ends one if the entity isn't in the sentence before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("doc", "sent", "idx", "entity", "mtype", "rank").repartition(parts, "doc")
    docs = dealt.groupBy("doc").agg(F.collect_list(F.struct("sent", "idx", "entity", "mtype", "rank")).alias("m"), F.array_sort(F.collect_set("entity")).alias("ids"), F.max("sent").alias("end"), F.size(F.collect_set("sent")).alias("s"))
    each = docs.select("doc", "ids", "end", "s", F.explode("m").alias("m")).select("doc", "ids", "end", "s", "m.*")
    copied = F.col("doc").isNotNull() & (F.floor(F.col("s") * (F.col("s") - 1) / 4) > 0)  # as in shuffled_copies
    each = each.withColumn("drawn", F.when(copied, _redrawn(F.lit(1), seed))).withColumn("side", F.explode(F.when(copied, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))))
    each = each.select("doc", "end", "sent", "idx", "mtype", "rank", "side", F.when(F.col("side") == 1, F.col("entity")).otherwise(F.col("drawn")).alias("entity"))
    held = Window.partitionBy("doc", "side", "entity", "sent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chain = Window.partitionBy("doc", "side", "entity").orderBy("sent", "idx")
    name = lambda c: F.coalesce(F.get(F.array(*[F.lit(x) for x in TYPES]), c.cast("int")), F.lit("X"))
    each = each.withColumn("cell", F.min("rank").over(held)).select("doc", "end", "sent", "side", "mtype", "cell", F.lag("sent").over(chain).alias("before"), F.lead("sent").over(chain).alias("after"),
        F.lead("mtype").over(chain).alias("mtype2"), F.lead("cell").over(chain).alias("cell2"), F.lag(F.lit(1)).over(chain).isNull().alias("first"), F.lead(F.lit(1)).over(chain).isNull().alias("last"))
    sent, cell, before, after, grid = F.col("sent"), name(F.col("cell")), F.col("before"), F.col("after"), F.col("doc").isNotNull()
    begun = F.when(grid & (F.col("last") | (after > sent)) & (sent < F.col("end")), F.concat_ws(" ", cell, F.when(after == sent + 1, name(F.col("cell2"))).otherwise("X")))
    ended = F.when(grid & (F.col("first") | (before < sent - 1)) & (sent > 0), F.concat_ws(" ", F.lit("X"), cell))
    chained = F.when(~F.col("last") | F.col("first"), F.concat_ws(" ", "mtype", "mtype2"))
    kinds = [("chain2", chained), ("grid2", F.nullif(begun, F.lit("X X"))), ("grid2", F.nullif(ended, F.lit("X X")))]
    made = each.select("doc", "side", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), g.alias("gram")) for k, g in kinds])).alias("x")).select("doc", "side", "x.kind", "x.gram")
    return made.where(F.col("gram").isNotNull()).groupBy("doc", "kind", "gram").agg(F.sum("side").alias("diff")).where("diff <> 0")


def coherence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, kind, gram, diff: counts of a document's n-grams less those of its shuffled copy; grid and chain bigrams and
    trigrams, subject bigrams. Only grams whose counts differ."""
    rows = mentions(spark, sf_dir)
    copy = shuffled_copies(rows).drop("copy")
    keys = ("doc", "side")
    both = kept(rows.withColumn("side", F.lit(1)).unionByName(copy.withColumn("side", F.lit(-1))), "sides")  # read once for each kind, not shuffled for either side
    made = {"grid3": lambda r: representative_grams(r, 3, keys), "chain3": lambda r: chain_grams(r, 3, keys), "subject2": lambda r: subject_grams(r, keys)}
    out = None
    for kind, of in made.items():
        own = of(both).select("doc", F.lit(kind).alias("kind"), "gram", (F.col("side") * F.col("count")).alias("n"))
        out = own if out is None else out.unionByName(own)
    return bigram_differences(rows).unionByName(out.groupBy("doc", "kind", "gram").agg(F.sum("n").alias("diff")).where("diff <> 0"))


def coherence_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs, n_right, accuracy of telling a document from two shuffled copies by which has more neighbours of one entity."""
    rows = mentions(spark, sf_dir).select("doc", "idx", "entity")
    keep = lambda keys: Window.partitionBy(*keys).orderBy("idx")
    own = rows.withColumn("same", F.lag("entity").over(keep(["doc"])) == F.col("entity")).groupBy("doc").agg(F.count_if("same").alias("own"))
    copies = shuffled_copies(rows, 2).withColumn("same", F.lag("entity").over(keep(["doc", "copy"])) == F.col("entity")).groupBy("doc", "copy").agg(F.count_if("same").alias("theirs"))
    judged = copies.join(own, "doc").select((F.col("own") >= F.col("theirs")).alias("right"))
    return judged.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("right").alias("n_right"), F.round(F.avg(F.col("right").cast("int")), 6).alias("accuracy"))


def b3_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, first, second, label: B-cubed F1 of the predicted clusters and of a shuffled copy; whether the first is strictly higher."""
    rows = mentions(spark, sf_dir)
    copy = shuffled_copies(rows.select("doc", "idx", F.col("pred").alias("entity")))
    other = rows.select("doc", "idx", "entity").join(copy.select("doc", "idx", F.col("entity").alias("pred")), ["doc", "idx"])
    one, two = bcubed_rows(rows).select("doc", F.col("f1").alias("first")), bcubed_rows(other).select("doc", F.col("f1").alias("second"))
    return one.join(two, "doc").withColumn("label", F.col("first") > F.col("second"))


def candidates(rows: DataFrame) -> DataFrame:
    """doc, a, b, size, score, gain: each pair of predicted clusters, the size of the merged one, the highest pair score over
    the border, and what merging adds to the sums of B-cubed precision and recall.

    From counts of (gold, predicted) cells, without pairs of mentions; the score is 10 less the least distance of two values.
    """
    cells = rows.groupBy("doc", "pred", "entity").agg(F.count(F.lit(1)).alias("o"))
    sizes = rows.groupBy("doc", "pred").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("v")).alias("values"))
    gold = rows.groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("g"))
    squares = cells.groupBy("doc", "pred").agg(F.sum(F.col("o") * F.col("o")).alias("q"))
    each = sizes.join(squares, ["doc", "pred"])
    one = each.select("doc", F.col("pred").alias("a"), F.col("n").alias("na"), F.col("q").alias("qa"), F.col("values").alias("va"))
    two = each.select("doc", F.col("pred").alias("b"), F.col("n").alias("nb"), F.col("q").alias("qb"), F.col("values").alias("vb"))
    met = cells.select("doc", F.col("pred").alias("a"), "entity", F.col("o").alias("oa")).join(cells.select("doc", F.col("pred").alias("b"), "entity", F.col("o").alias("ob")),
        ["doc", "entity"]).where("a < b").join(gold, ["doc", "entity"])
    met = met.groupBy("doc", "a", "b").agg(F.sum(2 * F.col("oa") * F.col("ob")).alias("cross"), F.sum(2 * F.col("oa") * F.col("ob") / F.col("g")).alias("dr"))
    both = one.join(two, "doc").where("a < b").join(met, ["doc", "a", "b"], "left")
    cross, dr = F.coalesce("cross", F.lit(0)), F.coalesce("dr", F.lit(0.0))
    dp = (F.col("qa") + F.col("qb") + cross) / (F.col("na") + F.col("nb")) - F.col("qa") / F.col("na") - F.col("qb") / F.col("nb")
    near = F.array_min(F.transform("va", lambda x: F.array_min(F.transform("vb", lambda y: F.abs(x - y)))))
    return both.select("doc", "a", "b", (F.col("na") + F.col("nb")).alias("size"), (F.round(10.0 - near, 4) + F.lit(0.0)).alias("score"), (F.round(dp + dr, 6) + F.lit(0.0)).alias("gain"))


#: Filters over merge candidates by name: which to keep.
FILTERS = {
    "none": lambda: F.lit(True),
    "size": lambda: F.col("size") <= 2,
    "gain": lambda: F.col("gain") >= 0,
    "score": lambda: F.col("score") >= 9.9,
}


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates, and by which filters each is kept."""
    return candidates(mentions(spark, sf_dir)).select("*", *[keep().alias(f"by_{name}") for name, keep in FILTERS.items()])


def merge_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, r, slope, intercept of the gain on the score, over a document's candidates."""
    return candidates(mentions(spark, sf_dir)).groupBy("doc").agg(*fitted("gain", "score", 4))


def best_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, a, b, gain: the merge of each document that gains most, the first of equals."""
    best = candidates(mentions(spark, sf_dir)).groupBy("doc").agg(F.min(F.struct((-F.col("gain")).alias("g"), "a", "b")).alias("m"))
    return best.select("doc", "m.a", "m.b", (F.lit(0.0) - F.col("m.g")).alias("gain"))


def coherence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, a, b, swapped, label: each document beside the one with clusters a and b merged, in an order drawn from their
    names; label: whether the first of the two has the higher B-cubed sums."""
    rows = candidates(mentions(spark, sf_dir)).where(FILTERS["size"]())
    swapped = drawn("doc", "a", "b") % 2 == 1
    return rows.select("doc", "a", "b", swapped.alias("swapped"), F.when(swapped, F.col("gain") > 0).otherwise(F.col("gain") < 0).alias("label"))


THRESHOLDS = (9.9, 9.95, 9.99)


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """threshold, precision, recall, f1: B-cubed over all documents of closest-antecedent clusters at three thresholds."""
    rows = mentions(spark, sf_dir)
    near, out = kept(nearest(pairs(rows), THRESHOLDS), "nearest"), None  # the pairs are made once for all thresholds
    for i, t in enumerate(THRESHOLDS):
        found = chased(rows, near.select("doc", "idx", F.col(f"link{i}").alias("link"))).select("doc", "idx", F.col("cluster").alias("pred"))
        scored = bcubed_rows(rows.select("doc", "idx", "entity").join(found, ["doc", "idx"])).select(F.lit(t).alias("threshold"), "mentions", "precision", "recall")
        out = scored if out is None else out.unionByName(scored)
    sums = out.groupBy("threshold").agg(*[(F.sum(F.col(c) * F.col("mentions")) / F.sum("mentions")).alias(c) for c in ("precision", "recall")])
    p, r = F.col("precision"), F.col("recall")
    return sums.select("threshold", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))


_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_COPY = f"""ids AS (SELECT doc, list(DISTINCT entity ORDER BY entity) AS ids FROM mentions GROUP BY 1),
    copies AS (SELECT m.* EXCLUDE (entity), copy, ids[1 + {_DRAW.format("concat_ws(':', m.doc, idx, copy, 7)")} % len(ids)] AS entity FROM mentions m JOIN ids USING (doc), (SELECT unnest([1, 2]) AS copy))"""
_M = f"WITH {MENTIONS_SQL}"


def _grams_sql(source: str, kind: str) -> str:
    """doc, gram, n of one kind of n-gram over a table of mentions."""
    if kind.startswith("chain"):
        n = int(kind[-1])
        gram = " || ".join(["mtype", *[f"coalesce(' ' || lead(mtype, {k}) OVER c, '')" for k in range(1, n)]])
        return f"SELECT doc, gram, count(*) AS n FROM (SELECT doc, {gram} AS gram, row_number() OVER c AS nth, count(*) OVER (PARTITION BY doc, entity) AS size FROM {source} WINDOW c AS (PARTITION BY doc, entity ORDER BY idx)) WHERE nth <= greatest(size - {n - 1}, 1) GROUP BY ALL"
    if kind == "subject2":
        s = f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY doc, sent ORDER BY rank, idx, mtype, entity) = 1)"
        return f"SELECT a.doc, a.mtype || ' ' || b.mtype || CASE WHEN a.entity = b.entity THEN '+' ELSE '-' END AS gram, count(*) AS n FROM {s} a JOIN {s} b ON a.doc = b.doc AND b.sent = a.sent + 1 GROUP BY ALL"
    n = int(kind[-1])
    cells = f"(SELECT doc, entity, unnest(range(0, last + 1)) AS sent FROM (SELECT DISTINCT doc, entity FROM {source}) JOIN (SELECT doc, max(sent) AS last FROM {source} GROUP BY 1) USING (doc))"
    name = "coalesce(list_extract(['purchase', 'signup', 'click', 'view', 'error'], (1 + min(m.rank))::INT), 'X')"
    gram = " || ' ' || ".join(["k", *[f"lead(k, {i}) OVER w" for i in range(1, n)]])
    return f"""SELECT doc, gram, count(*) AS n FROM (SELECT doc, {gram} AS gram FROM (SELECT c.doc, c.entity, c.sent, {name} AS k FROM {cells} c LEFT JOIN {source} m USING (doc, entity, sent) GROUP BY ALL)
        WINDOW w AS (PARTITION BY doc, entity ORDER BY sent)) WHERE gram IS NOT NULL AND gram <> '{" ".join("X" * n)}' GROUP BY ALL"""


_CANDIDATES = f"""{_M}, cells AS (SELECT doc, pred, entity, count(*) AS o FROM mentions GROUP BY ALL), sizes AS (SELECT doc, pred, count(*) AS n FROM mentions GROUP BY ALL),
    gold AS (SELECT doc, entity, count(*) AS g FROM mentions GROUP BY ALL), squares AS (SELECT doc, pred, sum(o * o) AS q FROM cells GROUP BY ALL),
    near AS (SELECT x.doc, x.pred AS a, y.pred AS b, min(abs(x.v - y.v)) AS d FROM mentions x JOIN mentions y ON x.doc = y.doc AND x.pred < y.pred GROUP BY ALL),
    met AS (SELECT x.doc, x.pred AS a, y.pred AS b, sum(2 * x.o * y.o) AS c, sum(2 * x.o * y.o / g) AS dr FROM cells x JOIN cells y ON x.doc = y.doc AND x.entity = y.entity
            AND x.pred < y.pred JOIN gold ON gold.doc = x.doc AND gold.entity = x.entity GROUP BY ALL),
    cand AS (SELECT near.doc, near.a, near.b, sa.n + sb.n AS size, round(10.0 - d, 4) + 0.0 AS score,
        round((qa.q + qb.q + coalesce(c, 0)) / (sa.n + sb.n) - qa.q / sa.n - qb.q / sb.n + coalesce(dr, 0), 6) + 0.0 AS gain
        FROM near JOIN sizes sa ON sa.doc = near.doc AND sa.pred = a JOIN sizes sb ON sb.doc = near.doc AND sb.pred = b JOIN squares qa ON qa.doc = near.doc AND qa.pred = a JOIN squares qb ON qb.doc = near.doc AND qb.pred = b
        LEFT JOIN met ON met.doc = near.doc AND met.a = near.a AND met.b = near.b)"""


def _b3_sql(source: str) -> str:
    return f"""SELECT doc, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM (SELECT doc, avg(o / p) AS p, avg(o / g) AS r FROM (
        SELECT doc, count(*) OVER (PARTITION BY doc, entity, pred) AS o, count(*) OVER (PARTITION BY doc, pred) AS p, count(*) OVER (PARTITION BY doc, entity) AS g FROM {source}) GROUP BY 1)"""


def _kind_sql(least: int) -> str:
    return rf"CASE WHEN len(x) < {least} THEN 'O' WHEN regexp_matches(x, '^\p{{Lu}}') THEN 'CAP' WHEN regexp_matches(x, '^[0-9]') THEN 'NUM' ELSE 'O' END"


def _segments_sql(name: str, least: int) -> str:
    """Segments from runs: a word opens one where its type isn't the one before or its place divides by 4."""
    return f"""{name}_k AS (SELECT conv_id, turn, pos, {_kind_sql(least)} AS kind FROM w), {name}_o AS (SELECT *, kind <> 'O' AND (pos % 4 = 0 OR kind IS DISTINCT
            FROM lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY pos)) AS opens FROM {name}_k),
        {name} AS (SELECT conv_id, turn, kind AS type, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS k
            FROM {name}_o) WHERE kind <> 'O' GROUP BY conv_id, turn, kind, k)"""


def _f1_sql(gold: str, pred: str) -> str:
    """B-cubed F1 of two lists of labels."""
    n = f"len({gold})"
    both = f"len(list_filter(range(1, {n} + 1), lambda y: {gold}[y] = {gold}[x] AND {pred}[y] = {pred}[x]))"
    mean = lambda labels: f"list_sum(list_transform(range(1, {n} + 1), lambda x: {both} / len(list_filter(range(1, {n} + 1), lambda y: {labels}[y] = {labels}[x])))) / {n}"
    return f"(2 * {mean(pred)} * {mean(gold)} / ({mean(pred)} + {mean(gold)}))"


def merged_sql(source: str) -> str:
    """Common tables of the singleton merge over rows (doc, idx, entity, pred, mtype), `after` (doc, idx, entity, mtype, pred) last."""
    others = "list_filter(range(1, len(g) + 1), lambda j: g[j] = g[i] AND j <> i)"
    return f"""lists AS (SELECT doc, list(entity ORDER BY idx) AS g, list(pred::BIGINT ORDER BY idx) AS p, list(mtype ORDER BY idx) AS m FROM {source} GROUP BY doc),
        steps AS (SELECT doc, g, i, row_number() OVER (PARTITION BY doc ORDER BY i) AS s FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM lists) WHERE m[i] = 'error' AND len({others}) > 0 AND len(list_filter(p, lambda x: x = p[i])) = 1),
        merge AS (
            SELECT doc, 0::BIGINT AS s, p, 0::BIGINT AS merged, 0::BIGINT AS bad FROM lists
            UNION ALL
            SELECT doc, s + 1, CASE WHEN best.f > now + 1e-10 THEN list_concat(list_append(p[1:i - 1], -best.c), p[i + 1:]) ELSE p END, merged + CASE WHEN best.f > now + 1e-10 THEN 1 ELSE 0 END, bad + CASE WHEN best.f <= now + 1e-10 THEN 1 ELSE 0 END
            FROM (SELECT *, CASE WHEN single THEN {_f1_sql("g", "p")} END AS now,
                    CASE WHEN single THEN list_max(list_transform(tried, lambda t: {{'f': round({_f1_sql("g", "t.q")}, 11), 'c': -t.c}})) END AS best
                FROM (SELECT *, list_transform(labels, lambda c: {{'c': c, 'q': list_concat(list_append(p[1:i - 1], c), p[i + 1:])}}) AS tried
                    FROM (SELECT r.doc, r.s, r.p, r.merged, r.bad, t.g, t.i, len(list_filter(r.p, lambda x: x = r.p[t.i])) = 1 AS single,
                            list_distinct(list_transform(list_filter(range(1, len(t.g) + 1), lambda j: t.g[j] = t.g[t.i] AND j <> t.i), lambda j: r.p[j])) AS labels
                        FROM merge r JOIN steps t ON t.doc = r.doc AND t.s = r.s + 1)))),
        merges AS (SELECT doc, p, merged, bad FROM merge QUALIFY s = max(s) OVER (PARTITION BY doc)),
        after AS (SELECT x.doc, x.idx, x.entity, x.mtype, d.p[x.idx + 1] AS pred FROM {source} x JOIN merges d USING (doc))"""


QUERIES = {f.__name__: f for f in (document_statistics, top_chain_moments, pronoun_company, pronoun_company_merged, best_link_merged, gold_alignment, score_lookup, weighted_total,
    typed_segment_prf, performance_table, mass_results, timing_statistics, entity_shuffle, sentence_shuffle, coherence_features, coherence_accuracy, b3_label, merge_candidates,
    merge_correlation, best_merge, coherence_pairs, threshold_sweep)}
SQL = {
    "document_statistics": f"""{_M}, chains AS (SELECT doc, entity, count(*) AS size, min(idx) AS first FROM mentions GROUP BY ALL),
        sizes AS (SELECT doc, count(*) AS entities, round(sum(size) / count(*), 4) AS per_entity, round(avg(size), 4) AS size_mean, round(stddev_samp(size), 4) AS size_std,
            round(skewness(size), 4) + 0.0 AS size_skew, round(kurtosis(size), 4) + 0.0 AS size_kurt FROM chains GROUP BY 1),
        longest AS (SELECT doc, entity FROM chains QUALIFY row_number() OVER (PARTITION BY doc ORDER BY size DESC, first) = 1),
        places AS (SELECT doc, round(avg(place), 9) AS top_mean, round(stddev_samp(place), 9) AS top_std FROM (SELECT *, idx / (max(idx) OVER (PARTITION BY doc) + 1) AS place
            FROM mentions) JOIN longest USING (doc, entity) GROUP BY 1)
        SELECT * FROM sizes JOIN places USING (doc)""",
    "top_chain_moments": f"""{_M}, chains AS (SELECT doc, entity, count(*) AS size, min(idx) AS first FROM mentions GROUP BY doc, entity HAVING count(*) >= 5 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, min(idx)) <= 3),
        m AS (SELECT doc, entity, size, first, round(stddev_samp(spot), 4) AS std, round(skewness(spot), 4) + 0.0 AS skew, round(kurtosis(spot), 4) + 0.0 AS kurt
            FROM (SELECT *, idx / (max(idx) OVER (PARTITION BY doc) + 1) AS spot FROM mentions) JOIN chains USING (doc, entity) GROUP BY ALL)
        SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY size DESC, std, first)::INT AS place, entity, size, std, skew, kurt FROM m""",
    "pronoun_company": f"""{_M}, c AS (SELECT 'gold' AS source, mtype, count(*) OVER w AS size, count(*) FILTER (mtype <> 'error') OVER w AS others FROM mentions WINDOW w AS (PARTITION BY doc, entity)
        UNION ALL SELECT 'predicted', mtype, count(*) OVER w, count(*) FILTER (mtype <> 'error') OVER w FROM mentions WINDOW w AS (PARTITION BY doc, pred))
        SELECT source, CASE WHEN size = 1 THEN 'alone' WHEN others = 0 THEN 'pronouns' ELSE 'others' END AS kind, count(*) AS count FROM c WHERE mtype = 'error' GROUP BY ALL""",
    "gold_alignment": f"""{_M}, g AS (SELECT doc, sent, row_number() OVER (PARTITION BY doc, sent ORDER BY idx) AS at FROM mentions WHERE idx % 11 <> 0), p AS (SELECT doc, sent,
            row_number() OVER (PARTITION BY doc, sent ORDER BY idx) AS at FROM mentions WHERE idx % 7 <> 0)
        SELECT coalesce(g.doc, p.doc) AS doc, count(*) FILTER (g.at IS NOT NULL AND p.at IS NOT NULL) AS matched, count(*) FILTER (p.at IS NULL) AS missing, count(*) FILTER (g.at IS NULL) AS extra
        FROM g FULL JOIN p ON g.doc = p.doc AND g.sent = p.sent AND g.at = p.at GROUP BY 1""",
    "score_lookup": f"""{_M}, a AS (SELECT * FROM (SELECT doc, idx AS m1, lead(idx) OVER n AS m2, CASE WHEN (idx + lead(idx) OVER n) % 3 <> 0 THEN round(10.0 - abs(v - lead(v) OVER n), 4) END AS score FROM mentions
            WINDOW n AS (PARTITION BY doc ORDER BY idx)) WHERE m2 IS NOT NULL)
        SELECT doc, m1, m2, score, round(score + 5.5, 4) AS true_score, round(-5.5 - score, 4) AS false_score, coalesce(score + 5.5, -1) >= 0 AS linked FROM a""",
    "weighted_total": f"""{_M}, o AS (SELECT mtype, count(*) OVER (PARTITION BY doc, entity, pred) AS o, count(*) OVER (PARTITION BY doc, pred) AS p, count(*) OVER (PARTITION BY doc, entity) AS g FROM mentions),
        s AS (SELECT coalesce(mtype, 'total') AS mtype, count(*) AS mentions, avg(o / p) AS p, avg(o / g) AS r FROM o GROUP BY GROUPING SETS ((mtype), ()))
        SELECT mtype, mentions, round(p, 6) AS precision, round(r, 6) AS recall, {_F} AS f1 FROM s""",
    "typed_segment_prf": f"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM conversations), w AS (SELECT conv_id, turn,
            generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS x FROM t),
        {_segments_sql("gold", 1)}, {_segments_sql("guess", 4)},
        s AS (SELECT coalesce(g.type, p.type) AS type, count(g.type) AS n_gold, count(p.type) AS n_pred, count(*) FILTER (g.type IS NOT NULL AND p.type IS NOT NULL) AS n_hit
            FROM gold g FULL JOIN guess p ON g.conv_id = p.conv_id AND g.turn = p.turn AND g.type = p.type AND g.first = p.first AND g.last = p.last GROUP BY 1),
        x AS (SELECT *, n_hit / nullif(n_pred, 0) AS p, n_hit / nullif(n_gold, 0) AS r FROM s)
        SELECT type, n_gold, n_pred, n_hit, round(p, 6) AS precision, round(r, 6) AS recall, {_F} AS f1 FROM x""",
    "performance_table": f"""{_GUESS}, s AS (SELECT label, sum(g) AS n_gold, sum(p) AS n_pred, sum(h) AS h FROM (SELECT gold AS label, 1 AS g, 0 AS p, (gold = pred)::INT AS h
            FROM g UNION ALL SELECT pred, 0, 1, 0 FROM g) GROUP BY 1),
        each AS (SELECT label, n_gold, n_pred, h, CASE WHEN label = 'none' THEN 1 ELSE 0 END AS place FROM s
            UNION ALL SELECT 'Overall', count(*) FILTER (gold <> 'none'), count(*) FILTER (pred <> 'none'), count(*) FILTER (gold = pred AND pred <> 'none'), 2 FROM g
            UNION ALL SELECT 'Accuracy', count(*), count(*), count(*) FILTER (gold = pred), 3 FROM g),
        r AS (SELECT *, coalesce(round(h / nullif(n_pred, 0), CASE WHEN place < 2 THEN 6 ELSE 15 END), 0) AS p, coalesce(round(h / nullif(n_gold, 0), CASE
            WHEN place < 2 THEN 6 ELSE 15 END), 0) AS q, coalesce(round(2 * h / nullif(n_gold + n_pred, 0), CASE WHEN place < 2 THEN 6 ELSE 15 END), 0) AS f FROM each)
        SELECT place, label, round(100 * p, 3) AS precision, round(100 * q, 3) AS recall, round(100 * CASE WHEN h = 0 THEN 0 ELSE f END, 3) AS f1, n_gold::BIGINT AS n_gold, n_pred::BIGINT AS n_pred FROM r""",
    "mass_results": "WITH c AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS classifier, unnest([' the ', ' der ', ' les ', ' que ']) AS m), h AS (SELECT classifier, doc_id % 8 AS s, ((lang = classifier) = coalesce(contains(text, m), false))::INT AS hit FROM documents, c) SELECT classifier, " + ", ".join(f"round(avg(hit) FILTER (s = {i}), 6) AS s{i}" for i in range(8)) + " FROM h GROUP BY 1",
    "timing_statistics": f"""{_M}, t AS (SELECT doc, round(sum(v), 4) AS time FROM mentions GROUP BY 1) SELECT round(avg(time), 4) AS mean, min(time) AS least,
        max(time) AS greatest, (SELECT doc FROM t ORDER BY time, doc LIMIT 1) AS fastest, (SELECT doc FROM t ORDER BY time DESC, doc LIMIT 1) AS slowest FROM t""",
    "entity_shuffle": f"{_M}, {_COPY} SELECT doc, copy, idx, entity FROM copies",
    "sentence_shuffle": f"""{_M}, s AS (SELECT doc, sent, count(*) AS n, {_DRAW.format("concat_ws(':', doc, sent, 7)")} AS d FROM mentions GROUP BY doc, sent)
        SELECT doc, sent, row_number() OVER w - 1 AS place, (sum(n) OVER w - n)::BIGINT AS start FROM s WINDOW w AS (PARTITION BY doc ORDER BY d, sent)""",
    "coherence_features": f"{_M}, {_COPY}, first AS (SELECT * FROM copies WHERE copy = 1), " + ", ".join(f"{k}_a AS ({_grams_sql('mentions', k)}), {k}_b AS ({_grams_sql('first', k)})" for k in ("grid2",
        "grid3", "chain2", "chain3",
        "subject2")) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT coalesce(a.doc, b.doc) AS doc, '{k}' AS kind, coalesce(a.gram, b.gram) AS gram, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff FROM {k}_a a FULL JOIN {k}_b b ON a.doc = b.doc AND a.gram = b.gram" for k in ("grid2",
        "grid3", "chain2", "chain3", "subject2")) + ") WHERE diff <> 0",
    "coherence_accuracy": f"""{_M}, {_COPY}, o AS (SELECT doc, count(*) FILTER (same) AS own FROM (SELECT doc, lag(entity) OVER (PARTITION BY doc ORDER BY idx) = entity AS same FROM mentions) GROUP BY 1),
        c AS (SELECT doc, copy, count(*) FILTER (same) AS theirs FROM (SELECT doc, copy, lag(entity) OVER (PARTITION BY doc, copy ORDER BY idx) = entity AS same FROM copies) GROUP BY ALL)
        SELECT count(*) AS pairs, count(*) FILTER (own >= theirs) AS n_right, round(avg((own >= theirs)::INT), 6) AS accuracy FROM c JOIN o USING (doc)""",
    "b3_label": f"""{_M}, ids AS (SELECT doc, list(DISTINCT pred ORDER BY pred) AS ids FROM mentions GROUP BY 1),
        other AS (SELECT m.doc, m.entity, ids[1 + {_DRAW.format("concat_ws(':', m.doc, idx, 1, 7)")} % len(ids)] AS pred FROM mentions m JOIN ids USING (doc)),
        a AS ({_b3_sql("mentions")}), b AS ({_b3_sql("other")}) SELECT doc, a.f1 AS first, b.f1 AS second, a.f1 > b.f1 AS label FROM a JOIN b USING (doc)""",
    "merge_candidates": f"{_CANDIDATES} SELECT *, true AS by_none, size <= 2 AS by_size, gain >= 0 AS by_gain, score >= 9.9 AS by_score FROM cand",
    "merge_correlation": f"{_CANDIDATES} SELECT doc, {fitted_sql('gain', 'score', 4)} FROM cand GROUP BY 1",
    "best_merge": f"{_CANDIDATES} SELECT doc, a, b, gain FROM cand QUALIFY row_number() OVER (PARTITION BY doc ORDER BY gain DESC, a, b) = 1",
    "singleton_merge": f"""WITH RECURSIVE {MENTIONS_SQL}, {merged_sql("mentions")}, b AS ({_b3_sql("after")}) SELECT doc, merged, bad, f1 FROM merges JOIN b USING (doc)""",
    "pronoun_company_merged": f"""WITH RECURSIVE {MENTIONS_SQL}, {merged_sql("mentions")},
        c AS (SELECT mtype, count(*) OVER w AS size, count(*) FILTER (mtype <> 'error') OVER w AS others FROM after WINDOW w AS (PARTITION BY doc, pred))
        SELECT 'merged' AS source, CASE WHEN size = 1 THEN 'alone' WHEN others = 0 THEN 'pronouns' ELSE 'others' END AS kind, count(*) AS count FROM c WHERE mtype = 'error' GROUP BY ALL""",
    "best_link_merged": f"""WITH RECURSIVE {MENTIONS_SQL},
        best AS (SELECT a.doc, a.idx, b.idx AS link FROM mentions a JOIN mentions b ON a.doc = b.doc AND b.idx < a.idx WHERE 10.0 - abs(a.v - b.v) > 0 AND (a.mtype = 'error' OR b.mtype <> 'error')
            QUALIFY row_number() OVER (PARTITION BY a.doc, a.idx ORDER BY 10.0 - abs(a.v - b.v) DESC, b.idx) = 1),
        roots AS (SELECT m.doc, m.idx, b.link FROM mentions m LEFT JOIN best b USING (doc, idx)),
        chase AS (SELECT doc, idx, idx AS cluster FROM roots WHERE link IS NULL UNION ALL SELECT r.doc, r.idx, c.cluster FROM roots r JOIN chase c ON r.doc = c.doc AND r.link = c.idx),
        linked AS (SELECT m.doc, m.idx, entity, mtype, cluster AS pred FROM mentions m JOIN chase USING (doc, idx)), {merged_sql("linked")} SELECT doc, idx, pred AS cluster FROM after""",
    "coherence_pairs": f"""{_CANDIDATES}, d AS (SELECT *, {_DRAW.format("concat_ws(':', doc, a, b)")} % 2 = 1 AS swapped FROM cand WHERE size <= 2) SELECT doc, a, b, swapped, CASE
            WHEN swapped THEN gain > 0 ELSE gain < 0 END AS label FROM d""",
    "threshold_sweep": f"""WITH RECURSIVE {MENTIONS_SQL}, near AS (SELECT t, a.doc, a.idx, max(b.idx) AS link FROM (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in THRESHOLDS)}]) AS t), mentions a JOIN mentions b ON a.doc = b.doc AND b.idx < a.idx WHERE 10.0 - abs(a.v - b.v) > t GROUP BY ALL),
        roots AS (SELECT t.t, m.doc, m.idx, n.link FROM (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in THRESHOLDS)}]) AS t) t CROSS JOIN mentions m LEFT JOIN near n ON n.t = t.t AND n.doc = m.doc AND n.idx = m.idx),
        chase AS (SELECT t, doc, idx, idx AS cluster FROM roots WHERE link IS NULL UNION ALL SELECT r.t, r.doc, r.idx, c.cluster FROM roots r JOIN chase c ON r.t = c.t AND r.doc = c.doc AND r.link = c.idx),
        o AS (SELECT t, m.doc, count(*) OVER (PARTITION BY t, m.doc, entity, cluster) AS o, count(*) OVER (PARTITION BY t, m.doc, cluster) AS p, count(*) OVER (PARTITION BY t,
            m.doc, entity) AS g FROM mentions m JOIN chase c ON c.doc = m.doc AND c.idx = m.idx),
        d AS (SELECT t, doc, count(*) AS n, round(avg(o / p), 6) AS p, round(avg(o / g), 6) AS r FROM o GROUP BY ALL), s AS (SELECT t AS threshold, sum(p * n) / sum(n) AS p, sum(r * n) / sum(n) AS r FROM d GROUP BY 1)
        SELECT threshold, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / nullif(p + r, 0), 4) AS f1 FROM s""",
}
