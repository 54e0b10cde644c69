"""Pairing, linking, n-grams and clustering over mention tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.views import MENTIONS_SQL, TYPES, mentions


def pair_score(v: Column, w: Column) -> Column:
    return F.lit(10.0) - F.abs(v - w)


BLOCK = 512


def pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each mention with every earlier one of its document.

    Earlier mentions are keyed by blocks of idx and each mention is sent to the blocks up to its own, so a task holds
    at most `block` earlier mentions of a key however long the document is.
    """
    number = lambda c: F.floor(F.col(c) / block).cast("int")
    earlier = rows.select("doc", F.col("idx").alias("prev"), F.col("v").alias("w"), F.col("mtype").alias("prev_type"), F.col("entity").alias("prev_entity"), number("idx").alias("_block"))
    later = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), number("idx"))))
    return later.join(earlier, ["doc", "_block"]).where("prev < idx").drop("_block").withColumn("score", pair_score(F.col("v"), F.col("w")))


def _paired(made: DataFrame) -> DataFrame:
    return made.select("doc", "prev", "idx", (F.col("entity") == F.col("prev_entity")).alias("same"), F.round("score", 4).alias("score"))


def mention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(pairs(mentions(spark, sf_dir)))


def _best(made: DataFrame) -> DataFrame:
    best = made.where("score > 0").groupBy("doc", "idx").agg(F.min(F.struct((-F.col("score")).alias("s"), "prev")).alias("b"))
    return best.select("doc", "idx", F.col("b.prev").alias("link"), F.round(-F.col("b.s"), 4).alias("score"))


def best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier mention of the document with the highest positive score, the first of equals."""
    return _best(pairs(mentions(spark, sf_dir)))


def _allowed(made: DataFrame) -> DataFrame:
    return made.where("mtype = 'error' OR prev_type <> 'error'")


def best_link_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best link without links from other types to `error`, the stand-in for pronouns."""
    return _best(_allowed(pairs(mentions(spark, sf_dir)))).drop("score")


def _clusters(rows: DataFrame, made: DataFrame, threshold: float = 9.9, best: bool = False) -> DataFrame:
    """Each mention's cluster: that of its nearest earlier partner over the threshold, or of its best one; else its own."""
    return chased(rows, _best(made).select("doc", "idx", "link") if best else nearest(made, [threshold]).withColumnRenamed("link0", "link"))


def nearest(made: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """doc, idx, link0, link1, ...: for each threshold the nearest earlier partner with a higher score; one group-by for all."""
    found = made.where(F.col("score") > min(thresholds)).groupBy("doc", "idx")
    return found.agg(*[F.max(F.when(F.col("score") > t, F.col("prev"))).alias(f"link{i}") for i, t in enumerate(thresholds)])


def chased(rows: DataFrame, near: DataFrame) -> DataFrame:
    """doc, idx, cluster: where following the links (doc, idx, link) of mentions ends."""

    def chase(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        label: dict = {}
        for idx, link in zip(group["idx"], group["link"], strict=True):
            label[idx] = idx if pd.isna(link) else label[int(link)]
        return pd.DataFrame({"doc": group["doc"], "idx": group["idx"], "cluster": [label[i] for i in group["idx"]]})

    return rows.select("doc", "idx").join(near, ["doc", "idx"], "left").groupBy("doc").applyInPandas(chase, "doc string, idx int, cluster long")


def closest_antecedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster ids by following each mention's nearest earlier partner with a score over 9.9; the chase runs inside a document."""
    rows = mentions(spark, sf_dir)
    return _clusters(rows, pairs(rows))


def chain_grams(rows: DataFrame, n: int = 2, keys: tuple = ("doc",)) -> DataFrame:
    """keys, gram, count: n-grams of types along each chain; n is cut to the chain's length."""
    chain = Window.partitionBy(*keys, "entity").orderBy("idx")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "entity"))
    gram = F.concat_ws(" ", "mtype", *[F.lead("mtype", k).over(chain) for k in range(1, n)])
    made = rows.select(*keys, gram.alias("gram"), F.row_number().over(chain).alias("at"), size.alias("size"))
    return made.where(F.col("at") <= F.greatest(F.col("size") - (n - 1), F.lit(1))).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("count"))


def chain_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_grams(mentions(spark, sf_dir))


def _grid(rows: DataFrame, cell: Column, keys: tuple = ("doc",)) -> DataFrame:
    """keys, entity, cells: the cell of each sentence up to the last one of the document that has a mention, null where the
    entity is absent. A document's last sentence is a maximum that tasks find first, so a long document meets in no task."""
    held = rows.groupBy(*keys, "entity", "sent").agg(cell.alias("cell"))
    by = held.groupBy(*keys, "entity").agg(F.map_from_entries(F.collect_list(F.struct("sent", "cell"))).alias("m"))
    last = rows.groupBy(*keys).agg(F.max("sent").alias("last"))
    return by.join(last, list(keys)).select(*keys, "entity", F.transform(F.sequence(F.lit(0), F.col("last")), lambda s: F.element_at("m", s)).alias("cells"))


def _starts(n: int) -> Column:
    """Places of `cells` where n cells in a row begin; none in a document of fewer sentences."""
    size = F.size("cells")
    return F.when(size >= n, F.sequence(F.lit(0), size - F.lit(n))).otherwise(F.array().cast("array<int>"))


def representative_grams(rows: DataFrame, n: int = 2, keys: tuple = ("doc",)) -> DataFrame:
    """keys, gram, count: n-grams of each entity's most specific type in consecutive sentences, `X` where absent, all-`X` dropped.

    A sentence in which an entity is puts its cell into the n grams that reach over it, by where they begin; no other gram is made.
    """
    held = rows.groupBy(*keys, "entity", "sent").agg(F.min("rank").alias("cell"))
    last = rows.groupBy(*keys).agg(F.max("sent").alias("last"))
    parts = held.select(*keys, "entity", "sent", "cell", F.explode(F.array(*[F.lit(k) for k in range(n)])).alias("k")).withColumn("start", F.col("sent") - F.col("k"))
    cells = parts.where("start >= 0").groupBy(*keys, "entity", "start").agg(*[F.max(F.when(F.col("k") == k, F.col("cell"))).alias(f"c{k}") for k in range(n)])
    name = lambda c: F.coalesce(F.get(F.array(*[F.lit(x) for x in TYPES]), c.cast("int")), F.lit("X"))
    gram = F.concat_ws(" ", *[name(F.col(f"c{k}")) for k in range(n)])
    made = cells.join(last, list(keys)).where(F.col("start") + (n - 1) <= F.col("last")).select(*keys, gram.alias("gram"))
    return made.where(F.col("gram") != " ".join("X" * n)).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("count"))


def grid_ngrams_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative_grams(mentions(spark, sf_dir))


def grid_trigrams_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative_grams(mentions(spark, sf_dir), 3)


def grid_ngrams_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of an entity's types in consecutive sentences, all-`X` kept."""
    grid = _grid(mentions(spark, sf_dir), F.collect_set("mtype"))
    own = lambda c: F.coalesce(c, F.array(F.lit("X")))
    grams = F.flatten(F.transform(_starts(2), lambda s: F.flatten(F.transform(own(F.get("cells", s)), lambda a: F.transform(own(F.get("cells",
        s + 1)), lambda b: F.concat_ws(" ", a, b))))))
    return grid.select("doc", F.explode(grams).alias("gram")).groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("count"))


def adjacency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type pairs of neighbouring mentions of a sentence, by whether they share the cluster."""
    near = Window.partitionBy("doc", "sent").orderBy("idx")
    rows = mentions(spark, sf_dir).select("doc", F.lag("mtype").over(near).alias("first"), F.col("mtype").alias("second"), (F.lag("entity").over(near) == F.col("entity")).alias("same"))
    return rows.where(F.col("first").isNotNull()).groupBy("doc", "first", "second", "same").agg(F.count(F.lit(1)).alias("count"))


def subject_grams(rows: DataFrame, keys: tuple = ("doc",)) -> DataFrame:
    """keys, gram, count: bigrams of the subjects (most specific, then first mention) of consecutive sentences, `+` for the same entity."""
    subject = rows.groupBy(*keys, "sent").agg(F.min(F.struct("rank", "idx", "mtype", "entity")).alias("s"))
    after = Window.partitionBy(*keys).orderBy("sent")
    made = subject.select(*keys, "sent", F.lead("sent").over(after).alias("next"), F.col("s.mtype").alias("a"), F.lead("s.mtype").over(after).alias("b"),
        (F.lead("s.entity").over(after) == F.col("s.entity")).alias("same"))
    gram = F.concat(F.col("a"), F.lit(" "), F.col("b"), F.when(F.col("same"), "+").otherwise("-"))
    return made.where("next = sent + 1").groupBy(*keys, gram.alias("gram")).agg(F.count(F.lit(1)).alias("count"))


def subject_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_grams(mentions(spark, sf_dir))


def gram_difference(one: DataFrame, other: DataFrame, key: str = "doc") -> DataFrame:
    """key, gram, diff: counts of one less those of the other, by a full outer join; a missing gram counts as 0."""
    return one.join(other.withColumnRenamed("count", "c1"), [key, "gram"], "full_outer").select(key, "gram", (F.coalesce("count", F.lit(0)) - F.coalesce("c1", F.lit(0))).alias("diff"))


def _following(grams: DataFrame) -> DataFrame:
    return grams.where(F.col("doc").cast("long") > 0).withColumn("doc", F.lpad((F.col("doc").cast("long") - 1).cast("string"), 8, "0"))


def ngram_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain bigram counts of a document minus those of the next one."""
    one = chain_grams(mentions(spark, sf_dir))
    return gram_difference(one, _following(one))


def all_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, entity, first, size, chain of each coreference chain."""
    return mentions(spark, sf_dir).groupBy("doc", "entity").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "mtype"))), lambda x: x["mtype"]), " ").alias("chain"))


def top_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest chains of at least 5 mentions of each document."""
    ranks = Window.partitionBy("doc").orderBy(F.col("size").desc(), "first")
    return all_chains(spark, sf_dir).where("size >= 5").withColumn("place", F.row_number().over(ranks)).where("place <= 3").select("doc", "entity", "size", "place")


def merge_singletons(gold: list, pred: list, kind: list, pronoun: str = "error") -> tuple[list, int, int]:
    """Labels after the merges, the merged mentions, and the singletons that stay bad.

    A predicted singleton of the pronoun type whose gold cluster has other members takes, in text order, the predicted
    label of one of those that raises B-cubed F1 most, the smallest of equals; a singleton that none helps is bad. Only
    the two clusters that a move changes are counted again.
    """
    pred, n = list(pred), len(gold)
    held, guessed, both = Counter(gold), Counter(pred), Counter(zip(gold, pred, strict=True))
    by_pred: dict = {}
    for (g, p), c in both.items():
        by_pred.setdefault(p, {})[g] = c
    precise = {p: sum(c * c for c in own.values()) / guessed[p] for p, own in by_pred.items()}
    found = sum(c * c / held[g] for (g, _), c in both.items())
    total = sum(precise.values())

    def f1(p: float, r: float) -> float:
        return 0.0 if p + r == 0 else 2 * p * r / (p + r) / n

    merged = bad = 0
    for i in range(n):
        if kind[i] != pronoun or guessed[pred[i]] != 1 or held[gold[i]] == 1:
            continue
        g, best = gold[i], (f1(total, found), None, 0.0, 0.0)
        for label in sorted({pred[j] for j in range(n) if gold[j] == g and j != i}):
            own = by_pred[label].get(g, 0)
            after = (precise[label] * guessed[label] + 2 * own + 1) / (guessed[label] + 1)
            p, r = total - 1 - precise[label] + after, found + 2 * own / held[g]
            if f1(p, r) > best[0] + 1e-12:
                best = (f1(p, r), label, p, r)
        if best[1] is None:
            bad += 1
            continue
        _, label, total, found = best
        own = by_pred[label]
        precise[label] = (precise[label] * guessed[label] + 2 * own.get(g, 0) + 1) / (guessed[label] + 1)
        own[g] = own.get(g, 0) + 1
        guessed[label] += 1
        del by_pred[pred[i]], precise[pred[i]], guessed[pred[i]]
        pred[i] = label
        merged += 1
    return pred, merged, bad


def merged_labels(rows: DataFrame) -> DataFrame:
    """doc, idx, pred, merged, bad: the predicted labels after merge_singletons, a task for each document."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        pred, merged, bad = merge_singletons(group["entity"].tolist(), group["pred"].tolist(), group["mtype"].tolist())
        return pd.DataFrame({"doc": group["doc"], "idx": group["idx"], "pred": pred, "merged": merged, "bad": bad})

    return rows.select("doc", "idx", "entity", "pred", "mtype").groupBy("doc").applyInPandas(run, "doc string, idx int, pred long, merged long, bad long")


def singleton_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, merged, bad, f1: the oracle analysis of singleton `error` mentions and the document's F1 after it."""
    from corpusloom.operators.evaluate import bcubed_rows

    rows = mentions(spark, sf_dir)
    after = merged_labels(rows)
    counts = after.groupBy("doc").agg(F.max("merged").alias("merged"), F.max("bad").alias("bad"))
    scored = bcubed_rows(rows.select("doc", "idx", "entity").join(after.select("doc", "idx", "pred"), ["doc", "idx"]))
    return counts.join(scored.select("doc", "f1"), "doc")


def perturbed(rows: DataFrame, rate: int = 100, fresh: int = 350) -> DataFrame:
    """doc, idx, entity: of 1000 labels `rate` are changed, of these `fresh` in 1000 to an id of their own (below 0) and the
    others to the new label of a drawn earlier mention. Draws are digests of document, place and turn; the chain of copies
    runs inside a document's array, in the JVM.
    """
    draw = lambda turn: F.conv(F.substring(F.md5(F.concat_ws(":", "doc", "idx", F.lit(turn))), 1, 8), 16, 10).cast("long")
    each = rows.select("doc", F.struct(F.col("idx"), F.col("entity").cast("long").alias("e"), (draw(1) % 1000 < rate).alias("change"), (draw(2) % 1000 < fresh).alias("fresh"), draw(3).alias("d")).alias("x"))
    mentions_ = each.groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def step(done: Column, x: Column) -> Column:
        own = F.when(x["fresh"] | (F.size(done) == 0), -(x["idx"].cast("long") + 1)).otherwise(F.get(done, (x["d"] % F.greatest(F.size(done), F.lit(1))).cast("int")))
        return F.concat(done, F.array(F.when(x["change"], own).otherwise(x["e"])))

    made = mentions_.select("doc", F.aggregate("x", F.array().cast("array<bigint>"), step).alias("labels"), F.col("x.idx").alias("at"))
    return made.select("doc", F.explode(F.arrays_zip("at", "labels")).alias("y")).select("doc", F.col("y.at").alias("idx"), F.col("y.labels").alias("entity"))


def perturbed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturbed(mentions(spark, sf_dir))


_P = f"WITH {MENTIONS_SQL}, pairs AS (SELECT a.*, b.idx AS prev, b.mtype AS prev_type, b.entity AS prev_entity, 10.0 - abs(a.v - b.v) AS score FROM mentions a JOIN mentions b ON a.doc = b.doc AND b.idx < a.idx)"
_C = f"WITH {MENTIONS_SQL}, g AS (SELECT doc, mtype || coalesce(' ' || lead(mtype) OVER c, '') AS gram, row_number() OVER c AS nth, count(*) OVER (PARTITION BY doc, entity) AS size FROM mentions WINDOW c AS (PARTITION BY doc, entity ORDER BY idx)), grams AS (SELECT doc, gram, count(*) AS count FROM g WHERE nth <= greatest(size - 1, 1) GROUP BY ALL)"
_G = f"WITH {MENTIONS_SQL}, ends AS (SELECT doc, max(sent) AS last FROM mentions GROUP BY 1), cells AS (SELECT doc, entity, unnest(range(0, last + 1)) AS sent FROM (SELECT DISTINCT doc, entity FROM mentions) JOIN ends USING (doc))"
QUERIES = {f.__name__: f for f in (mention_pairs, best_link, best_link_constrained, closest_antecedent, chain_ngrams, grid_ngrams_representative, grid_trigrams_representative,
    grid_ngrams_full, adjacency_counts, subject_ngrams, ngram_diff_full_outer, all_chains, top_chains, singleton_merge,
    perturbed_labels)}
_DRAW = "('0x' || substr(md5(concat_ws(':', doc, idx, {})), 1, 8))::BIGINT"
SQL = {
    "perturbed_labels": f"""WITH RECURSIVE {MENTIONS_SQL}, d AS (SELECT doc, idx, entity, {_DRAW.format(1)} % 1000 < 100 AS c, {_DRAW.format(2)} % 1000 < 350 AS f, {_DRAW.format(3)} AS d FROM mentions),
        run AS (SELECT doc, 0 AS k, []::BIGINT[] AS l FROM (SELECT DISTINCT doc FROM mentions)
            UNION ALL SELECT r.doc, k + 1, list_append(l, CASE WHEN NOT c THEN entity WHEN f OR k = 0 THEN -(k + 1) ELSE l[1 + (d.d % greatest(k, 1))] END) FROM run r JOIN d ON d.doc = r.doc AND d.idx = r.k),
        done AS (SELECT doc, l FROM run QUALIFY k = max(k) OVER (PARTITION BY doc)) SELECT doc, (generate_subscripts(l, 1) - 1)::INT AS idx, unnest(l) AS entity FROM done""",
    "mention_pairs": f"{_P} SELECT doc, prev, idx, entity = prev_entity AS same, round(score, 4) + 0.0 AS score FROM pairs",
    "best_link": f"""{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY score DESC, prev) AS k FROM pairs WHERE score > 0) SELECT doc, idx, prev AS link,
        round(score, 4) + 0.0 AS score FROM r WHERE k = 1""",
    "best_link_constrained": f"""{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY score DESC, prev) AS k FROM pairs WHERE score > 0 AND (mtype = 'error'
        OR prev_type <> 'error')) SELECT doc, idx, prev AS link FROM r WHERE k = 1""",
    "closest_antecedent": f"{_P.replace('WITH', 'WITH RECURSIVE', 1)}, near AS (SELECT doc, idx, max(prev) AS link FROM pairs WHERE score > 9.9 GROUP BY ALL), roots AS (SELECT m.doc, m.idx, n.link FROM mentions m LEFT JOIN near n USING (doc, idx)), chase AS (SELECT doc, idx, idx AS cluster FROM roots WHERE link IS NULL UNION ALL SELECT r.doc, r.idx, c.cluster FROM roots r JOIN chase c ON r.doc = c.doc AND r.link = c.idx) SELECT * FROM chase",
    "chain_ngrams": f"{_C} SELECT * FROM grams",
    "grid_ngrams_representative": f"""{_G}, t AS (SELECT c.doc, c.entity, c.sent, coalesce(list_extract(['purchase', 'signup', 'click', 'view', 'error'],
            (1 + min(m.rank))::INT), 'X') AS k FROM cells c LEFT JOIN mentions m USING (doc, entity, sent) GROUP BY ALL),
        g AS (SELECT doc, k || ' ' || lead(k) OVER (PARTITION BY doc, entity ORDER BY sent) AS gram FROM t) SELECT doc, gram, count(*) AS count FROM g WHERE gram IS NOT NULL AND gram <> 'X X' GROUP BY ALL""",
    "grid_ngrams_full": f"""{_G}, t AS (SELECT DISTINCT c.doc, c.entity, c.sent, coalesce(m.mtype, 'X') AS k FROM cells c LEFT JOIN mentions m USING (doc, entity, sent))
        SELECT a.doc, a.k || ' ' || b.k AS gram, count(*) AS count FROM t a JOIN t b ON a.doc = b.doc AND a.entity = b.entity AND b.sent = a.sent + 1 GROUP BY ALL""",
    "adjacency_counts": f"""WITH {MENTIONS_SQL}, t AS (SELECT doc, lag(mtype) OVER w AS first, mtype AS second, lag(entity) OVER w = entity AS same FROM mentions
        WINDOW w AS (PARTITION BY doc, sent ORDER BY idx)) SELECT doc, first, second, same, count(*) AS count FROM t WHERE first IS NOT NULL GROUP BY ALL""",
    "subject_ngrams": f"""WITH {MENTIONS_SQL}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, sent ORDER BY rank, idx) AS k FROM mentions) WHERE k = 1)
        SELECT a.doc, a.mtype || ' ' || b.mtype || CASE WHEN a.entity = b.entity THEN '+' ELSE '-' END AS gram, count(*) AS count FROM s a JOIN s b ON a.doc = b.doc AND b.sent = a.sent + 1 GROUP BY ALL""",
    "ngram_diff_full_outer": f"""{_C}, o AS (SELECT lpad((doc::BIGINT - 1)::VARCHAR, 8, '0') AS doc, gram, count AS c1 FROM grams WHERE doc::BIGINT > 0) SELECT coalesce(g.doc,
        o.doc) AS doc, coalesce(g.gram, o.gram) AS gram, coalesce(count, 0) - coalesce(c1, 0) AS diff FROM grams g FULL JOIN o ON g.doc = o.doc AND g.gram = o.gram""",
    "grid_trigrams_representative": f"""{_G}, t AS (SELECT c.doc, c.entity, c.sent, coalesce(list_extract(['purchase', 'signup', 'click', 'view', 'error'],
            (1 + min(m.rank))::INT), 'X') AS k FROM cells c LEFT JOIN mentions m USING (doc, entity, sent) GROUP BY ALL),
        g AS (SELECT doc, k || ' ' || lead(k) OVER w || ' ' || lead(k, 2) OVER w AS gram FROM t WINDOW w AS (PARTITION BY doc, entity ORDER BY sent)) SELECT doc, gram,
            count(*) AS count FROM g WHERE gram IS NOT NULL AND gram <> 'X X X' GROUP BY ALL""",
    "all_chains": f"WITH {MENTIONS_SQL} SELECT doc, entity, min(idx) AS first, count(*) AS size, string_agg(mtype, ' ' ORDER BY idx) AS chain FROM mentions GROUP BY ALL",
    "top_chains": f"""WITH {MENTIONS_SQL}, c AS (SELECT doc, entity, min(idx) AS first, count(*) AS size FROM mentions GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT *,
        row_number() OVER (PARTITION BY doc ORDER BY size DESC, first) AS place FROM c) SELECT doc, entity, size, place FROM r WHERE place <= 3""",
}
