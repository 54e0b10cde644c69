"""Search over merges of clusters as an iterated relation.

A state is a row: a document, which of its start clusters have moved into which, and its coherence; the clusters themselves, sorted
lists of mentions, are in one row for each document. A level joins every state with
the pairs of its clusters that the filter keeps, drops states that several merges lead to, and keeps the best `width` of each document; a
merge lowers the number of clusters, so states of two levels are never equal. Coherence is what a trained learner says of the
chains: the sum of its weights over the type bigrams of all clusters, as whole millionths, so that sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.lexing import let
from corpusloom.operators.evaluate import fitted, fitted_sql
from corpusloom.operators.training import SQL as TRAINING_SQL
from corpusloom.operators.training import coherence_learner
from corpusloom.sources.shared import kept
from corpusloom.sources.views import MENTIONS_SQL, TYPES, mentions, unfolded

#: Weights of bigrams come first, that of types a and b at a * N + b, then those of types alone.
N = len(TYPES)


def chain_weights(weights: DataFrame) -> list[int]:
    """The learner's weights (feature, weight) of chain bigrams in millionths, by place; at most N * (N + 1) rows come to the driver."""
    found = {r.feature.removeprefix("chain2:"): round(1_000_000 * r.weight) for r in weights.where(F.col("feature").startswith("chain2:")).collect()}
    return [found.get(f"{a} {b}", 0) for a in TYPES for b in TYPES] + [found.get(a, 0) for a in TYPES]


def start_states(rows: DataFrame, weights: list[int]) -> DataFrame:
    """doc, types (rank by place in the document's order), clusters (array of struct ids, worth), total: the predicted clusters of rows (doc, idx, pred, rank)."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("idx")) - 1
    each = rows.select("doc", "pred", F.col("rank").cast("int").alias("rank"), place.alias("at"))
    docs = each.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rank"))), lambda x: x["rank"]).alias("types"))
    clusters = each.groupBy("doc", "pred").agg(F.array_sort(F.collect_list("at")).alias("ids")).groupBy("doc").agg(F.array_sort(F.collect_list("ids")).alias("lists"))
    made = docs.join(clusters, "doc").withColumn("clusters", F.transform("lists", lambda ids: F.struct(ids.alias("ids"), worth(F.col("types"), ids, weights).alias("worth"))))
    return made.select("doc", "types", "clusters", _total(F.col("clusters")).alias("total"))


def worth(types: Column, ids: Column, weights: list[int]) -> Column:
    """What the chain of the mentions `ids` adds: its type bigrams, or the type of a single mention."""
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    grams = F.transform(F.slice(ids, F.lit(2), F.size(ids)), lambda j, k: F.get(table, F.get(types, F.get(ids, k)) * N + F.get(types, j)))
    return F.when(F.size(ids) == 1, F.get(table, F.lit(N * N) + F.get(types, F.get(ids, F.lit(0))))).otherwise(F.aggregate(grams, F.lit(0).cast("long"), lambda a, x: a + x))


def _total(clusters: Column) -> Column:
    return F.aggregate(clusters, F.lit(0).cast("long"), lambda a, c: a + c["worth"])


def _clusters(weights: list[int]) -> Column:
    """Of a state beside its document's row: its clusters as structs rep, ids, worth, by rising rep, the place of their first start cluster."""
    lists, moved = F.col("lists"), F.col("moved")
    joined = lambda k, ids: F.flatten(F.concat(F.array(ids), F.transform(F.filter(moved, lambda m: _rep(m) == k), lambda m: F.get(lists, _member(m)))))
    own = F.transform(lists, lambda ids, k: F.struct(k.alias("rep"), F.when(F.exists(moved, lambda m: _rep(m) == k), F.sort_array(joined(k, ids))).otherwise(ids).alias("ids")))
    left = F.filter(own, lambda c: ~F.exists(moved, lambda m: _member(m) == c["rep"]))
    return F.transform(left, lambda c: F.struct(c["rep"].alias("rep"), c["ids"].alias("ids"), worth(F.col("types"), c["ids"], weights).alias("worth")))


#: A start cluster that went into another is one long in `moved`: the place of the cluster it is in now, and its own.
_SHIFT = 31


def _rep(m: Column) -> Column:
    return F.shiftright(m, _SHIFT).cast("int")


def _member(m: Column) -> Column:
    return m.bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int")


def _move(rep: Column, member: Column) -> Column:
    return F.shiftleft(rep.cast("long"), _SHIFT) + member


def merges(level: DataFrame, base: DataFrame, weights: list[int], width: int | None = None, keep: Callable[..., Column] | None = None) -> DataFrame:
    """doc, n, moved, total, place of the states one merge away; what several merges lead to comes several times.

    keep: a condition on the merged cluster's size, on what the merge adds to the coherence, and on the clusters of the state before.
    With a width, of each state only merges as good as its width-th best: the others can't be among the best of the document.
    `place` orders states of a document as the sorted lists of all their clusters do.
    """
    parts = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = level.repartition(parts, "doc").join(base.repartition(parts, "doc").hint("merge"), "doc").withColumn("clusters", _clusters(weights))
    change = lambda p: let(F.sort_array(F.concat(p["a"]["ids"], p["b"]["ids"])), lambda ids: worth(F.col("types"), ids, weights)) - p["a"]["worth"] - p["b"]["worth"]
    pairs = F.flatten(F.transform("clusters", lambda b, j: F.transform(F.slice("clusters", F.lit(1), j), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    if keep is not None:
        pairs = F.filter(pairs, lambda p: keep(F.size(p["a"]["ids"]) + F.size(p["b"]["ids"]), change(p), F.col("clusters")))
    rows = rows.withColumn("pairs", F.transform(pairs, lambda p: F.struct(p["a"]["rep"].alias("a"), p["b"]["rep"].alias("b"), change(p).alias("change"))))
    if width is not None:
        rows = rows.withColumn("_least", F.get(F.sort_array(F.transform("pairs", lambda p: p["change"]), asc=False), F.lit(width - 1)))
        rows = rows.withColumn("pairs", F.filter("pairs", lambda p: F.col("_least").isNull() | (p["change"] >= F.col("_least"))))
    rows = unfolded(rows.select("doc", "n", "lists", "moved", "total", F.col("pairs").alias("p")), "p")
    moved = F.sort_array(F.concat(F.transform("moved", lambda m: F.when(_rep(m) == F.col("p.b"), _move(F.col("p.a"), _member(m))).otherwise(m)), F.array(_move(F.col("p.a"), F.col("p.b")))))
    made = rows.select("doc", "n", "lists", moved.alias("moved"), (F.col("total") + F.col("p.change")).alias("total"))
    return made.select("doc", "n", "moved", "total", *([] if width is None else [_place().alias("place")]))


def _place() -> Column:
    """A key that orders the states of a document as the sorted lists of all their clusters would, of the joined clusters alone.

    Two states first differ at one start cluster's place: there one is joined to others and the other isn't, or not to the
    same. A cluster that joining made smaller than its start stands below the state that left it alone, another above, the
    earlier place counting first; the closing 0 stands for what is left alone to the end.
    """
    lists, moved = F.col("lists"), F.col("moved")
    own = lambda k: F.sort_array(F.flatten(F.concat(F.array(F.get(lists, k)), F.transform(F.filter(moved, lambda m: _rep(m) == k), lambda m: F.get(lists, _member(m))))))
    code = lambda k, ids: F.when(ids < F.get(lists, k), k - F.size(lists)).otherwise(F.size(lists) - k)
    each = F.transform(F.array_distinct(F.transform(moved, _rep)), lambda k: let(own(k), lambda ids: F.struct(code(k, ids).alias("code"), ids.alias("ids"))))
    return F.concat(each, F.array(F.struct(F.lit(0).alias("code"), F.array().cast("array<int>").alias("ids"))))


def search(states: DataFrame, weights: list[int], depth: int, width: int | None = None, keep: Callable[..., Column] | None = None) -> DataFrame:
    """doc, depth, clusters, total of the best state of each level that a document reaches: a beam of `width` states, or all of them.

    Ties go to the smaller clusters in the order of their lists. What is kept of a state is its merges, beside one row for each document with its
    start clusters; a document's states of a level are made, told apart and compared where they are. Each level but the last is kept in the shared folder.
    """
    start = kept(states.select("doc", "types", F.transform("clusters", lambda c: c["ids"]).alias("lists"), "total"), "states")
    base = start.select("doc", "types", "lists")
    level = start.select("doc", F.size("lists").alias("n"), F.array().cast("array<bigint>").alias("moved"), "total")
    out = _best(level, 0)
    for d in range(1, depth + 1):
        level = merges(level, base, weights, width, keep)
        if width is not None:
            level = level.dropDuplicates(["doc", "moved"]).withColumn("_at", F.row_number().over(Window.partitionBy("doc").orderBy(F.col("total").desc(), "place"))).where(F.col("_at") <= width).drop("_at", "place")
        elif d < depth:
            level = level.dropDuplicates(["doc", "moved"])
        if d < depth:
            level = kept(level, "states")
        out = out.unionByName(_best(level, d))
    return out


def _best(level: DataFrame, depth: int) -> DataFrame:
    """doc, depth, clusters, total of the most coherent state of each document; a merge leaves one cluster fewer."""
    top = level.groupBy("doc", "n").agg(F.max("total").alias("total"))
    return top.select("doc", F.lit(depth).alias("depth"), (F.col("n") - depth).alias("clusters"), "total")


def single_mentions(size: Column, change: Column, clusters: Column) -> Column:
    """Merges of two single mentions."""
    return size <= 2


def _searched(spark: SparkSession, sf_dir: str, **given) -> DataFrame:
    weights = chain_weights(coherence_learner(spark, sf_dir))
    return search(start_states(mentions(spark, sf_dir), weights), weights, **given).withColumn("score", F.round(F.col("total") / 1_000_000, 6)).drop("total")


def cluster_merge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, depth, clusters, score: the most coherent clustering after each of up to three merges, a beam of four."""
    return _searched(spark, sf_dir, depth=3, width=4)


def cluster_merge_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among all clusterings that up to two merges of two single mentions lead to."""
    return _searched(spark, sf_dir, depth=2, keep=single_mentions)


def single_merges(rows: DataFrame, weights: list[int]) -> DataFrame:
    """doc, change, gain: what merging each pair of predicted clusters of rows (doc, idx, entity, pred, rank) adds to the coherence, and as `candidates` to B-cubed.

    From pairs of mentions of two clusters: if no mention of either stands between two, they are neighbours in the merged chain, where their link takes the
    place of the later one's own; if they are of one entity, they agree. Any two clusters have neighbours. Documents are dealt once, and no cluster's list is sorted or joined.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = lambda *keys: Window.partitionBy("doc", *keys)
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    link = lambda a, b: F.coalesce(F.get(table, (a * N + b).cast("int")), F.lit(0))
    each = rows.where("doc IS NOT NULL").select("doc", "idx", "entity", "pred", F.when(F.col("rank") >= 0, F.col("rank").cast("int")).alias("rank")).repartition(parts, "doc")
    each = each.withColumn("at", F.row_number().over(within().orderBy("idx")))
    each = each.withColumn("o", F.count(F.lit(1)).over(within("entity", "pred"))).withColumn("g", F.count(F.lit(1)).over(within("entity")))
    own, whole = within("pred").orderBy("at"), within("pred")
    each = each.select("doc", "at", "entity", "g", "pred", "rank", F.lag("at", 1, 0).over(own).alias("before"), F.lead("at").over(own).alias("after"), F.lag("rank").over(own).alias("last"),
        F.count(F.lit(1)).over(whole).alias("n"), F.sum("o").over(whole).alias("q"))
    lone = F.when(F.col("n") == 1, F.get(table, N * N + F.col("rank"))).otherwise(F.lit(0))
    mention = F.struct("at", "before", "after", "entity", "g", "rank", link(F.col("last"), F.col("rank")).alias("link"), F.struct("pred", "n", "q", lone.alias("lone")).alias("c"))
    docs = each.where("pred IS NOT NULL").groupBy("doc").agg(F.collect_list(mention).alias("m"))
    both = docs.select("doc", "m", F.explode("m").alias("v")).select("doc", "v", F.explode("m").alias("u"))
    near = (F.col("u.at") > F.col("v.before")) & (F.col("u.after").isNull() | (F.col("u.after") > F.col("v.at")))
    agree = F.col("u.entity").eqNullSafe(F.col("v.entity")) & F.col("u.entity").isNotNull()
    met = both.where((F.col("u.at") < F.col("v.at")) & (F.col("u.c.pred") != F.col("v.c.pred")) & (near | agree))
    met = met.select("doc", F.least("u.c", "v.c").alias("a"), F.greatest("u.c", "v.c").alias("b"), F.when(near, link(F.col("u.rank"), F.col("v.rank")) - F.col("v.link")).otherwise(F.lit(0)).alias("links"),
        F.when(agree, 2).otherwise(0).alias("cross"), F.when(agree, 2 / F.col("v.g")).otherwise(0.0).alias("dr"))
    sums = met.groupBy("doc", "a", "b").agg(F.sum("links").alias("links"), F.sum("cross").alias("cross"), F.sum("dr").alias("dr"))
    of = lambda name: (F.col(f"a.{name}"), F.col(f"b.{name}"))
    (na, nb), (qa, qb), (la, lb) = of("n"), of("q"), of("lone")
    gain = (qa + qb + F.col("cross")) / (na + nb) - qa / na - qb / nb + F.col("dr")
    return sums.select("doc", ((F.col("links") - la - lb) / 1_000_000).alias("change"), (F.round(gain, 6) + F.lit(0.0)).alias("gain"))


def merge_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, merges, r, slope, intercept: of the gain in B-cubed on the change in coherence, over the single merges of a document."""
    made = single_merges(mentions(spark, sf_dir), chain_weights(coherence_learner(spark, sf_dir)))
    return made.groupBy("doc").agg(F.count(F.lit(1)).alias("merges"), *fitted("gain", "change", 4))


def _worth_sql(ids: str) -> str:
    return f"(CASE WHEN len({ids}) = 1 THEN w[{N * N} + t[{ids}[1] + 1] + 1] ELSE list_sum(list_transform(range(1, len({ids})), lambda k: w[t[{ids}[k] + 1] * {N} + t[{ids}[k + 1] + 1] + 1])) END)"


_NAMES = "[" + ", ".join(f"'{a} {b}'" for a in TYPES for b in TYPES) + ", " + ", ".join(f"'{a}'" for a in TYPES) + "]"
_START = f"""WITH {MENTIONS_SQL}, learned AS (SELECT feature[8:] AS f, round(1000000 * weight)::BIGINT AS v FROM ({TRAINING_SQL["coherence_learner"]}) WHERE starts_with(feature, 'chain2:')),
    table_ AS (SELECT list(coalesce(v, 0)::BIGINT ORDER BY i) AS w FROM (SELECT unnest({_NAMES}) AS f, generate_subscripts({_NAMES}, 1) AS i) LEFT JOIN learned USING (f)),
    placed AS (SELECT doc, pred, rank, (row_number() OVER (PARTITION BY doc ORDER BY idx) - 1)::INT AS spot FROM mentions),
    docs AS (SELECT doc, list(rank::INT ORDER BY spot) AS t FROM placed GROUP BY 1), lists AS (SELECT doc, pred, list(spot ORDER BY spot) AS ids FROM placed GROUP BY 1, 2)"""


def _search_sql(depth: int, width: int | None, most: int | None) -> str:
    total = f"list_sum(list_transform(c, lambda x: {_worth_sql('x')}))::BIGINT"
    levels = [f", l0 AS (SELECT doc, t, w, c, {total} AS total FROM (SELECT doc, t, w, list_sort(list(ids)) AS c FROM docs JOIN lists USING (doc), table_ GROUP BY doc, t, w))"]
    for d in range(1, depth + 1):
        merged = "list_sort(list_append(list_filter(c, lambda x, k: k <> i AND k <> j), list_sort(list_concat(c[i], c[j]))))"
        few = "" if most is None else f"AND len(c[i]) + len(c[j]) <= {most}"
        best = "" if width is None else f" QUALIFY row_number() OVER (PARTITION BY doc ORDER BY total DESC, c) <= {width}"
        levels.append(f""", l{d} AS (SELECT doc, t, w, c, total FROM (SELECT doc, t, w, c, {total} AS total FROM (SELECT DISTINCT doc, t, w, {merged} AS c
            FROM (SELECT *, unnest(range(i + 1, len(c) + 1)) AS j FROM (SELECT *, unnest(range(1, len(c))) AS i FROM l{d - 1})) WHERE true {few})){best})""")
    every = " UNION ALL ".join(f"SELECT doc, {d} AS depth, len(c)::INT AS clusters, total FROM l{d}" for d in range(depth + 1))
    return f"""{_START}{"".join(levels)} SELECT doc, depth, clusters, round(total / 1000000, 6) AS score FROM ({every}) QUALIFY row_number() OVER (PARTITION BY doc, depth ORDER BY total DESC) = 1"""


def _coherence_sql() -> str:
    from corpusloom.operators.analysis import _CANDIDATES

    made = f"""SELECT cand.doc, gain, ({_worth_sql("j")} - {_worth_sql("x")} - {_worth_sql("y")}) / 1000000 AS change
        FROM (SELECT cand.*, p.ids AS x, q.ids AS y, list_sort(list_concat(p.ids, q.ids)) AS j FROM cand JOIN lists p ON p.doc = cand.doc AND p.pred = a JOIN lists q ON q.doc = cand.doc AND q.pred = b) cand JOIN docs USING (doc), table_"""
    return f"""{_START}, cells AS{_CANDIDATES.split(", cells AS", 1)[1]} SELECT doc, count(*) AS merges, {fitted_sql("gain", "change", 4)} FROM ({made}) GROUP BY 1"""


QUERIES = {f.__name__: f for f in (cluster_merge_search, cluster_merge_exhaustive, merge_coherence)}
SQL = {"cluster_merge_search": _search_sql(3, 4, None), "cluster_merge_exhaustive": _search_sql(2, None, 2), "merge_coherence": _coherence_sql()}
