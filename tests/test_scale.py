"""Plans that must not make an array twice, and shapes of data that must not grow faster than the input."""

import random
import re
from itertools import combinations
from math import log
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import analysis, bayes, grounding, intervals, learners, merging
from corpusloom.operators.coref import chain_grams, representative_grams
from corpusloom.plans import features, files
from corpusloom.plans.features import bag_dot
from corpusloom.sources.views import DOCUMENT


def conditions(df) -> list[str]:
    """The conditions of the optimised plan's filters and joins."""
    return re.findall(r"(?:Filter|Join) (.*)", df._jdf.queryExecution().optimizedPlan().toString())


def test_merges_are_made_once(spark):
    rows = spark.createDataFrame([("d", i, i % 4, i % 3) for i in range(12)], "doc string, idx int, pred long, rank int")
    weights = [(7 * i) % 11 for i in range(merging.N * (merging.N + 1))]
    start = merging.start_states(rows, weights)
    base = start.select("doc", "types", F.transform("clusters", lambda c: c["ids"]).alias("lists"))
    level = start.select("doc", F.size("clusters").alias("n"), F.array().cast("array<bigint>").alias("moved"), "total")
    made = merging.merges(level, base, weights, width=2)
    assert made.count() >= 2
    assert not [x for x in conditions(made) if "lambda" in x]


def test_spans_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "A b Cd\nE"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = intervals.spoken(spark, str(tmp_path))
    for made in (intervals.span_mentions(texts), intervals._spans(texts, "words", "word")):
        assert {r.doc_id for r in made.collect()} == {1}
        assert not [x for x in conditions(made) if "regexp_extract_all" in x]


def test_frequent_features_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(bayes, "HEAD", 3)
    bag = "doc_id long, bag array<struct<form string, times bigint>>"
    texts = spark.createDataFrame([(1, [("a", 5), ("b", 1)]), (2, [("a", 2), ("c", 1)]), (3, []), (4, None), (1, [("b", 1)])], bag)
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, label string")
    priors, counts = bayes.fit_texts(labels, texts)
    assert {tuple(r) for r in counts.select("label", "feature", "n").collect()} == {("x", "a", 5), ("x", "b", 2), ("y", "a", 2), ("y", "c", 1)}
    made = bayes.scores(texts, priors, counts)
    found = {(r.doc_id, r.label): round(r.score, 6) for r in made.collect()}
    assert found == {(1, "x"): round(5 * log(5) + 2 * log(2), 6), (1, "y"): round(5 * log(2) - 30, 6), (2, "x"): round(2 * log(5) - 15, 6), (2, "y"): round(2 * log(2), 6)}
    assert "BroadcastHashJoin [feature" in made._jdf.queryExecution().executedPlan().toString()


def test_bags_multiply_by_key(spark):
    schema = "id long, bag array<struct<form string, times bigint>>"
    a = spark.createDataFrame([(1, [("a", 2), ("b", 3)]), (2, [("c", 1)]), (3, [("a", 1)]), (3, [("a", 1)])], schema)
    b = spark.createDataFrame([(1, [("a", 5), ("b", 1), ("d", 9)]), (3, [("a", 4)]), (3, [("b", 1), ("a", 1)]), (7, [("a", 1)])], schema)
    made = bag_dot(a, b)
    assert {tuple(r) for r in made.collect()} == {(1, 13.0), (2, 0.0), (3, 10.0)}
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_annotation_files_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "DOCUMENTS", 3, raising=False)
    made = []
    monkeypatch.setattr(files, "shared_path", lambda spark, name: made.append(f"{tmp_path}/{name}") or made[-1])
    rows = spark.range(20 * DOCUMENT).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert files.annotation_files(spark, str(tmp_path)).count() == 20 * DOCUMENT
    held = [p.read_text().count("<document") for p in Path(made[0]).glob("part-*")]
    assert sum(held) == 40 and max(held) <= 6


def test_fixed_pairs_have_no_lambdas(spark, tmp_path):
    lines = [(1, 1, "A", "F", 3.0, 0.5, 0.25), (1, 2, "X", "O", 2.0, 0.0, 0.0), (2, 1, None, "F", 1.0, None, 0.125)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = features.mixed_conjunctions(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "transform(" not in plan
    c = F.col
    listed = features.union(features.conjunction(c("flag"), c("state")), features.conjunction(c("flag"), c("amount")), features.conjunction(c("amount"), c("tax")),
        features.conjunction(c("both"), c("amount")), features.conjunction(c("both"), c("both"), same=True))
    whole = features._long(features._lines(spark, str(tmp_path)), listed)
    assert made.count() == 21 and sorted(map(repr, made.collect())) == sorted(map(repr, whole.collect()))


def test_bracket_files_meet_no_join(spark, tmp_path):
    turns = [(7, 1, "one (two) 3 four"), (7, 2, ""), (8, 1, None), (9, 4, "5")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = files.bracket_files(spark, str(tmp_path))
    assert {tuple(r) for r in made.collect()} == {(7, 1, 0, "NN", "one"), (7, 1, 1, "CD", "3"), (7, 1, 2, "NN", "four"), (9, 4, 0, "CD", "5")}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_folds_are_trained_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, ["a", f"b{i % 3}", None, "a"] if i % 4 else [], i % 2, i % 3) for i in range(24)], "idx long, features array<string>, y int, own int")
    for rule, given in (("perceptron", {"rate": 0.1}), ("averaged", {"rate": 0.1}), ("winnow", {}), ("mira", {})):
        found = {r.fold: (r.hits, r.tested) for r in learners.cross_validate(rows, 3, rule, 2, **given).collect()}
        for fold in range(3):
            unit, own = learners.UNITS[rule](**given), [(dict.fromkeys(r.features, 1.0), r.y, r.own == fold) for r in rows.orderBy("idx").collect()]
            for x, y, _ in [z for _ in range(2) for z in own if not z[2]]:
                unit.learn(x, y)
            assert found[fold] == (sum((unit.score(x) >= 0) == bool(y) for x, y, test in own if test), 8)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    folds = spark.createDataFrame([(0, 3, 4), (1, 1, 4)], "fold long, hits long, tested long").mapInArrow(counted, "fold long, hits long, tested long")
    assert {(r.fold, r.accuracy) for r in learners.summary(folds).collect()} == {(0, 0.75), (1, 0.25)}
    assert runs.value == 2


def test_id_units_equal_units_to_the_last_digit():
    examples = [[f"w{(i * j) % 17}" for j in range(1, 6)] for i in range(60)]
    for rule in ("perceptron", "averaged", "winnow", "mira", "sgd"):
        plain, ids = learners.UNITS[rule](), {}
        dense = learners.IdUnit.like(learners.UNITS[rule]())
        for i, x in enumerate(examples):
            x = list(dict.fromkeys(x))
            made = learners.id_arrays(pa.array([x, None]), ids)
            dense.widen(len(ids))
            assert len(made[1]) == 0 and dense.score(made[0]) == plain.score(dict.fromkeys(x, 1.0))
            dense.learn(made[0], i % 3 == 0)
            plain.learn(dict.fromkeys(x, 1.0), i % 3 == 0)


def test_grams_are_made_where_an_entity_is(spark):
    rows = spark.createDataFrame([("d", 0, 1, 2), ("d", 0, 1, 0), ("d", 1, 1, 4), ("d", 5, 2, 1), ("e", 0, 1, 3), ("f", 2, 7, -1), ("f", 3, 7, None)], "doc string, sent int, entity long, rank int")
    made = representative_grams(rows, 2)
    assert {tuple(r) for r in made.collect()} == {("d", "purchase error", 1), ("d", "error X", 1), ("d", "X signup", 1)}
    assert {tuple(r) for r in representative_grams(rows, 3).collect()} == {("d", "purchase error X", 1), ("d", "error X X", 1), ("d", "X X signup", 1)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "sequence(" not in plan


def shuffles(df) -> tuple[int, int]:
    """Exchanges and joins of the plan as it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"(?<!Reused)Exchange ", plan)), len(re.findall(r"Join", plan))


def test_single_merges_equal_loops_after_one_shuffle(spark):
    rng, n = random.Random(11), merging.N
    weights = [rng.randrange(-9, 10) for _ in range(n * (n + 1))]
    docs = {d: [(rng.randrange(5), rng.randrange(k), rng.randrange(n)) for _ in range(size)] for d, size, k in (("a", 14, 5), ("b", 9, 3), ("c", 2, 9), ("d", 1, 1), ("e", 6, 1))}
    docs["b"] += [(x, None, 2) for x in range(5)]
    rows = [(d, 10 * i, *x) for d, own in docs.items() for i, x in enumerate(own)] + [(None, 0, 1, 1, 1), (None, 1, 1, 2, 1)]
    made = merging.single_merges(spark.createDataFrame(rows, "doc string, idx int, entity long, pred long, rank long"), weights).groupBy("doc").agg(F.collect_list(F.struct("change", "gain")).alias("x"))

    def worth(own, ids):
        t = [own[i][2] for i in sorted(ids)]
        return weights[n * n + t[0]] if len(t) == 1 else sum(weights[a * n + b] for a, b in zip(t, t[1:], strict=False))

    def sums(own, clusters):
        return sum(len([j for j in c if own[j][0] == own[i][0]]) * (1 / len(c) + 1 / len([x for x in own if x[0] == own[i][0]])) for c in clusters for i in c)

    expected = {}
    for d, own in docs.items():
        clusters = [[i for i, x in enumerate(own) if x[1] == p] for p in sorted({x[1] for x in own} - {None})]
        for a, b in combinations(clusters, 2):
            rest = [c for c in clusters if c not in (a, b)]
            expected.setdefault(d, []).append(((worth(own, a + b) - worth(own, a) - worth(own, b)) / 1e6, round(sums(own, [*rest, a + b]) - sums(own, clusters), 6) + 0.0))
    found = {r.doc: sorted((x.change, x.gain) for x in r.x) for r in made.collect()}
    assert found == {d: sorted(x) for d, x in expected.items()}
    assert shuffles(made) == (1, 0)


def test_bigram_differences_equal_plain_grams_after_one_shuffle(spark):
    rng = random.Random(12)
    kinds = ["purchase", "signup", "click", "view", "error", None, "other"]
    own = [(d, i // 3, i, rng.choice([1, 2, 3, 4, None]), rng.choice(kinds)) for d, n in (("a", 30), ("b", 11), ("c", 4), ("d", 1)) for i in range(n) if i % 7 != 5]
    rows = spark.createDataFrame([*own, (None, 0, 0, 1, "view"), (None, 1, 3, 1, "click")], "doc string, sent int, idx int, entity long, mtype string").withColumn("rank", F.when(F.col("mtype") == "other", -1).otherwise(F.array_position(F.array(*[F.lit(x) for x in merging.TYPES]), F.col("mtype")) - 1))
    sides = rows.withColumn("side", F.lit(1)).unionByName(analysis.shuffled_copies(rows).drop("copy").withColumn("side", F.lit(-1)))
    expected = {}
    for kind, made in (("grid2", representative_grams(sides, 2, ("doc", "side"))), ("chain2", chain_grams(sides, 2, ("doc", "side")))):
        for r in made.collect():
            key = (r.doc, kind, r.gram)
            expected[key] = expected.get(key, 0) + r.side * r["count"]
    made = analysis.bigram_differences(rows)
    assert {tuple(r) for r in made.collect()} == {(*k, v) for k, v in expected.items() if v}
    assert shuffles(made) == (1, 0)


def test_lists_are_read_as_values():
    names = pa.array([["a", "b", "a"], None, [], ["c", None]], pa.list_(pa.string()))
    for column in (names, names[1:], names[:0], pa.array([[1.0, -2.5], [], None], pa.list_(pa.float64())), pa.nulls(2, pa.list_(pa.float64()))):
        assert learners.listed(column) == column.to_pylist()


def test_merge_coherence_deals_documents_once(spark):
    made = merging.merge_coherence(spark, "/root/testdata/sf0.001")
    assert shuffles(made) == (1, 0) and "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_heads_are_solved_where_they_are(spark):
    """Rules read off rows give the parts, the worth and the solved parts of their clause table, whatever the batches; of repeated rows one counts."""
    rng = random.Random(3)
    rows = [(f"h{h}", f"l{i:02d}", rng.randrange(4), rng.randrange(3), rng.choice("abc"), None if rng.random() < 0.1 else round(rng.uniform(-3, 3), 3)) for h in range(12) for i in range(9 if h else 1)]
    rules = (
        grounding.Rule("most", ("g",), most=1), grounding.Rule("two", ("k",), "kind <> 'a'", most=2), grounding.Rule("some", ("k", "kind"), "g < 2", least=1),
        grounding.Rule("no", where="kind = 'c' AND g = 0", holds=False), grounding.Rule("yes", where="kind = 'b' AND k = 0 AND g = 3"),
    )
    schema = "head string, literal string, g int, k int, kind string, worth double"
    whole = spark.createDataFrame(rows, schema)
    clauses = grounding.ground(*[r.clauses(whole) for r in rules])
    expected = {(r.head, r.literal): r for r in grounding.solve_parts(whole.select("head", "literal", "worth"), clauses).collect()}
    named = {(r.head, r.literal): r.part for r in grounding.parts(clauses).collect()}
    again = [*rows, *[(*r[:5], None if r[5] is None else r[5] - i) for i, r in enumerate(rows) if i % 5 < 2]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        dealt = spark.createDataFrame(again, schema).repartition(3, "head").sortWithinPartitions("head", "literal", "g")
        found = grounding.solve_heads(dealt, rules).collect()
        parted = grounding.part_heads(dealt, rules).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(parted) == len(again)
    assert {(r.head, r.literal): r.part for r in parted if r.part is not None} == named
    assert {(r.head, r.literal): (r.part, r.optimal) for r in found} == {k: (r.part, r.optimal) for k, r in expected.items()}
    assert {r.optimal for r in found} == {True, False} and {r.value for r in found if not r.optimal} == {None}
    worth = {(r[0], r[1]): r[5] or 0.0 for r in rows}
    totals = [{}, {}]
    for r in expected.values():
        totals[0][r.head, r.part] = totals[0].get((r.head, r.part), 0.0) + (worth[r.head, r.literal] if r.value else 0.0)
    for r in found:
        totals[1][r.head, r.part] = totals[1].get((r.head, r.part), 0.0) + ((r.worth or 0.0) if r.value else 0.0)
    assert {k: round(v, 6) for k, v in totals[0].items()} == {k: round(v, 6) for k, v in totals[1].items()}


def test_grounded_queries_deal_mentions_not_clauses(spark, monkeypatch):
    monkeypatch.setattr(grounding, "kept", None)
    for query in (grounding.grounded_inference, grounding.ground_parts):
        made = query(spark, "/root/testdata/sf0.001")
        exchanges, joins = shuffles(made)
        assert exchanges <= 3 and joins == 0
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "clause" not in plan


def test_spans_meet_in_their_row(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice(["Ab", "c", "D\u00e9f ", " ", " ", "\n", "\n ", "Ghijklm"]) for _ in range(rng.randrange(60)))) for i in range(40)] + [(90, None), (91, ""), (92, " \n \n"), (93, "A"), (94, "\n\nAb  C\n"), (None, "A b")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    cut = intervals.spoken(spark, str(tmp_path)).where("doc_id IS NOT NULL")
    expected = intervals.align_spans(intervals.span_mentions(cut), intervals._spans(cut, "words", "word"), intervals._spans(cut, "lines", "sentence"), ["doc_id"])
    expected = sorted(tuple(r) for r in expected.select("doc_id", "head_start", "start", "end", "word", "sentence", "first", "last").collect())
    monkeypatch.setattr(intervals, "ROWS", 3, raising=False)
    monkeypatch.setattr(intervals, "kept", None)
    made = intervals.mention_alignment(spark, str(tmp_path))
    assert sorted(tuple(r) for r in made.collect()) == expected and len(expected) > 100
    assert shuffles(made) == (0, 0)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2


def test_places_in_no_span_are_null(spark):
    span = "array<struct<start int, end int>>"
    rows = [("d", [(5, 5, 6), (0, 0, 3), (9, 2, 30), (4, 7, 4)], [(1, 2), (5, 8), (12, 13)], [(0, 3), (6, 20)]), ("e", [(1, 1, 1)], [], []), ("f", [], [(0, 1)], [(0, 1)])]
    texts = spark.createDataFrame(rows, f"doc_id string, mentions array<struct<head_start int, start int, end int>>, words {span}, lines {span}")
    found = {tuple(r) for r in intervals.align_in_rows(texts.coalesce(1)).collect()}
    assert found == {("d", 5, 5, 6, 1, None, 1, 1), ("d", 0, 0, 3, None, 0, 0, 0), ("d", 9, 2, 30, None, 0, 0, 2), ("d", 4, 7, 4, None, 1, None, None), ("e", 1, 1, 1, None, None, None, None)}
