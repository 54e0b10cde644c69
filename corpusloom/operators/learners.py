"""Online linear learners, trained in example order inside one group, and in parallel over labels, folds and selectors.

A group is one (model, label) sequence: its result depends on the order of all its examples, so it is one task by
nature; what is parallel is the number of groups. Averaging over parts would be another algorithm. A task reads its
examples as a sorted stream and holds the unit's weights and one Arrow batch, never the group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.readers import pre_extract
from corpusloom.sources.shared import kept, numbered
from corpusloom.sources.views import split_words, table


@dataclass
class LinearUnit:
    """One threshold unit; `rule` is perceptron, averaged, winnow, mira or sgd (real targets)."""

    rule: str = "perceptron"
    rate: float = 0.1
    threshold: float = 0.0
    positive: float = 0.0  # thickness above and below the threshold
    negative: float = 0.0
    alpha: float = 2.0
    beta: float = 0.5
    start: float = 0.0
    bias: float = 0.0
    n: int = 0
    w: dict = field(default_factory=dict)
    late: dict = field(default_factory=dict)  # sums of updates by the number of examples before them
    late_bias: float = 0.0

    @classmethod
    def winnow(cls, alpha: float = 2.0, beta: float | None = None, threshold: float = 16.0, start: float = 1.0) -> LinearUnit:
        return cls("winnow", threshold=threshold, alpha=alpha, beta=1 / alpha if beta is None else beta, start=start, bias=start)

    def raw(self, x: dict) -> float:
        return sum(self.w.get(f, self.start) * s for f, s in x.items()) + self.bias

    def score(self, x: dict) -> float:
        """The score used for predictions: averaged weights for the averaged perceptron, less the threshold."""
        if self.rule != "averaged" or not self.n:
            return self.raw(x) - self.threshold
        total = sum((self.n * self.w.get(f, 0.0) - self.late.get(f, 0.0)) * s for f, s in x.items())
        return (total + self.n * self.bias - self.late_bias) / self.n - self.threshold

    def _square(self, x: dict) -> float:
        return sum(v * v for v in x.values())

    def _scale(self, x: dict, base: float) -> None:
        for f, v in x.items():
            self.w[f] = self.w.get(f, self.start) * base**v

    def _add(self, x: dict, step: float) -> None:
        for f, s in x.items():
            self.w[f] = self.w.get(f, self.start) + step * s
            if self.rule == "averaged":
                self.late[f] = self.late.get(f, 0.0) + self.n * step * s
        self.bias += step
        self.late_bias += self.n * step

    def learn(self, x: dict, y: float) -> None:
        """One example; y is a truth value, for sgd a real target."""
        s = self.raw(x)
        if self.rule == "sgd":
            self._add(x, self.rate * (y - s))
        elif self.rule == "mira":
            sign = 1 if y else -1
            tau = min(1.0, max(0.0, (self.beta / 2 - sign * (s - self.threshold)) / (self._square(x) + 1))) * self.rate
            if tau > 1e-9:
                self._add(x, sign * tau)
        else:
            up = bool(y) and s < self.threshold + self.positive
            down = not y and s >= self.threshold - self.negative
            if (up or down) and self.rule == "winnow":
                base = self.alpha if up else self.beta
                self._scale(x, base)
                self.bias *= base
            elif up or down:
                self._add(x, self.rate if up else -self.rate)
        self.n += 1

    def averages(self) -> tuple[dict, float]:
        """The weights and the bias that predictions use."""
        if self.rule != "averaged" or not self.n:
            return self.w, self.bias
        return {f: (self.n * w - self.late.get(f, 0.0)) / self.n for f, w in self.w.items()}, (self.n * self.bias - self.late_bias) / self.n

    def scores(self, x: dict) -> dict[bool, float]:
        """Opposite scores of the two answers; a regression has none."""
        if self.rule == "sgd":
            return {}
        s = self.score(x)
        return {False: -s, True: s}


class IdUnit(LinearUnit):
    """What a LinearUnit does, to the last digit, of examples that are arrays of distinct ids, features of strength 1; weights are vectors."""

    @classmethod
    def like(cls, unit: LinearUnit) -> IdUnit:
        made = cls(**vars(unit))
        made.w, made.late = np.full(0, made.start), np.zeros(0)
        return made

    def widen(self, width: int) -> None:
        """Room for ids below `width`, in steps that double."""
        more = max(width, 2 * len(self.w)) - len(self.w)
        if width > len(self.w):
            self.w, self.late = np.append(self.w, np.full(more, self.start)), np.append(self.late, np.zeros(more))

    def raw(self, x: np.ndarray) -> float:
        return sum(self.w[x].tolist()) + self.bias

    def score(self, x: np.ndarray) -> float:
        if self.rule != "averaged" or not self.n:
            return self.raw(x) - self.threshold
        return (sum((self.n * self.w[x] - self.late[x]).tolist()) + self.n * self.bias - self.late_bias) / self.n - self.threshold

    def _square(self, x: np.ndarray) -> float:
        return float(len(x))

    def _scale(self, x: np.ndarray, base: float) -> None:
        self.w[x] *= base

    def _add(self, x: np.ndarray, step: float) -> None:
        self.w[x] += step
        if self.rule == "averaged":
            self.late[x] += self.n * step
        self.bias += step
        self.late_bias += self.n * step


def id_arrays(column: pa.ListArray, ids: dict) -> list[np.ndarray]:
    """The lists of a batch as arrays of ids; `ids` has those known and gets new ones. A null list is empty."""
    coded = column.flatten().dictionary_encode(null_encoding="encode")
    place = np.array([ids.setdefault(x, len(ids)) for x in coded.dictionary.to_pylist()], dtype=np.intp)
    each = place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.intp)
    ends = np.cumsum([n or 0 for n in column.value_lengths().to_pylist()], dtype=np.intp)
    return np.split(each, ends[:-1]) if len(ends) else []


def listed(column: pa.ListArray) -> list[list | None]:
    """to_pylist() of lists of few different values, each made once for the batch."""
    coded = column.flatten().dictionary_encode(null_encoding="encode")
    values, out, at = coded.dictionary.to_pylist(), [], 0
    each = [values[i] for i in coded.indices.to_numpy(zero_copy_only=False).tolist()]
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else each[at : at + n])
        at += n or 0
    return out


UNITS = {
    "perceptron": lambda **given: LinearUnit("perceptron", **given),
    "averaged": lambda **given: LinearUnit("averaged", **{"positive": 6.0, "negative": 6.0} | given),
    "winnow": LinearUnit.winnow,
    "mira": lambda **given: LinearUnit("mira", **{"beta": 2.0} | given),
    "sgd": lambda **given: LinearUnit("sgd", **{"rate": 0.1} | given),
}
# What a network of discrete labels learns with where nothing is named.
NETWORK_DEFAULT = {"rule": "winnow", "alpha": 1.35, "beta": 0.8, "threshold": 4.0, "start": 1.0}


def default_learner(kind: str) -> dict:
    """The rule and its parameters for labels of a kind: a network of winnow units, or regression for real ones."""
    return {"rule": "sgd"} if kind.startswith("real") else dict(NETWORK_DEFAULT)


def train_sequence(rows: list[tuple[dict, float]], rule: str, rounds: int = 1, **given) -> LinearUnit:
    unit = UNITS[rule](**given)
    for _ in range(rounds):
        for x, y in rows:
            unit.learn(x, y)
    return unit


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, doc_id, lang, quality, toxic, n_chars, features (distinct two-letter word endings) of labelled documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    ends = F.array_sort(F.array_distinct(F.transform(split_words(F.regexp_replace("text", "\n", " ")), lambda w: F.substring(w, -2, 2))))
    made = kept(docs.select("doc_id", "lang", "quality", "toxic", "n_chars", ends.alias("features")), "examples")  # ranges are found by a pass of their own, which would cut the texts anew
    return numbered(made, ["doc_id"])


_WEIGHTS = "target string, feature string, weight double"


def _weights(target: str, unit: LinearUnit) -> pa.RecordBatch:
    weights, bias = unit.averages()
    names = [None, *sorted(weights)]
    return pa.RecordBatch.from_arrays([pa.array([target] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([float(bias), *(float(weights[f]) for f in names[1:])])], names=["target", "feature", "weight"])


def train_groups(rows: DataFrame, rule: str, rounds: int = 1, **given) -> DataFrame:
    """target, feature, weight (feature null for the bias) of rows (target, idx, features, y), a unit for each target.

    Features have strength 1, or that of a column `strengths` of equal length.
    """
    strengths = F.col("strengths") if "strengths" in rows.columns else F.lit(None).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit = None, None
        for batch in batches:
            lists, strengths = listed(batch.column(1)), listed(batch.column(3))
            for target, x, y, strong in zip(batch.column(0).to_pylist(), lists, batch.column(2).to_pylist(), strengths, strict=True):
                if unit is None or target != now:
                    if unit is not None:
                        yield _weights(now, unit)
                    now, unit = target, UNITS[rule](**given)
                unit.learn(dict.fromkeys(x, 1.0) if strong is None else dict(zip(x, strong, strict=True)), y)
        if unit is not None:
            yield _weights(now, unit)

    turns = rows.select("target", "idx", "features", F.col("y").cast("double").alias("y"), strengths.alias("strengths"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("turn"))
    return turns.repartition("target").sortWithinPartitions("target", "turn", "idx").select("target", "features", "y", "strengths").mapInArrow(run, _WEIGHTS)


def _each(rows: DataFrame, few: DataFrame, names: list[str]) -> DataFrame:
    """rows with the columns `names` of every row of `few`, which has one row for each unit or label."""
    held = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in few.select(*names).collect()]
    return rows.withColumn("_few", F.explode(F.array(*held) if held else F.array().cast(f"array<{few.select(*names).schema.simpleString()}>"))).select("*", *[F.col(f"_few.{n}").alias(n) for n in names]).drop("_few")


def score_rows(rows: DataFrame, weights: DataFrame, default: float = 0.0) -> DataFrame:
    """doc_id, target, score of rows (doc_id, features): a join of features with weights, missing ones at the default.

    The weights are a table, kept in the shared folder; where it is small, Spark sends it to the executors, else it splits hot features. They stand on the
    right of a left join, as Spark takes exploded rows for as small as the file they come from and would send them.
    """
    weights = kept(weights, "weights")
    bias = weights.where("feature IS NULL").select("target", F.col("weight").alias("bias"))
    units = weights.where("feature IS NOT NULL").groupBy("feature").agg(F.collect_list(F.struct("target", "weight")).alias("_units"))
    found = rows.select("doc_id", F.explode("features").alias("feature")).join(units, "feature", "left").select("doc_id", F.explode_outer("_units").alias("w"))
    hits = found.groupBy("doc_id", F.col("w.target").alias("target")).agg(F.sum("w.weight").alias("s"), F.count("w.weight").alias("k"))
    every = _each(rows.select("doc_id", F.size("features").alias("size")), bias, ["target", "bias"])
    return every.join(hits, ["doc_id", "target"], "left").select("doc_id", "target", (F.coalesce("s", F.lit(0.0)) + (F.col("size") - F.coalesce("k", F.lit(0))) * default + F.col("bias")).alias("score"))


def predict(scored: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """doc_id, prediction: the target of the highest score, the smallest of equals; only among the candidates, if given."""
    own = scored if candidates is None else scored.where(F.col("target").isin(*candidates))
    return own.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "target")).alias("b")).select("doc_id", F.col("b.target").alias("prediction"))


def mux_scores(rows: DataFrame, weights: DataFrame, default: str) -> DataFrame:
    """doc_id, prediction of rows (doc_id, target, features): `true` or `false` by the unit of the row's own target, the
    default where no unit was trained for it."""
    weights = kept(weights, "weights")
    known = weights.where("feature IS NULL").select("target", F.col("weight").alias("bias"))
    hits = rows.select("doc_id", "target", F.explode("features").alias("feature")).join(weights.where("feature IS NOT NULL"), ["target", "feature"], "left").groupBy("doc_id").agg(F.sum("weight").alias("s"))
    joined = rows.select("doc_id", "target").join(known, "target", "left").join(hits, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("bias").isNull(), default).otherwise((F.coalesce("s", F.lit(0.0)) + F.col("bias") >= 0).cast("string")).alias("prediction"))


#: A step of the queries below, a power of two, so that sums of steps are exact and SQL comes to the same weights.
STEP = 0.125


def _shown(weights: DataFrame, start: float = 0.0) -> DataFrame:
    """Weights to 6 places, without those that are where they started; the bias stays."""
    rounded = F.round("weight", 6)
    return weights.select("target", "feature", rounded.alias("weight")).where(F.col("feature").isNull() | (F.col("weight") != start))


def _binary(spark: SparkSession, sf_dir: str, rule: str, **given) -> DataFrame:
    rows = examples(spark, sf_dir).withColumns({"target": F.lit("quality"), "y": F.col("quality")})
    return train_groups(rows, rule, rounds=2, **given)


def perceptron_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_binary(spark, sf_dir, "perceptron", rate=STEP))


def averaged_perceptron_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_binary(spark, sf_dir, "averaged", rate=STEP))


def winnow_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_binary(spark, sf_dir, "winnow"), 1.0)


def mira_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_binary(spark, sf_dir, "mira"))


def sgd_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear regression of the logarithm of the text's length, one pass."""
    rows = examples(spark, sf_dir).withColumns({"target": F.lit("length"), "y": F.log10(F.greatest("n_chars", F.lit(1)))})
    return _shown(train_groups(rows, "sgd", rate=0.001))


class UnitMatrix:
    """Units of one rule as rows of dense arrays, indexed by feature ids. Each does what a LinearUnit does, to the last digit."""

    def __init__(self, units: int, width: int, rule: str, **given):
        self.like = UNITS[rule](**given)
        self.w = np.full((units, width), self.like.start)
        self.touched = np.zeros((units, width), bool)
        self.late = np.zeros((units, width) if self.like.rule == "averaged" else (0, 0))
        self.bias, self.late_bias, self.n = np.full(units, self.like.bias), np.zeros(units), np.zeros(units)

    def learn(self, ids: np.ndarray, strengths: list[float] | None, y: np.ndarray, active: np.ndarray) -> None:
        """One example with distinct ids for the units `active`; y: a truth value or target for each of these."""
        u, s = self.like, np.array([1.0] * len(ids) if strengths is None else strengths)
        raw = np.array([sum(row) for row in (self.w[np.ix_(active, ids)] * s).tolist()], dtype=float) + self.bias[active]
        if u.rule == "sgd":
            step = u.rate * (y - raw)
        elif u.rule == "mira":
            sign = np.where(y != 0, 1, -1)
            tau = np.minimum(1.0, np.maximum(0.0, (u.beta / 2 - sign * (raw - u.threshold)) / (sum((s * s).tolist()) + 1))) * u.rate
            step = np.where(tau > 1e-9, sign * tau, 0.0)
        else:
            up, down = (y != 0) & (raw < u.threshold + u.positive), (y == 0) & (raw >= u.threshold - u.negative)
            if u.rule == "winnow":
                for on, base in ((up, u.alpha), (down, u.beta)):
                    rows = active[on]
                    self.w[np.ix_(rows, ids)] *= np.array([base**v for v in s.tolist()])
                    self.bias[rows] *= base
                    self.touched[np.ix_(rows, ids)] = True
                self.n[active] += 1
                return
            step = np.where(up, u.rate, np.where(down, -u.rate, 0.0))
        moved = (step != 0) if u.rule != "sgd" else np.ones(len(active), bool)
        rows, step = active[moved], step[moved]
        self.w[np.ix_(rows, ids)] += step[:, None] * s
        self.touched[np.ix_(rows, ids)] = True
        if u.rule == "averaged":
            self.late[np.ix_(rows, ids)] += (self.n[rows] * step)[:, None] * s
        self.bias[rows] += step
        self.late_bias[rows] += self.n[rows] * step
        self.n[active] += 1

    def weights(self, row: int, target: str) -> pa.RecordBatch:
        """target, feature_id, weight of one unit, a null id for the bias: what its predictions use of what it has touched."""
        ids, n = np.flatnonzero(self.touched[row]), self.n[row]
        own, bias = self.w[row, ids], self.bias[row]
        if self.like.rule == "averaged" and n:
            own, bias = (n * own - self.late[row, ids]) / n, (n * bias - self.late_bias[row]) / n
        return pa.RecordBatch.from_arrays([pa.array([target] * (len(ids) + 1), pa.string()), pa.array([None, *ids.tolist()], pa.int64()), pa.array([float(bias), *own.tolist()])], names=["target", "feature_id", "weight"])


_ID_WEIGHTS = "target string, feature_id long, weight double"
#: What the matrix of one task may take.
MATRIX_BYTES = 512 << 20


def coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (idx, features, ...) with ids in place of features, each once, and the lexicon (feature, feature_id)."""
    ids, lexicon = pre_extract(rows.select("idx", F.array_distinct("features").alias("features")))
    strong = rows.drop("features").join(ids.withColumnRenamed("features", "_ids").hint("merge"), "idx", "left")
    return strong.withColumn("features", F.coalesce("_ids", F.array().cast("array<bigint>"))).drop("_ids"), lexicon


def named(weights: DataFrame, lexicon: DataFrame) -> DataFrame:
    """target, feature, weight of weights by id; the bias has no feature."""
    return weights.join(lexicon, "feature_id", "left").select("target", "feature", "weight")


def train_ids(rows: DataFrame, lexicon: DataFrame, rule: str, rounds: int = 1, **given) -> DataFrame:
    """As train_groups, over rows (target, idx, features, y) whose features are ids of the lexicon: a unit is a dense vector."""
    width = lexicon.count()
    strengths = F.col("strengths") if "strengths" in rows.columns else F.lit(None).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit, only = None, None, np.array([0])
        for batch in batches:
            for target, ids, y, strong in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if unit is None or target != now:
                    if unit is not None:
                        yield unit.weights(0, now)
                    now, unit = target, UnitMatrix(1, width, rule, **given)
                unit.learn(np.array(ids, dtype=np.intp), strong, np.array([y]), only)
        if unit is not None:
            yield unit.weights(0, now)

    turns = rows.select("target", "idx", "features", F.col("y").cast("double").alias("y"), strengths.alias("strengths"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("turn"))
    made = turns.repartition("target").sortWithinPartitions("target", "turn", "idx").select("target", "features", "y", "strengths").mapInArrow(run, _ID_WEIGHTS)
    return named(made, lexicon)


def one_vs_all(rows: DataFrame, label: str, rule: str = "perceptron", rounds: int = 1, parts: int | None = None, **given) -> DataFrame:
    """Weights of a network: a unit for each label, made when the label is first seen, so that it misses earlier examples.

    Features become ids of a shared lexicon, and the units of a task are rows of one matrix, so examples are sent once for each
    matrix and not for each label. Labels are dealt over `parts` matrices, as many as MATRIX_BYTES calls for.
    """
    ids, lexicon = coded(rows.select("idx", "features", F.col(label).cast("string").alias("own")))
    width, labels = lexicon.count(), rows.select(label).distinct().count()
    n = parts or max(1, -(-labels * width * 25 // MATRIX_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, units = None, {}, None
        for batch in batches:
            for part, x, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    for target, place in sorted(places.items()):
                        yield units.weights(place, target)
                    now, places, units = part, {}, None
                if own is not None and own not in places and zlib.crc32(own.encode()) % n == part:
                    units = _widened(units, len(places), width, rule, given)
                    places[own] = len(places)
                if places:
                    y = np.zeros(len(places))
                    if own in places:
                        y[places[own]] = 1
                    units.learn(np.array(x, dtype=np.intp), None, y, np.arange(len(places)))
        for target, place in sorted(places.items()):
            yield units.weights(place, target)

    each = ids.select("idx", "features", "own", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("turn"))
    each = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return named(each.repartition(n, "part").sortWithinPartitions("part", "turn", "idx").select("part", "features", "own").mapInArrow(run, _ID_WEIGHTS), lexicon)


def _widened(units: UnitMatrix | None, used: int, width: int, rule: str, given: dict) -> UnitMatrix:
    """The matrix with room for one row more than the `used` ones; rows double when they run out."""
    if units is not None and used < len(units.bias):
        return units
    fresh = UnitMatrix(max(4, 2 * used), width, rule, **given)
    for name in ("w", "touched", "late", "bias", "late_bias", "n") if units is not None else ():
        if getattr(fresh, name).size:
            getattr(fresh, name)[:used] = getattr(units, name)[:used]
    return fresh


def _network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = examples(spark, sf_dir)
    return rows, score_rows(rows, one_vs_all(rows, "lang", rounds=2, rate=STEP))


def network_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document by the network's highest score, the smallest label of equals."""
    rows, scored = _network(spark, sf_dir)
    return predict(scored).join(rows.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "prediction")


def network_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with `de` and `fr` alone to choose from."""
    return predict(_network(spark, sf_dir)[1], ["de", "fr"])


def network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, target, score of the network's units."""
    return _network(spark, sf_dir)[1].select("doc_id", "target", F.round("score", 4).alias("score"))


def _mux(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = examples(spark, sf_dir).withColumns({"target": F.col("lang"), "y": F.col("quality")})
    return rows, train_groups(rows.where("lang <> 'es'"), "perceptron", rate=STEP)


def mux_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perceptron for each language but `es`, chosen by the document's."""
    return _shown(_mux(spark, sf_dir)[1])


def mux_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, prediction of the unit of each document's language; `unseen` where there is none."""
    rows, weights = _mux(spark, sf_dir)
    return mux_scores(rows, weights, "unseen")


def multilabel_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and all labels whose unit's score is at least 0, joined by commas."""
    rows = examples(spark, sf_dir)
    each = rows.select("doc_id", "idx", "features", F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("target", "y"))
    found = score_rows(rows, train_groups(each, "perceptron", rounds=2, rate=STEP)).where("score >= 0")
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("labels"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def t_tail(t: float, df: float) -> float:
    """P(|T| > t) for Student's t."""
    x = df / (df + t * t)
    front = math.exp(math.lgamma(df / 2 + 0.5) - math.lgamma(df / 2) - math.lgamma(0.5) + df / 2 * math.log(x) + 0.5 * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (df / 2 + 1) / (df / 2 + 2.5):
        return front * _beta_fraction(df / 2, 0.5, x) / (df / 2)
    return 1 - front * _beta_fraction(0.5, df / 2, 1 - x) / 0.5


def t_quantile(df: float, alpha: float) -> float:
    """The two-sided critical value."""
    low, high = 0.0, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > alpha else (low, mid)
    return (low + high) / 2


def cross_validate(rows: DataFrame, k: int, rule: str, rounds: int = 1, **given) -> DataFrame:
    """fold, hits, tested of rows (idx, features, y, own): each fold is scored by a unit trained on the others.

    A task reads the examples of a fold's training and then those of its test, in order, and keeps the unit and the ids of its features alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit, hits, tested, ids = None, None, 0, 0, {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (now, hits, tested)], names=["fold", "hits", "tested"])

        for batch in batches:
            lists = id_arrays(batch.column(1), ids)
            if unit is not None:
                unit.widen(len(ids))
            for fold, x, y, test in zip(batch.column(0).to_pylist(), lists, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if fold != now:
                    if unit is not None:
                        yield made()
                    now, unit, hits, tested = fold, IdUnit.like(UNITS[rule](**given)), 0, 0
                    unit.widen(len(ids))
                if test:
                    tested += 1
                    hits += bool(unit.score(x) >= 0) == bool(y)
                else:
                    unit.learn(x, y)
        if unit is not None:
            yield made()

    each = rows.select("idx", F.array_distinct("features").alias("features"), F.col("y").cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"), "own")
    each = each.withColumn("test", F.col("own") == F.col("fold")).withColumn("turn", F.explode(F.when(F.col("test"), F.array(F.lit(rounds))).otherwise(F.sequence(F.lit(0), F.lit(rounds - 1)))))
    return each.repartition(k, "fold").sortWithinPartitions("fold", "turn", "idx").select("fold", "features", "y", "test").mapInArrow(run, "fold long, hits long, tested long")


def summary(folds: DataFrame, alpha: float = 0.05) -> DataFrame:
    """fold, accuracy, mean, std, half (of the confidence interval) of rows (fold, hits, tested), to 5 places. These are kept, as
    counting them here and reading them after would train each fold twice."""
    rows = kept(folds, "folds").withColumn("accuracy", F.try_divide(F.col("hits").cast("double"), F.col("tested")))
    every = Window.partitionBy(F.lit(0))  # a row for each fold
    k = F.count(F.lit(1)).over(every)
    mean, std = F.avg("accuracy").over(every), F.stddev_samp("accuracy").over(every)
    n = rows.count()
    half = F.lit(t_quantile(n - 1, alpha) if n > 1 else None) * std / F.sqrt(k)
    return rows.select("fold", *[F.round(c, 5).alias(name) for c, name in ((F.col("accuracy"), "accuracy"), (mean, "mean"), (std, "std"), (half, "half"))])


def cross_validation(spark: SparkSession, sf_dir: str, k: int = 5, alpha: float = 0.05) -> DataFrame:
    """fold, accuracy, mean, std, half (of the confidence interval) of the averaged perceptron on quality."""
    rows = examples(spark, sf_dir).withColumns({"own": F.pmod("idx", F.lit(k)), "y": F.col("quality")})
    return summary(cross_validate(rows, k, "averaged", rate=STEP), alpha)


def _examples_sql(targets: str) -> str:
    """Common tables `ex` (target, idx, doc_id, features, y, first) and `dense` with a place for each feature."""
    return f"""WITH RECURSIVE docs AS (
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, lang, quality, toxic, n_chars,
               list_distinct(list_transform(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> ''), lambda w: right(w, 2))) AS features
        FROM documents JOIN labels USING (doc_id)),
    ex AS ({targets}),
    voc AS (SELECT list(f ORDER BY f) AS v FROM (SELECT DISTINCT unnest(features) AS f FROM docs)),
    dense AS (SELECT doc_id, list_transform(v, lambda f: CASE WHEN list_contains(features, f) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x FROM docs, voc)"""


#: Per rule: where weights start, the score's terms, the step of an example, and the weights after it.
_ADD = "list_transform(list_zip(w, x), lambda p: p[1] + step * p[2])"
_MISTAKE = "CASE WHEN y = 1 AND s < {high} THEN {rate} WHEN y = 0 AND s >= {low} THEN -{rate} ELSE 0.0 END"
_RULES = {
    "perceptron": (0.0, _MISTAKE.format(high=0.0, low=0.0, rate=STEP), _ADD, "b + step"),
    "averaged": (0.0, _MISTAKE.format(high=6.0, low=-6.0, rate=STEP), _ADD, "b + step"),
    "winnow": (1.0, "CASE WHEN y = 1 AND s < 16 THEN 2.0 WHEN y = 0 AND s >= 16 THEN 0.5 ELSE 1.0 END", "list_transform(list_zip(w, x), lambda p: p[1] * CASE WHEN p[2] = 1 THEN step ELSE 1.0 END)", "b * step"),
    "mira": (0.0, "CASE WHEN y = 1 THEN 1 ELSE -1 END * least(1.0, greatest(0.0, (1.0 - CASE WHEN y = 1 THEN 1 ELSE -1 END * s) / (list_sum(x) + 1))) * 0.1", _ADD, "b + step"),
    "sgd": (0.0, "0.001 * (y - s)", _ADD, "b + step"),
}


def _train_sql(rule: str, targets: str, rounds: int) -> str:
    """As _examples_sql, and `final` (target, n, w, b, late, late_b): the unit of each target after all examples."""
    start, step, weights, bias = _RULES[rule]
    return f"""{_examples_sql(targets)},
    turns AS (SELECT target, row_number() OVER (PARTITION BY target ORDER BY turn, idx) AS k, doc_id, y
        FROM ex, (SELECT unnest(range({rounds})) AS turn) t WHERE turn > 0 OR idx >= first),
    run AS (
        SELECT target, 0::BIGINT AS k, list_transform(v, lambda f: {start}::DOUBLE) AS w, {start}::DOUBLE AS b, list_transform(v, lambda f: 0.0::DOUBLE) AS late, 0.0::DOUBLE AS late_b
        FROM (SELECT DISTINCT target FROM ex), voc
        UNION ALL
        SELECT target, k + 1, {weights}, ({bias})::DOUBLE, list_transform(list_zip(late, x), lambda p: p[1] + k * step * p[2]), (late_b + k * step)::DOUBLE FROM (
            SELECT *, ({step})::DOUBLE AS step FROM (
                SELECT r.*, t.y, d.x, list_dot_product(r.w, d.x) + r.b AS s FROM run r JOIN turns t ON t.target = r.target AND t.k = r.k + 1 JOIN dense d USING (doc_id)))),
    final AS (SELECT target, k AS n, w, b, late, late_b FROM run QUALIFY k = max(k) OVER (PARTITION BY target))"""


def _weights_sql(rule: str, targets: str, rounds: int) -> str:
    start = _RULES[rule][0]
    own, bias = ("(n * w[i] - late[i]) / n", "(n * b - late_b) / n") if rule == "averaged" else ("w[i]", "b")
    return f"""{_train_sql(rule, targets, rounds)}
        SELECT * FROM (SELECT target, v[i] AS feature, round({own}, 6) AS weight FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM final), voc) WHERE weight <> {start}
        UNION ALL SELECT target, NULL, round({bias}, 6) FROM final"""


_QUALITY = "SELECT 'quality' AS target, idx, doc_id, quality AS y, 0 AS first FROM docs"
_LANGS = "SELECT l.lang AS target, idx, doc_id, (d.lang = l.lang)::INT AS y, first FROM docs d, (SELECT lang, min(idx) AS first FROM docs GROUP BY 1) l"
_MUX = "SELECT lang AS target, idx, doc_id, quality AS y, 0 AS first FROM docs WHERE lang <> 'es'"
_BOTH = "SELECT 'quality' AS target, idx, doc_id, quality AS y, 0 AS first FROM docs UNION ALL SELECT 'toxic', idx, doc_id, toxic, 0 FROM docs"
_FOLDS = "SELECT f::VARCHAR AS target, idx, doc_id, quality AS y, 0 AS first FROM docs, (SELECT unnest(range(5)) AS f) WHERE idx % 5 <> f"
_SCORED = "scored AS (SELECT d.doc_id, target, list_dot_product(w, x) + b AS score FROM dense d, final)"
_BEST = "SELECT doc_id, target AS prediction FROM scored {where} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, target) = 1"
QUERIES = {f.__name__: f for f in (perceptron_train, averaged_perceptron_train, winnow_train, mira_train, sgd_train, network_train, network_candidates, network_scores, mux_train,
    mux_predict, multilabel_train, cross_validation)}
SQL: dict[str, str] = {
    "perceptron_train": _weights_sql("perceptron", _QUALITY, 2),
    "averaged_perceptron_train": _weights_sql("averaged", _QUALITY, 2),
    "winnow_train": _weights_sql("winnow", _QUALITY, 2),
    "mira_train": _weights_sql("mira", _QUALITY, 2),
    "sgd_train": _weights_sql("sgd", "SELECT 'length' AS target, idx, doc_id, log10(greatest(n_chars, 1)) AS y, 0 AS first FROM docs", 1),
    "network_train": f"{_train_sql('perceptron', _LANGS, 2)}, {_SCORED}, best AS ({_BEST.format(where='')}) SELECT doc_id, lang, prediction FROM best JOIN docs USING (doc_id)",
    "network_candidates": f"""{_train_sql('perceptron', _LANGS, 2)}, {_SCORED} {_BEST.format(where="WHERE target IN ('de', 'fr')")}""",
    "network_scores": f"{_train_sql('perceptron', _LANGS, 2)}, {_SCORED} SELECT doc_id, target, round(score, 4) AS score FROM scored",
    "mux_train": _weights_sql("perceptron", _MUX, 1),
    "mux_predict": f"""{_train_sql('perceptron', _MUX, 1)}, {_SCORED} SELECT d.doc_id, CASE WHEN score IS NULL THEN 'unseen'
        WHEN score >= 0 THEN 'true' ELSE 'false' END AS prediction FROM docs d LEFT JOIN scored s ON s.doc_id = d.doc_id AND s.target = d.lang""",
    "multilabel_train": f"{_train_sql('perceptron', _BOTH, 2)}, {_SCORED} SELECT doc_id, string_agg(target, ',' ORDER BY target) AS labels FROM scored WHERE score >= 0 GROUP BY 1",
    "cross_validation": f"""{_train_sql('averaged', _FOLDS, 1)},
        tested AS (SELECT target::BIGINT AS fold, ((list_dot_product(list_transform(list_zip(w, late), lambda p: n * p[1] - p[2]), x) + n * b - late_b) / n >= 0) = (quality = 1) AS hit
            FROM final, docs JOIN dense USING (doc_id) WHERE idx % 5 = target::BIGINT),
        folds AS (SELECT fold, avg(hit::INT) AS a FROM tested GROUP BY 1), s AS (SELECT avg(a) AS m, stddev_samp(a) AS d, count(*) AS k FROM folds)
        SELECT fold, round(a, 5) AS accuracy, round(m, 5) AS mean, round(d, 5) AS std, round({t_quantile(4, 0.05)!r} * d / sqrt(k), 5) AS half FROM folds, s""",
}
