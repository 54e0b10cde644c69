"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Words are A-Z lower-cased and cut at ASCII white space; each text ends with an end token. The model predicts a symbol:
the end, one of the most frequent training words, or a class of all other words, by the hash of a word's last bytes.
Both numbers grow with the corpus: of N training tokens, 2 * N^(1/3) words (FEWEST at least) have vectors of their own,
and there is a class for every eight of them (CLASSES at least); so the S^3 terms of the normaliser stay in proportion to
N. A symbol's representation is predicted bilinearly from those of the two symbols before it, with a matrix for each
place.

Training is numpy on the executors. In each of ROUNDS rounds every task starts from the same parameters, goes once over
all its training tokens in batches (again, where they are so few that they make less than LEAST_STEPS batches), with
noise drawn from the symbols' own frequencies, and sends its parameters; these are averaged in two steps, a symbol's
vectors in proportion to how often a task met it. So every training token is learned from, and only sums of parameters
reach the driver. Batched matrix products then give the logarithm of the normaliser after every pair of symbols, also on
the executors, and a token's log-probability is two look-ups less that. A word of a class has the class's probability
times its smoothed share of the class, in which one place is left for words never seen; so each token's distribution adds
up to 1.

Counts of all words come from all training documents. The HEAD most frequent words (a fixed bound, ties by the word) go to
every executor; the words beyond are looked up by a join, so every token meets its exact count. Texts are cut into words
once for counting and once for symbols, which are kept in the shared folder; texts of any length are taken whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, saved, trimmed

FEWEST, CLASSES, HEAD = 95, 32, 150_000
DIMENSION, ROUNDS, BATCH, NOISE, LEAST_STEPS, RATE = 16, 2, 2048, 64, 400, 0.15
_CHUNK = 1 << 20  # tokens that are put into random order at once
SMOOTH = 0.1
END = b"\n"  # no word holds white space
_FLUSH = 400_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text is a multiple of 10; a document without id is learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


def vocabulary(tokens: int) -> tuple[int, int]:
    """How many words have vectors of their own, and how many classes the others form."""
    words = max(FEWEST, int(2 * tokens ** (1 / 3)))
    return words, max(CLASSES, words // 8)


def _counted(docs: DataFrame) -> DataFrame:
    """word, n over the training documents; tasks send partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

        count: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not held_out(doc_id):
                    count.update(words(text.as_py()))
                    count[END] += 1
                    if len(count) > _FLUSH:
                        yield sent()
                        count.clear()
        yield sent()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, head: int) -> dict[bytes, int]:
    """The `head` words of the highest counts, ties by the word, in that order.

    How many words have each count says which counts are wholly inside; no task sorts more than the words of one count.
    """
    left, least, rest = head, 0, 0
    for n, words_ in sorted(counts.groupBy("n").agg(F.count(F.lit(1))).collect(), reverse=True):
        if words_ > left:
            least, rest = n, left
            break
        left -= words_
    found = counts.where(F.col("n") > least).toArrow()
    pairs = list(zip(found["n"].to_pylist(), found["word"].to_pylist(), strict=True))
    if rest:
        found = counts.where(F.col("n") == least).orderBy("word").limit(rest).toArrow()
        pairs += zip(found["n"].to_pylist(), found["word"].to_pylist(), strict=True)
    return {word: n for n, word in sorted(pairs, key=lambda x: (-x[0], x[1]))}


@dataclass
class Model:
    """Symbols 0 to n - 1 are predicted; symbol n is the start, which stands twice before each text."""

    r: np.ndarray  # (n + 1, d) representations of what comes before
    q: np.ndarray  # (n, d) and of what is predicted
    b: np.ndarray  # (n,)
    c1: np.ndarray  # (d, d) the place two before
    c2: np.ndarray  # (d, d) the place before

    @classmethod
    def fresh(cls, unigram: np.ndarray, dimension: int = DIMENSION, seed: int = 7) -> Model:
        random, n = np.random.default_rng(seed), len(unigram)
        draw = lambda rows: random.normal(0, 0.1, (rows, dimension)).astype(np.float32)
        return cls(draw(n + 1), draw(n), np.log(unigram).astype(np.float32), np.eye(dimension, dtype=np.float32) / 2, np.eye(dimension, dtype=np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.c1, self.c2]

    def log_normaliser(self, first: int) -> np.ndarray:
        """Logarithms of the sums over all predicted symbols, after `first` and each symbol."""
        score = (self.r[first] @ self.c1 + self.r @ self.c2) @ self.q.T + self.b
        top = score.max(axis=1, keepdims=True)
        return (top + np.log(np.exp(score - top).sum(axis=1, keepdims=True)))[:, 0]


def in_context(texts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols two before, before and at each token of all texts in a row."""
    lead = np.full(2, start, np.int32)
    flat = np.concatenate([y for x in texts for y in (lead, x)]).astype(np.int32) if texts else np.empty(0, np.int32)
    here = np.flatnonzero(flat != start)
    return flat[here - 2], flat[here - 1], flat[here]


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, d) sums of the values (m, d) by row number."""
    d = values.shape[1]
    return np.bincount((rows[:, None] * d + np.arange(d)).ravel(), weights=values.ravel(), minlength=n * d).reshape(n, d).astype(np.float32)


NAMES = ("r", "q", "b", "c1", "c2")


class Trainer:
    """Noise-contrastive steps from a model on; `before` and `at` count the symbols seen before a token and as one."""

    def __init__(self, model: Model, squares: list[np.ndarray], unigram: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in zip(NAMES, model.parts(), strict=True)}
        self.squares = {k: v.copy() for k, v in zip(NAMES, squares, strict=True)}  # sums of squared gradients
        self.noise, self.random = np.cumsum(unigram), np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.before, self.at = np.zeros(len(unigram) + 1), np.zeros(len(unigram))

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, rate: float) -> None:
        p, n = self.p, len(self.at)
        ra, rb, qw = p["r"][a], p["r"][b], p["q"][w]
        predicted = ra @ p["c1"] + rb @ p["c2"]
        fake = np.minimum(np.searchsorted(self.noise, self.random.random(NOISE)), n - 1)  # shared by the batch
        real = (predicted * qw).sum(axis=1) + p["b"][w] - self.log_noise[w]
        false = predicted @ p["q"][fake].T + p["b"][fake] - self.log_noise[fake]
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # towards the symbol that came
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))  # away from the noise
        pushed = up[:, None] * qw + down @ p["q"][fake]
        gradient = {"q": _sums(w, up[:, None] * predicted, n), "b": np.bincount(w, weights=up, minlength=n), "c1": ra.T @ pushed, "c2": rb.T @ pushed}
        np.add.at(gradient["q"], fake, down.T @ predicted)
        np.add.at(gradient["b"], fake, down.sum(axis=0))
        gradient["r"] = _sums(np.concatenate([a, b]), np.concatenate([pushed @ p["c1"].T, pushed @ p["c2"].T]), n + 1)
        for k, g in gradient.items():
            g = (g / len(w)).astype(np.float32)
            self.squares[k] += g * g
            p[k] += np.float32(rate) * g / np.sqrt(self.squares[k])
        self.before += np.bincount(a, minlength=n + 1) + np.bincount(b, minlength=n + 1)
        self.at += np.bincount(w, minlength=n)


def _train(coded: DataFrame, model: Model, squares: list[np.ndarray], unigram: np.ndarray, dtype: str, turn: int, last: bool) -> tuple[Model, list[np.ndarray]]:
    """The average of what all tasks make of the model in one round; coded: `symbols`, a row for each training text.

    A task holds the symbols of its input split, two bytes for each token; the rate falls over its steps, in the last round
    to a tenth. Steps are adaptive by sums of squared gradients, which are averaged too and go on in the next round.
    """
    shared = coded.sparkSession.sparkContext.broadcast((model, squares, unigram))
    shapes = [x.shape for x in model.parts()]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, squares, unigram = shared.value
        trainer = Trainer(model, squares, unigram, 100_003 * turn + TaskContext.get().partitionId())
        texts = [np.frombuffer(x.as_buffer(), dtype) for batch in batches for x in batch.column(0)]
        total = sum(map(len, texts))
        if not total:
            return
        steps, done, begin, whole = max(LEAST_STEPS, -(-total // BATCH)), 0, 0, False
        while not whole or done < steps:
            own, size = [], 0
            while begin < len(texts) and (not own or size < _CHUNK):
                own.append(texts[begin])
                size += len(texts[begin])
                begin += 1
            if begin == len(texts):
                begin, whole = 0, True
            a, b, w = in_context(own, len(unigram))
            order = trainer.random.permutation(len(w))
            for i in range(0, len(w), BATCH):
                pick = order[i : i + BATCH]
                trainer.step(a[pick], b[pick], w[pick], RATE * (1 - (0.9 if last else 0.5) * min(1.0, done / steps)))
                done += 1
        weights = [trainer.before + 1e-3, trainer.at + 1e-3, trainer.at + 1e-3, trainer.at.sum(), trainer.at.sum()]
        yield sent([*(trainer.p[k] for k in NAMES), *(trainer.squares[k] for k in NAMES)], weights * 2)
        trimmed()

    def sent(parts: list[np.ndarray], weights: list) -> pa.RecordBatch:
        raw = [b"".join((x.T * w).T.astype(np.float64).tobytes() for x, w in zip(parts, weights, strict=True)), b"".join(np.float64(w).tobytes() for w in weights)]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], names=["sums", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for own in zip(batch.column(0), batch.column(1), strict=True):
                own = [np.frombuffer(x.as_buffer(), np.float64) for x in own]
                total = own if total is None else [x + y for x, y in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=["sums", "weights"])

    schema = "sums binary, weights binary"
    found = coded.mapInArrow(learn, schema).repartition(16).mapInArrow(add, schema).toArrow()
    if not len(found):
        return model, squares
    sums, weights = (sum(np.frombuffer(x.as_buffer(), np.float64) for x in found[c]) for c in ("sums", "weights"))
    out, at, by = [], 0, 0
    for shape, wide in zip(shapes * 2, (shapes[0][0], shapes[1][0], shapes[2][0], 1, 1) * 2, strict=True):
        n = int(np.prod(shape))
        out.append((sums[at : at + n].reshape(shape).T / weights[by : by + wide]).T.astype(np.float32))
        at, by = at + n, by + wide
    return Model(*out[:5]), out[5:]


def fit(coded: DataFrame, unigram: np.ndarray, dtype: str = "<u2", rounds: int = ROUNDS, dimension: int = DIMENSION) -> Model:
    """The model of all training texts; coded: `symbols` binary, the symbols of a text, the end last."""
    model = Model.fresh(unigram, dimension)
    squares = [np.full_like(x, 1e-9) for x in model.parts()]
    for turn in range(rounds):
        model, squares = _train(coded, model, squares, unigram, dtype, turn, turn == rounds - 1)
    return model


def normalisers(spark, model: Model) -> np.ndarray:
    """Logarithms of the normaliser after each pair of symbols; a task for some of the first symbols."""
    shared, n = spark.sparkContext.broadcast(model), len(model.r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([shared.value.log_normaliser(first).astype("<f4").tobytes()], pa.binary())], names=["first", "row"])

    rows = spark.range(n).repartition(min(n, partitions(spark)), "id").mapInArrow(run, "first long, row binary").toArrow()
    out = np.empty((n, n), np.float32)
    for first, row in zip(rows["first"].to_pylist(), rows["row"], strict=True):
        out[first] = np.frombuffer(row.as_buffer(), "<f4")
    return out


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learned from are the rows whose id's crc32 is no multiple of 10. Null and empty texts are the end token alone. Rows
    that repeat count as often as they come. An empty table has no rows; one that is all held out is scored by a model
    of no counts. Texts of any length are scored whole; of equally frequent words the first in byte order comes first,
    for a vector of its own as for a place among the HEAD words. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    counts = saved(_counted(rows), "counts")
    common = _most_frequent(counts, head)
    ends = counts.where(F.col("word") == F.lit(END)).select("n").first()
    common = {END: ends[0] if ends else 0} | {w: n for w, n in common.items() if w != END}
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size, classes = vocabulary(total)
    top = [w for w in common if w != END][:size]
    first_class = 1 + len(top)
    last_two = F.when(F.length("word") > 1, F.substring("word", -2, 2)).otherwise(F.col("word"))
    in_class = F.pmod(F.crc32(last_two), F.lit(classes)).cast("int")
    held = np.zeros((classes, 2))  # tokens and words of each class, without those that have their own symbols
    for c, n, v in counts.where(F.col("word") != F.lit(END)).groupBy(in_class.alias("c")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        held[c] = n, v
    for w in top:
        held[class_of(w, classes)] -= common[w], 1
    sizes = np.maximum(held[:, 0] + SMOOTH * (held[:, 1] + 1), SMOOTH)
    bottom = total + SMOOTH * (distinct + 1)
    words_in = list(common)
    n_in = np.array(list(common.values()), float)
    symbol_of = np.array([i if i < first_class else first_class + class_of(w, classes) for i, w in enumerate(words_in)], np.int64)
    base_of = np.log10((n_in + SMOOTH) / bottom)
    inner_of = np.where(symbol_of >= first_class, np.log10((n_in + SMOOTH) / sizes[np.maximum(symbol_of - first_class, 0)]), 0.0)
    unigram = np.concatenate([n_in[:first_class], held[:, 0]]) + 0.5
    unigram /= unigram.sum()
    dtype = "<u2" if len(unigram) < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast((words_in, symbol_of, base_of, inner_of, ends is not None))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in, symbol_of, base_of, inner_of, any_end = shared.value
        known = dict(zip(words_in, range(len(words_in)), strict=True))
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own = batch.slice(i, 256)
                made = []
                for doc_id, text in zip(own.column(0).to_pylist(), own.column(1), strict=True):
                    tokens = words(text.as_py())
                    n = len(tokens) + 1
                    found = np.zeros(n, np.int32)  # the end is word 0
                    found[:-1] = np.fromiter(map(known.get, tokens, repeat(-1)), np.int32, n - 1)
                    spots = np.flatnonzero(found < 0)
                    symbols = symbol_of[found]
                    rare = Counter()
                    if len(spots):
                        missed = [tokens[j] for j in spots.tolist()]
                        rare.update(missed)
                        symbols[spots] = [first_class + class_of(w, classes) for w in missed]
                        found = found[found >= 0]
                    made.append((serial, doc_id, held_out(doc_id), n, n - len(spots) - (not any_end), float(base_of[found].sum()), float(inner_of[found].sum()), list(rare),
                        list(rare.values()), symbols.astype(dtype).tobytes()))
                    serial += 1
                columns = list(zip(*made, strict=True))
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["serial", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "rare", "times", "symbols"])
        trimmed()

    coded = saved(rows.mapInArrow(code, "serial long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, rare array<binary>, times array<long>, symbols binary"), "coded")
    model = fit(coded.where("NOT held_out").select("symbols"), unigram, dtype) if total else Model.fresh(unigram)
    tables = spark.sparkContext.broadcast((model, normalisers(spark, model)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = tables.value
        n = len(model.b)
        one, two = ((model.r @ c @ model.q.T).astype(np.float32) for c in (model.c1, model.c2))
        two += model.b
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own = batch.slice(i, 256)
                texts = [np.frombuffer(x.as_buffer(), dtype) for x in own.column(6)]
                a, b, w = (x.astype(np.int64) for x in in_context(texts, n))
                each = one.ravel()[a * n + w].astype(np.float64) + two.ravel()[b * n + w] - logs.ravel()[a * (n + 1) + b]
                sums = np.add.reduceat(each, np.cumsum([0, *[len(x) for x in texts[:-1]]])) / np.log(10)  # no text is without its end
                yield pa.RecordBatch.from_arrays([*own.columns[:6], pa.array(sums + own.column(7).to_numpy())], names=["serial", "doc_id", "held_out", "n_tokens", "known", "base", "own"])
        trimmed()

    scored = coded.select("serial", "doc_id", "held_out", "n_tokens", "known", "base", "symbols", "inner").mapInArrow(judge,
        "serial long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double")
    rare = coded.select("serial", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("serial", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size_of = F.get(F.lit([float(x) for x in sizes]), in_class)
    more = met.groupBy(F.col("serial").alias("_serial")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_more"),
        F.sum(F.col("times") * F.log10((F.col("n") + F.lit(SMOOTH)) / F.lit(float(bottom)))).alias("base_more"),
        F.sum(F.col("times") * F.log10((F.col("n") + F.lit(SMOOTH)) / size_of)).alias("own_more"),
    )
    out = scored.join(more, F.col("serial") == F.col("_serial"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("known", "known_more").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base",
        "base_more").alias("base_score"), plus("own", "own_more").alias("score"))
