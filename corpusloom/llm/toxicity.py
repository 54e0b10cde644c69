"""Toxicity by a classifier chain.

Categories are predicted one after another, each by a logistic regression over presence features (words and word
beginnings, hashed to 32 bits) and the probabilities of the categories before it. When a later link is fitted, the
earlier probabilities are out-of-fold predictions, so it sees them as wrong as they will be on new documents.

The chain is fitted on at most SAMPLE labelled documents, those with the smallest hash of the id; every document is
scored, on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import trimmed
from corpusloom.llm.near_dup import bounded

SAMPLE, FEATURES, LEAST, FOLDS, BEGIN = 20_000, 1500, 6, 5, 5
THRESHOLD = 0.3
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the words (A-Z lower-cased, without marks at their ends) and their first letters."""
    words = {w.strip(_MARKS) for w in set((text or "").encode("utf-8", "surrogatepass").lower().split())}
    starts = {b"^" + w[:BEGIN] for w in words if len(w) > BEGIN}
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, words | starts), np.uint32))


@dataclass
class Link:
    """One category: feature hashes, their weights, the weights of earlier links' log-odds and the intercept."""

    name: str
    hashes: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def log_odds(self, own: np.ndarray, before: Sequence[float]) -> float:
        at = np.searchsorted(self.hashes, own)
        at[at == len(self.hashes)] = 0
        hit = at[self.hashes[at] == own] if len(self.hashes) else at[:0]
        return float(self.weights[hit].sum() + np.dot(self.earlier, before) + self.bias)


def _select(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, count: int, width: int) -> np.ndarray:
    """The features whose presence says most about y: largest mutual deviation from independence (chi-square)."""
    n, total, share = np.bincount(cols, minlength=width), len(y), y.mean()
    hits = np.bincount(cols[y[rows] == 1], minlength=width)
    expected = n * share
    chi = (hits - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - n / total), 1e-9)
    chi[(n < LEAST) | (n > 0.5 * total)] = 0
    best = np.lexsort((np.arange(width), -chi))[:count]
    return np.sort(best[chi[best] > 10.8])


def _fit(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, ridge: float = 0.5, steps: int = 120) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with an L2 penalty by accelerated gradient steps; rows and cols are the ones of the matrix."""
    n, k = len(y), extra.shape[1]
    w, u, b = np.zeros(width), np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    at = (w, u, b)
    scale = np.sqrt(np.bincount(cols, minlength=width) + ridge)  # features of one size, so one step length fits
    largest = np.bincount(rows, weights=1 / scale[cols], minlength=n).max(initial=1.0)
    rate = 1.0 / max(1.0, 0.25 * np.sqrt(largest) * 4)
    for t in range(steps):
        z = np.bincount(rows, weights=at[0][cols], minlength=n) + extra @ at[1] + at[2]
        r = y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gw = (np.bincount(cols, weights=r[rows], minlength=width) - ridge * at[0]) / scale**2 * 4
        gu = (extra.T @ r - ridge * at[1]) / (np.square(extra).sum(axis=0) + ridge)
        new = (at[0] + rate * gw, at[1] + rate * gu, at[2] + rate * 4 * r.mean())
        m = t / (t + 3)
        at = tuple(x + m * (x - old) for x, old in zip(new, (w, u, b), strict=True))
        w, u, b = new
    return w, u, float(b)


def _coded(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that come LEAST times or more (rarer ones are never chosen), and the place of each entry's in them, -1 for others."""
    ordered = np.sort(cols)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    often = ordered[starts[np.diff(np.append(starts, len(ordered))) >= LEAST]]
    del ordered
    codes = np.full(len(cols), -1, np.int32)
    for i in range(0, len(cols) if len(often) else 0, 1 << 20):
        part = cols[i : i + (1 << 20)]
        at = np.searchsorted(often, part)
        at[at == len(often)] = 0
        codes[i : i + (1 << 20)] = np.where(often[at] == part, at, -1)
    return often, codes


def fit_chain(rows: np.ndarray, cols: np.ndarray, labels: dict[str, np.ndarray], folds: int = FOLDS) -> list[Link]:
    """A link for each category of labels, in their order; documents whose label is not 0 or 1 are left out of that link.

    rows and cols: a document's number and a feature hash for each feature of each document.
    """
    n = len(next(iter(labels.values()), ()))
    often, codes = _coded(cols)
    kept = codes >= 0
    rows, codes = rows[kept], codes[kept]
    before, chain = np.empty((n, 0)), []
    for name, label in labels.items():
        usable = np.isin(label, (0, 1))

        def fitted(train: np.ndarray, label=label, before=before, name=name) -> tuple[Link, np.ndarray]:
            """The link, and the place of each feature in it, -1 for those that weren't chosen."""
            y, place = label[train].astype(float), np.full(len(often), -1, np.int32)
            if not len(y) or y.min() == y.max():
                return Link(name, np.empty(0, np.uint32), np.empty(0), np.zeros(before.shape[1]), -20.0 if not len(y) or y.max() == 0 else 20.0), place
            number = np.full(n, -1, np.int32)
            number[train] = np.arange(len(train), dtype=np.int32)
            inside = number[rows] >= 0
            r, c = number[rows[inside]], codes[inside]
            best = _select(r, c, y, FEATURES, len(often))
            place[best] = np.arange(len(best), dtype=np.int32)
            hit = place[c] >= 0
            return Link(name, often[best], *_fit(r[hit], place[c[hit]], before[train], y, len(best))), place

        out_of_fold = np.zeros(n)
        for f in range(folds):
            link, place = fitted(np.flatnonzero(usable & (np.arange(n) % folds != f)))
            hit = (rows % folds == f) & (place[codes] >= 0)
            odds = np.bincount(rows[hit], weights=link.weights[place[codes[hit]]], minlength=n) + before @ link.earlier + link.bias
            out_of_fold[f::folds] = odds[f::folds]
        chain.append(fitted(np.flatnonzero(usable))[0])
        before = np.column_stack([before, np.clip(out_of_fold, -20, 20)])
    return chain


def score_chain(chain: list[Link], own: np.ndarray) -> list[float]:
    """The probability of each category."""
    before: list[float] = []
    for link in chain:
        before.append(min(20.0, max(-20.0, link.log_odds(own, before))))
    return [float(1 / (1 + np.exp(-x))) for x in before]


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> list[Link]:
    """The chain for categories (name to 0/1 column of labels), fitted on at most `sample` labelled documents.

    What comes to the driver is a set of 32-bit features for each of them, of one row where rows share an id. Of labels that
    share an id, each category counts by its largest value.
    """
    own = labels.select(F.col(key).cast("long").alias("_id"), *[c.cast("int").alias(n) for n, c in categories.items()]).where("_id IS NOT NULL")
    own = own.groupBy("_id").agg(*[F.max(n).alias(n) for n in categories])
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")).join(bounded(own), F.col("_doc") == F.col("_id")).select("_id", "_text", *categories.keys())

    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *[batch.column(2 + i) for i in range(len(names))]], names=["_id", "found", *names])

    made = rows.mapInArrow(run, "_id long, found binary, " + ", ".join(f"{n} int" for n in names))
    got = made.groupBy("_id", *names).agg(F.min("found").alias("found")).toArrow()  # of rows that share an id, one
    found = got["found"].combine_chunks() if got.num_rows else pa.array([], pa.binary())
    order = np.lexsort((np.array([xxhash.xxh32_intdigest(x.as_buffer()) for x in found], dtype=np.uint64), got["_id"].to_numpy()))
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    wide = np.array([len(x.as_buffer()) // 4 for x in found], np.int64)
    cols = np.frombuffer(b"".join(x.as_buffer() for x in found), np.uint32)
    given = {n: np.array([-1 if x is None else x for x in got[n].to_pylist()], dtype=int)[order] for n in names}
    del found, got
    chain = fit_chain(np.repeat(number, wide), cols, given)
    trimmed()
    return chain


def score(docs: DataFrame, chain: list[Link], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> for each link, and toxic: whether the last reaches the threshold; a row for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{link.name}" for link in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([score_chain(model.value, features(x.as_py())) for x in batch.column(1)]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(len(names))], pa.array(found[:, -1] >= threshold)], names=["doc_id", *names, "toxic"])
        trimmed()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def categories() -> dict[str, Column]:
    """The chain over the labels table: low quality first, then toxic."""
    return {"low_quality": (F.lit(1) - F.col("quality")), "toxic": F.col("toxic")}


def rate_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic for each row of docs.

    Null and empty texts have no features and get the intercepts' probability. Without labels nothing is toxic. Labels
    without documents, repeated labels (low quality or toxic if one of them says so) and null labels are no failure. Repeated rows each have their
    row; texts of any length are read whole; columns other than key and text are ignored, whatever their names; a table
    without rows gives none.
    """
    return score(docs, train(docs, labels, categories(), key=key, text=text), key, text)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are toxic, all columns as they were.

    Null and empty texts are judged by the intercepts; repeated rows are judged alike and all kept or dropped; texts of any
    length are read whole; a table without rows gives none.
    """
    chain = train(docs, labels, categories(), key=key, text=text)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield own.filter(pa.array([score_chain(model.value, features(x.as_py()))[-1] < THRESHOLD for x in own.column(at)], pa.bool_()))
        trimmed()

    return docs.mapInArrow(clean, docs.schema)
