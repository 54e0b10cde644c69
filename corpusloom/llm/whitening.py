"""Embedding whitening by hierarchical merging of singular value decompositions.

Vectors are put on an integer grid, and each distinct one counts once. A task decomposes its vectors batch by batch: it
keeps their number, their exact sums and all singular values and right vectors of the centred batch. Two such states merge
into one: the scaled vectors of both are stacked, a row for the difference of the means is appended, and the stack is
decomposed again, so that nothing is lost and no vector is needed twice. States of tasks merge FAN at a time, level by
level, in tasks; a state has as many numbers as a covariance matrix, whatever the number of vectors, and products of
vectors are never added up, so no digits are lost to large means.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import MAX_BROADCAST_BYTES, forget, saved, trimmed

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: States that one task of a level merges, one after another.
FAN = 8
#: Entries beyond this are held at it, so that sums stay exact.
LARGEST = 1 << 53
_STATE = "dim int, no long, n long, sums array<decimal(38,0)>, singular binary, vectors binary"

State = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # n, sums (Python ints), singular values, right vectors


def quantised(vectors: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * c) + offset as int64."""
    return np.clip(np.floor(scale * vectors.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64) + offset


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right singular vectors, at most as many as columns."""
    if rows.shape[0] > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def summary(x: np.ndarray) -> State:
    """The state of integer vectors, one in each row."""
    n = len(x)
    sums = np.array([int(h) * (1 << 24) + int(r) for h, r in zip((x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0), strict=True)], dtype=object)
    near = np.array([s // n for s in sums], dtype=np.int64)
    rest = ((sums - n * near.astype(object)) / n).astype(np.float64)
    return n, sums, *_decomposed((x - near).astype(np.float64) - rest)


def merged(a: State, b: State) -> State:
    """The state of both states' vectors: scaled vectors below each other, and one row that corrects the means."""
    n = a[0] + b[0]
    apart = ((a[1] * b[0] - b[1] * a[0]) / (a[0] * b[0])).astype(np.float64)
    stack = np.vstack([a[2][:, None] * a[3], b[2][:, None] * b[3], np.sqrt(a[0] / n * b[0]) * apart[None, :]])
    return n, a[1] + b[1], *_decomposed(stack)


def _packed(dim: int, no: int, state: State) -> list:
    return [dim, no, state[0], [Decimal(int(s)) for s in state[1]], state[2].tobytes(), np.ascontiguousarray(state[3]).tobytes()]


def _unpacked(row: dict) -> State:
    return row["n"], np.array([int(s) for s in row["sums"]], dtype=object), np.frombuffer(row["singular"]), np.frombuffer(row["vectors"]).reshape(-1, row["dim"])


def _rows(found: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)


def _state_rows(found: list[list]) -> pa.RecordBatch:
    return _rows(found, ["dim", "no", "n", "sums", "singular", "vectors"], [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.binary(), pa.binary()])


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, matrix) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, flat[starts[at][:, None] + np.arange(dim)[None, :]]


def fit_list(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """x array<long>: each distinct vector of the grid once. Copies go before the shuffle, so a common vector is no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, own in _by_dim(batch.column(0)):
                x = np.unique(quantised(own, scale, offset), axis=0)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))], names=["x"])

    return vectors.select(vector).mapInArrow(run, "x array<long>").distinct()


def _summaries(fit: DataFrame) -> DataFrame:
    """One state for each task and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[int, State] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch.column(0)):
                states[dim] = merged(states[dim], summary(x)) if dim in states else summary(x)
        if states:
            yield _state_rows([_packed(dim, TaskContext.get().partitionId(), s) for dim, s in states.items()])
        trimmed()

    return fit.mapInArrow(run, _STATE)


def _level(states: DataFrame) -> DataFrame:
    """States merged FAN at a time, in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["dim"], row["no"] // FAN)
                if at == here:
                    state = merged(state, _unpacked(row))
                    continue
                if at is not None:
                    yield _state_rows([_packed(*at, state)])
                at, state = here, _unpacked(row)
        if at is not None:
            yield _state_rows([_packed(*at, state)])

    return states.repartition("dim", F.floor(F.col("no") / FAN)).sortWithinPartitions("dim", "no").mapInArrow(run, _STATE)


def merge_states(states: DataFrame) -> DataFrame:
    """One state for each dimension, merged level by level; each level is written to the shared folder."""
    states = saved(states, "states")
    while (states.agg(F.max("no")).first()[0] or 0) > 0:
        last, states = states, saved(_level(states), "states")
        forget(last)
    return states


def _models(root: DataFrame, components: int) -> dict[int, dict]:
    """n, sums, leading vectors and eigenvalues of each dimension; numbers of a few vectors come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, sums, values, vectors = _unpacked(row)
                e = np.where(values > (values.max(initial=0) * max(vectors.shape) * np.finfo(float).eps), values**2 / n, 0.0)
                k = min(components, row["dim"])
                top, lead = np.zeros((k, row["dim"])), np.zeros(k)
                top[: len(vectors)], lead[: len(e)] = vectors[:k], e[:k]
                sign = np.sign(top[np.arange(k), np.abs(top).argmax(axis=1)])
                top *= np.where(sign == 0, 1, sign)[:, None]
                yield _rows([[row["dim"], n, row["sums"], top.tobytes(), lead.tolist(), float(e.sum())]], ["dim", "n", "sums", "vectors", "e", "trace"],
                    [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.binary(), pa.list_(pa.float64()), pa.float64()])

    found = root.mapInArrow(run, "dim int, n long, sums array<decimal(38,0)>, vectors binary, e array<double>, trace double")
    if (found.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0) > MAX_BROADCAST_BYTES:
        raise ValueError("the leading components are larger than what may be sent to every task")
    out = {}
    for row in found.collect():
        sums = np.array([int(s) for s in row.sums], dtype=object)
        near = np.array([s // row.n for s in sums], dtype=np.int64)
        over = sums - row.n * near.astype(object)  # from 0 to n - 1
        e = np.array(row.e)
        out[row.dim] = {"n": row.n, "near": near, "over": over.astype(np.int64), "rest": (over / row.n).astype(np.float64), "vectors": np.frombuffer(row.vectors).reshape(-1, row.dim), "e": e,
            "over_e": np.divide(1.0, np.sqrt(e), out=np.zeros_like(e), where=e > 0), "trace": row.trace}
    return out


def _whitened(x: np.ndarray, model: dict) -> np.ndarray:
    return (((x - model["near"]).astype(np.float64) - model["rest"]) @ model["vectors"].T) * model["over_e"]


def _identity_errors(fit: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    """For each dimension, the largest absolute entry of the whitened vectors' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch.column(0)):
                w = _whitened(x, models[dim])
                w = np.hstack([w, np.ones((len(w), 1))])
                totals[dim] = totals.get(dim, 0) + w.T @ w
        for dim, total in totals.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, dim, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
                names=["dim", "i", "j", "v"])

    sums = fit.mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = {}
    for dim, model in models.items():
        k, n = len(model["e"]), model["n"]
        total = np.zeros((k + 1, k + 1))
        for row in sums:
            if row.dim == dim:
                total[row.i, row.j] = row.v
        mean, used = total[:k, k] / n, model["e"] > 0
        apart = (total[:k, :k] / n - np.outer(mean, mean) - np.eye(k))[np.ix_(used, used)]
        out[dim] = float(np.abs(apart).max(initial=0.0))
    return out


def _deviation(x: np.ndarray, model: dict) -> np.ndarray | list[int]:
    """Exact sums of (n * x - S) ** 2: int64 where it cannot overflow, Python ints otherwise."""
    apart = x - model["near"]
    bound = model["n"] * (int(np.abs(apart).max(initial=0)) + 1)
    if bound * bound * max(1, x.shape[1]) < 1 << 62:
        return ((model["n"] * apart - model["over"]) ** 2).sum(axis=1)
    return ((model["n"] * apart.astype(object) - model["over"].astype(object)) ** 2).sum(axis=1).tolist()


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide: a row for each row of vectors and component.

    Dropped are rows whose vector is null or holds a null, NaN or infinite entry. The others become integers x; n and S
    are the number and the sums of the distinct x, whose covariance has the components, numbered from 1 by falling
    eigenvalue e, the largest entry of each positive. deviation: sum of (n * x - S) ** 2, null where no long holds it;
    deviation_wide: the same as decimal(38, 0). whitened: x - S / n on the component over sqrt(e); null for a component
    without variance, as a table of one distinct vector has. explained: e over the sum of all, null where that is 0. identity_error: one
    value, over the components with variance.

    Vectors of each length are fitted on their own; empty ones have no components and no rows. Repeated rows each get
    their rows; a null key stays null. Entries beyond 2 ** 53 are held there. Other columns are ignored, whatever their names; a table
    without rows gives none.
    """
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad)
    fit = saved(fit_list(rows, "vector", scale, offset), "fit")
    root = merge_states(_summaries(fit))
    models = _models(root, components)
    errors = _identity_errors(fit, models)
    forget(root, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                for dim, at, own in _by_dim(part.column(1)):
                    model, x = models[dim], quantised(own, scale, offset)
                    k, m = len(model["e"]), len(x)
                    off = _deviation(x, model)
                    narrow = pa.array(off) if isinstance(off, np.ndarray) else pa.array([v if v < 1 << 63 else None for v in off], pa.int64())
                    wide = narrow.cast(pa.decimal128(38, 0)) if isinstance(off, np.ndarray) else pa.array([Decimal(v) if v < 10**38 else None for v in off], pa.decimal128(38, 0))
                    each = pa.array(np.repeat(np.arange(m), k))
                    none = np.tile(model["e"] <= 0, m)
                    share = model["e"] / model["trace"] if model["trace"] > 0 else np.zeros(k)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model["n"])), narrow.take(each),
                        pa.array(_whitened(x, model).ravel(), mask=none), pa.array(np.tile(share, m), mask=np.full(m * k, not model["trace"] > 0)), pa.array(np.full(m * k, errors[dim])), wide.take(each),
                    ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"])
        trimmed()

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)")
