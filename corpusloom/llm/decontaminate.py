"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and white space runs become one space. Each benchmark item is cut into windows of WINDOW
characters, STEP apart (a shorter item is one window), so any piece of WINDOW + STEP - 1 = 79 characters of an item holds
a full window; shorter pieces are found where they hold one. A window with at most e edits in a document keeps at least
n + 1 - Q * (e + 1) of its n + 1 - Q q-grams, and the diagonals of these differ by at most e. e is the most edits at which
half of the window's q-grams must stay, EDITS = 4 for a full window. So a document's q-grams are looked up in the windows'
and hits counted in diagonal bands that are 2 * (EDITS + 1) wide and overlap by half, so that some band holds all hits of
a match. Hits are first counted for the whole item, of which a window's are a part; where those reach the least bound,
they are counted again for each window. Windows that reach their own bound are verified by banded alignment, free to
begin and end anywhere in the band.

The benchmark is written to the shared folder in blocks of at most `block_bytes` of text. Documents are read once: a task
gathers up to HELD bytes of texts and searches them in one block after the other, of which it holds one at a time; a
benchmark of one block stays indexed in the worker.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import saved, scratch, trimmed
from corpusloom.llm.near_dup import bounded

Q, WINDOW, STEP = 6, 64, 16
EDITS = (WINDOW - Q) // (2 * Q)
HELD = 24 << 20
BLOCK_BYTES = 4 << 20
_B = np.uint32(0x01000193)
_B2 = np.uint32(0x01000193**2 % (1 << 32))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(x: np.ndarray) -> np.ndarray:
    """A 32-bit code of the Q = 6 characters that begin at each place."""
    if len(x) < Q:
        return np.empty(0, np.uint32)
    two = x[:-1] * _B + x[1:]
    four = two[:-2] * _B2 + two[2:]
    six = four[:-2] * _B2 + two[4:]
    return (six ^ (six >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """counts[i] numbers from starts[i] on, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Windows:
    """The windows of a block of items; the items indexed by q-gram."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items, self.texts, begins, codes, owners, covers, counts = [], [], [], [], [], [], []
        longest = 0
        for number, (item, text) in enumerate(items):
            x = _points(normal(text))
            if len(x) < Q:
                continue
            longest = max(longest, len(x))
            code = grams(x)
            codes.append(code)
            owners.append(np.stack([np.full(len(code), number), np.arange(len(code))]))
            last = max(0, len(x) - WINDOW)
            starts = np.array(sorted({*range(0, last, STEP), last}))
            place = np.arange(len(code))
            within = (starts[:, None] <= place) & (place <= starts[:, None] + min(WINDOW, len(x)) - Q)
            gram, window = np.nonzero(within.T)
            covers.append(window + len(self.texts))
            counts.append(np.bincount(gram, minlength=len(code)))
            begins.append(starts)
            self.items += [item] * len(starts)
            self.texts += [x[i : i + WINDOW] for i in starts]
        lengths = np.array([len(x) for x in self.texts], dtype=np.int64)
        self.begins = np.concatenate(begins) if begins else np.empty(0, np.int64)
        self.edits = np.minimum(EDITS, np.maximum(0, (lengths - Q) // (2 * Q)))
        self.needed = lengths + 1 - Q * (self.edits + 1)
        self.least = int(self.needed.min()) if len(lengths) else 0
        self.lift = longest + EDITS + 1  # keeps diagonals and bands positive
        code = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        self.owners = np.concatenate(owners, axis=1) if owners else np.empty((2, 0), np.int64)
        self.covers = np.concatenate(covers) if covers else np.empty(0, np.int64)
        self.cover_counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
        self.cover_starts = np.cumsum(self.cover_counts) - self.cover_counts
        self.order = np.argsort(code, kind="stable")
        self.codes, self.starts = np.unique(code[self.order], return_index=True)
        self.starts = np.append(self.starts, len(code))
        self.shift = np.uint32(32 - 20)
        self.flags = np.zeros(1 << 20, np.uint8)
        self.flags[self.codes >> self.shift] = 1

    def search(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, begin, end, edits) of matches in the code points x, one for each window and band that verifies."""
        code = grams(x)
        if not len(code) or not len(self.codes):
            return []
        span = WINDOW + EDITS
        flagged = self.flags.take(code >> self.shift)
        total = np.zeros(len(code) + span + 1, np.int32)
        np.cumsum(flagged, dtype=np.int32, out=total[1 : len(code) + 1])
        total[len(code) + 1 :] = total[len(code)]
        dense = total[span:-1] - total[: len(code)] >= self.least  # a match may begin here
        if not dense.any():
            return []
        near = np.zeros(len(code) + span + 1, np.int32)
        begins = np.flatnonzero(dense)
        near[begins] = 1
        near[begins + span] -= 1
        spots = np.flatnonzero((np.cumsum(near[: len(code)]) > 0) & (flagged == 1))
        at = np.searchsorted(self.codes, code[spots])
        at[at == len(self.codes)] = 0
        hit = self.codes[at] == code[spots]
        spots, at = spots[hit], at[hit]
        n = self.starts[at + 1] - self.starts[at]
        if not n.sum():
            return []
        gram = self.order[_ranges(self.starts[at], n)]
        item, offset = self.owners[0][gram], self.owners[1][gram]
        band = (np.repeat(spots, n) - offset + self.lift) // (EDITS + 1)
        key = item << 40 | band
        both = (key, key - 1)  # the band of the diagonal and the one that overlaps it
        bins = [(((keys >> 40) * 0x9E3779B1 + keys) & 0xFFFFF).astype(np.int32) for keys in both]
        full = sum(np.bincount(x, minlength=1 << 20) for x in bins) >= self.least  # most keys share no bin with as many hits as a match has
        spots = [np.flatnonzero(full[x]) for x in bins]
        kept = [(keys[x], x) for keys, x in zip(both, spots, strict=True)]
        return self._counted(x, gram, kept)

    def _counted(self, x: np.ndarray, gram: np.ndarray, kept: list) -> list[tuple[int, int, int, int]]:
        """Hits by band of an item, then by window; kept: for both bands the keys, and the hits that have them."""
        keys, hits = (np.concatenate(y) for y in zip(*kept, strict=True))
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        good = np.flatnonzero((counts >= self.least)[back])
        keys, gram = keys[good], gram[hits[good]]
        n = self.cover_counts[gram]
        window = self.covers[_ranges(self.cover_starts[gram], n)]
        band = np.repeat(keys & ((1 << 40) - 1), n)
        found, counts = np.unique(window << 40 | band, return_counts=True)
        window, band = found >> 40, found & ((1 << 40) - 1)
        good = counts >= self.needed[window]
        window, band = window[good], band[good]
        return self._verify(x, window, band * (EDITS + 1) - self.lift + self.begins[window])

    def _verify(self, x: np.ndarray, window: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Banded alignment; low: the band's lowest diagonal."""
        out = []
        lengths = np.array([len(self.texts[w]) for w in window], dtype=np.int64)
        margin, width = EDITS, 2 * (EDITS + 1) + 2 * EDITS
        steps = np.arange(width)
        padded = np.concatenate([x, [np.uint32(0xFFFFFFFF)]])
        for length in np.unique(lengths):
            mine = np.flatnonzero(lengths == length)
            for part in (mine[i : i + 4096] for i in range(0, len(mine), 4096)):
                pattern = np.stack([self.texts[w] for w in window[part]])
                column = (low[part] - margin)[:, None] + steps  # text place compared in row 0
                cost = np.zeros((len(part), width), np.int32)
                for r in range(int(length)):
                    place = column + r
                    place = np.where((place >= 0) & (place < len(x)), place, len(x))
                    change = cost + (padded[place] != pattern[:, r, None])
                    change[:, :-1] = np.minimum(change[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(change - steps, axis=1) + steps
                end = cost.argmin(axis=1)
                edits = cost[np.arange(len(part)), end]
                for i in np.flatnonzero(edits <= self.edits[window[part]]):
                    stop = int(column[i, end[i]] + length)
                    out.append((int(window[part][i]), max(0, stop - int(length)), min(stop, len(x)), int(edits[i])))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, windows, edits, begin, end: a row for each document row and item of which a window is in it.

    windows: how many of the item's windows were found; edits: of the best of them; begin and end: what they span in the
    normalised text. Null, empty and very short items (under Q characters) are in no document; equal items are each
    reported; null item ids are one item. Rows of docs that repeat are each reported; null and empty texts hold nothing,
    and of a table without rows none are. Columns other than key and text are ignored, whatever their names. Texts of any
    length are searched whole; an item of Q characters or more is found wherever its letters stand, inside of words too.
    """
    paths = _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), block_bytes)
    gap = "\0" * (WINDOW + 4 * EDITS)

    def search(windows: Windows, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (batch.slice(i, 128) for batch in batches for i in range(0, batch.num_rows, 128)):
            texts = [normal(x) for x in own.column(1).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) + len(gap) for x in texts])])
            best: dict = defaultdict(list)
            for window, begin, end, edits in windows.search(_points(gap.join(texts))):
                doc = int(np.searchsorted(starts, end - 1, "right")) - 1  # begin may fall before the document
                size = len(texts[doc])
                best[doc, windows.items[window]].append((window, max(0, begin - int(starts[doc])), min(size, end - int(starts[doc])), edits))
            if best:
                ids = own.column(0).to_pylist()
                made = [(ids[d], item, len({m[0] for m in x}), min(m[3] for m in x), min(m[1] for m in x), max(m[2] for m in x)) for (d, item), x in sorted(best.items(), key=lambda y: (y[0][0], str(y[0][1])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["doc_id", "item_id", "windows", "edits", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD or len(paths) == 1:
                for path in paths:
                    yield from search(_windows(path, len(paths) == 1), held)
                held, size = [], 0
        if held:
            for path in paths:
                yield from search(_windows(path, len(paths) == 1), held)
        trimmed()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, item_id long, windows long, edits long, begin long, end long")


_kept: dict[str, Windows] = {}


def _windows(path: str, keep: bool) -> Windows:
    """The index of a block's file; the last one of a benchmark of one block is kept."""
    if path in _kept:
        return _kept[path]
    filesystem, name = pafs.FileSystem.from_uri(path)
    with filesystem.open_input_file(name) as file, pa.ipc.open_file(file) as block:
        table = block.read_all()
    found = Windows(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)))
    if keep:
        _kept.clear()
        _kept[path] = found
    return found


def _blocks(benchmark: DataFrame, limit: int) -> list[str]:
    """Paths of the files that hold the benchmark; one partition of it at a time is with the driver."""
    root = scratch(benchmark.sparkSession, "benchmark")
    filesystem, folder = pafs.FileSystem.from_uri(root)
    filesystem.create_dir(folder)
    paths, block, size = [], [], 0

    def close() -> None:
        paths.append(f"{root}/{len(paths)}.arrow")
        table = pa.table({"item_id": pa.array([x[0] for x in block], pa.int64()), "text": pa.array([x[1] for x in block], pa.string())})
        with filesystem.open_output_stream(f"{folder}/{len(paths) - 1}.arrow") as file, pa.ipc.new_file(file, table.schema) as out:
            out.write_table(table)

    for row in benchmark.toLocalIterator():
        more = 4 * len(row[1] or "")
        if block and size + more > limit:
            close()
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        close()
    return paths


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a window of a benchmark item; a document without id is kept only if none such leaks.

    Null and empty texts are kept; all columns stay as they were, repeated rows too; texts of any length are searched whole;
    a table without rows gives none, and without benchmark items all rows stay.
    """
    ids = saved(find_leaks(docs, benchmark, key, text).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(bounded(ids), F.col(key).eqNullSafe(F.col("_leak")), "left_anti")
