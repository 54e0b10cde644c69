"""Token ids as raw binary shards with a minimal perfect hash index.

A shard file holds, in this order: the magic, the raw ids of all its documents one after another (little-endian, 16
bits where the vocabulary allows it, else 32), the directory (document keys and the id offset of each), the index and a
footer of fixed length that says where each part begins. The index is a minimal perfect hash over the distinct keys:
levels of bit sets, a key belongs to the first level where it alone hits its bit, and its slot is that bit's rank. Each
slot stores a fingerprint of its key and the key's place in the directory, so that keyed access reads a few bytes and
answers keys that were never stored. Keys that repeat lead to the first of their documents; null keys are not indexed.

Shards are cut by range of key, so that shard after shard the documents are in ascending key order (null first).
Writers put each try of a task into a file of its own; only files named in the manifest, a table that Spark commits,
count, so that lost executors and repeated tasks leave no trace.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import mix64, partitions, saved, scratch

MAGIC = b"CLTOKEN1"
_FOOTER = struct.Struct("<4sIQQQQQQ8s")  # width, levels, documents, keys, directory at, index at, length of null keys, ids, magic
_CACHE = 400_000  # a half of the words that an encoder keeps
_MARKS = re.escape("!#$%&()*+,-./:;=?@[]^_{|}~")
# Letters that the normaliser leaves as they are or changes to one other letter, whatever stands beside them.
_STEADY = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha() and all(unicodedata.normalize("NFC", x) == x for x in (c, c.lower())))
_OTHER = re.compile("[^\x00-\x7f" + "".join(c for c in _STEADY if c > "\x7f") + "]")
_BORDER = re.compile(f"(?<=[{_STEADY}])(?=[{_MARKS}])")
# The steps of a tokenizer that never joins text across spaces and splits letters from marks: fixed values of its format.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordEncoder:
    """Encodes whole texts; the ids equal those of the library on each text.

    A tokenizer of the known steps never joins text across spaces or line breaks, so words between those are encoded once
    and kept. As it also cuts letters from marks, a space is put between a steady letter and an ASCII mark, and texts
    without other letters are lower-cased, so that fewer words differ. Words go to the library many at once, with a digit
    that none of them has between them. With any other tokenizer, texts are encoded one by one.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # what is kept of words is kept here
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.end = array(self.kind, [end_id]).tobytes()
        steps = json.loads(self.tokenizer.to_str())
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = (steps["normalizer"] or {}).get("normalizers") == _NORMAL and split[0].get("pattern") == {"Regex": _SPLIT} and len(split) == 2 and not split[1].get("add_prefix_space",
            True) and all(x["special"] and "<" in x["content"] for x in steps["added_tokens"])
        self.bar = np.frombuffer(self._ids(["0"])[0], self.dtype)[0] if self.by_word else None
        self.newer: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Words and their raw ids."""
        plain = [x for x in words if "0" not in x]
        made, item = {}, self.dtype.itemsize
        for i in range(0, len(plain), 256):
            part = plain[i : i + 256]
            raw = self._ids([" 0 ".join(part)])[0]
            cuts = (np.flatnonzero(np.frombuffer(raw, self.dtype) == self.bar) * item).tolist()
            made |= zip(part, [raw[a:b] for a, b in zip([0, *(x + item for x in cuts)], [*cuts, len(raw)], strict=True)], strict=True)
        other = [x for x in words if "0" in x]
        for i in range(0, len(other), 4096):
            made |= zip(other[i : i + 4096], self._ids(other[i : i + 4096]), strict=True)
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """The raw ids of each text, the end id last."""
        if not self.by_word:
            return [x + self.end for x in self._ids(texts)]
        whole = [i for i, x in enumerate(texts) if "<|" in x]  # the strings of added tokens are cut out before all else
        if whole:
            out = self.encode([x if "<|" not in x else "" for x in texts])
            for i, x in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
                out[i] = x + self.end
            return out
        apart = [_BORDER.sub(" ", x) for x in texts]
        split = [(x if _OTHER.search(x) else x.lower()).replace("\n", " ").split(" ") for x in apart]
        needed = set().union(*split)
        missing = needed.difference(self.newer)
        if missing:
            again = missing & self.older.keys()
            known = self._learn(missing - again) | {x: self.older[x] for x in again}
            if len(self.newer) + len(known) > _CACHE:
                known |= {x: self.newer[x] for x in needed - missing}
                self.older, self.newer = self.newer, {}
            self.newer |= known
        get = self.newer.__getitem__
        return [b"".join(map(get, x)) + self.end for x in split]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, end_id: int) -> WordEncoder:
    """One encoder for each Python worker, whatever the number of its tasks."""
    return WordEncoder(path, end_id)


BLOCK = 512  # bits of the index between two stored ranks


class PerfectHash:
    """A minimal perfect hash of distinct uint64 keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.flags = np.unpackbits(bits, bitorder="little")
        self.ranks = np.concatenate([[0], np.cumsum(self.flags, dtype=np.int64)])

    def blocks(self) -> np.ndarray:
        """The rank at the begin of each block of BLOCK bits."""
        return self.ranks[:-1:BLOCK].astype("<u8")

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = -(-2 * len(left) // BLOCK) * BLOCK
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, np.uint8))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + self._at(keys[left], level, size)
            hit = self.flags[at] == 1
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype("<u4")


def write_shard(out, dtype: np.dtype, batches: Iterable[tuple[list[int | None], list[bytes]]]) -> tuple[int, int, int, int | None, int | None]:
    """Documents, ids, bytes, smallest and largest key of the shard written to the stream; keys come in ascending order, null first."""
    out.write(MAGIC)
    keys, counts, nulls = [], [], 0
    for own, ids in batches:
        out.write(b"".join(ids))
        nulls += sum(x is None for x in own)
        keys.append(np.array([0 if x is None else x for x in own], dtype="<i8"))
        counts.append(np.array([len(x) // dtype.itemsize for x in ids], dtype=np.int64))
    keys = np.concatenate(keys) if keys else np.empty(0, "<i8")
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype("<u8")
    directory = len(MAGIC) + int(offsets[-1]) * dtype.itemsize
    distinct, first = np.unique(keys[nulls:], return_index=True)
    index = PerfectHash.build(distinct.view(np.uint64))
    slots = index.slots(distinct.view(np.uint64))
    stored, places = np.empty(len(distinct), "<u4"), np.empty(len(distinct), "<u4")
    stored[slots], places[slots] = fingerprints(distinct.view(np.uint64)), first + nulls
    parts = [keys.tobytes(), offsets.tobytes()]
    at = directory + sum(map(len, parts))
    parts += [np.array(index.sizes, "<u8").tobytes(), index.bits.tobytes(), index.blocks().tobytes(), stored.tobytes(), places.tobytes()]
    parts.append(_FOOTER.pack(f"u{dtype.itemsize}  ".encode(), len(index.sizes), len(keys), len(distinct), directory, at, nulls, int(offsets[-1]), MAGIC))
    for x in parts:
        out.write(x)
    low, high = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
    return len(keys), int(offsets[-1]), at + sum(map(len, parts[2:])), low, high


class Shard:
    """Reads a shard file: by key in constant time, or one document after another.

    Opening reads the footer and the index's level sizes. `get` reads, for each level it has to try (two on average, few
    at most), one block of bits, then a rank, a fingerprint, a place, a key and two offsets; nothing that grows with the
    shard. The parts below `whole` are read at once when all documents are wanted.
    """

    def __init__(self, filesystem: pafs.FileSystem, path: str):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        width, levels, self.documents, self.n, self.directory, at, self.nulls, self.ids, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        self.dtype = np.dtype(f"<{width.decode().strip()}")
        self.sizes = np.frombuffer(self.file.read_at(8 * levels, at), "<u8").astype(np.int64).tolist()
        self.bits_at = at + 8 * levels
        self.ranks_at = self.bits_at + sum(self.sizes) // 8
        self.stored_at = self.ranks_at + sum(self.sizes) // BLOCK * 8
        self.places_at = self.stored_at + 4 * self.n

    def _numbers(self, kind: str, at: int, n: int = 1) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)

    @functools.cached_property
    def whole(self) -> tuple[np.ndarray, np.ndarray, PerfectHash, np.ndarray, np.ndarray]:
        """Keys, offsets, index, fingerprints and places of all documents."""
        keys, offsets = self._numbers("<i8", self.directory, self.documents), self._numbers("<u8", self.directory + 8 * self.documents, self.documents + 1)
        index = PerfectHash(self.sizes, self._numbers("u1", self.bits_at, sum(self.sizes) // 8))
        return keys, offsets.astype(np.int64), index, self._numbers("<u4", self.stored_at, self.n), self._numbers("<u4", self.places_at, self.n)

    def places_of(self, keys: np.ndarray) -> np.ndarray:
        """The directory place of each int64 key, -1 if it is not stored."""
        own, _, index, stored, places = self.whole
        keys = np.ascontiguousarray(keys, dtype=np.int64).view(np.uint64)
        if not self.n:
            return np.full(len(keys), -1, dtype=np.int64)
        slots = index.slots(keys)
        known = (slots >= 0) & (stored[slots] == fingerprints(keys))
        found = np.where(known, places[slots].astype(np.int64), -1)
        return np.where(known & (own[found].view(np.uint64) == keys), found, -1)

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first to last - 1 of the directory."""
        offsets = self.whole[1]
        return self._ids(int(offsets[first]), int(offsets[last]))

    def _ids(self, begin: int, end: int) -> np.ndarray:
        return self._numbers(self.dtype.str, len(MAGIC) + begin * self.dtype.itemsize, end - begin)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document of a key, None if there is none."""
        own, start = np.array([key], np.int64).view(np.uint64), 0
        for level, size in enumerate(self.sizes):
            bit = start + int(PerfectHash._at(own, level, size)[0])
            block, inside = divmod(bit, BLOCK)
            flags = np.unpackbits(self._numbers("u1", self.bits_at + block * BLOCK // 8, BLOCK // 8), bitorder="little")
            if flags[inside]:
                slot = int(self._numbers("<u8", self.ranks_at + 8 * block)[0]) + int(flags[:inside].sum())
                if self._numbers("<u4", self.stored_at + 4 * slot)[0] != fingerprints(own)[0]:
                    return None
                place = int(self._numbers("<u4", self.places_at + 4 * slot)[0])
                if self._numbers("<i8", self.directory + 8 * place)[0] != key:
                    return None
                begin, end = self._numbers("<u8", self.directory + 8 * (self.documents + place), 2).tolist()
                return self._ids(begin, end)
            start += size
        return None


_MANIFEST = "part int, path string, documents long, n_ids long, bytes long, low long, high long"


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The manifest: a row for each shard file written below the shared folder.

    tokenizer: the path of a file of the tokenizers library, the same on all machines. Null text counts as empty and
    gives the end id alone; documents with equal keys follow each other, by the checksum of their texts. An empty
    table gives no shard. Texts of any length are encoded whole; columns other than key and text are ignored, whatever
    their names. A key that repeats very often is dealt over several shards.
    """
    spark = docs.sparkSession
    root = scratch(spark, "token-shards")
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumns({"sum": F.crc32(F.col("t").cast("binary")), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(1024))})
    order = [F.col("k").asc_nulls_first(), "sum", "salt"]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = encoder_of(tokenizer, end_id)
        filesystem, folder = pafs.FileSystem.from_uri(root)
        filesystem.create_dir(folder)
        part = TaskContext.get().partitionId()
        path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.tok"

        def encoded():
            for batch in (first, *()):
                yield batch
            yield from batches

        def pieces():
            for batch in encoded():
                for i in range(0, batch.num_rows, 512):
                    own = batch.slice(i, 512)
                    yield own.column(0).to_pylist(), encoder.encode(own.column(1).to_pylist())

        with filesystem.open_output_stream(path) as out:
            n, ids, size, low, high = write_shard(out, encoder.dtype, pieces())
        names = ["part", "path", "documents", "n_ids", "bytes", "low", "high"]
        types = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, f"{root}/{path.rpartition('/')[2]}", n, ids, size, low, high), types, strict=True)], names=names)

    return saved(rows.mapInArrow(write, _MANIFEST), "token-manifest")


def located(shard: Shard) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """Keys, first id and ids of each document, up to 512 at once, read at the place the index gives for its key.

    The index leads to the first document of a key; those that repeat it follow there. Null keys are not in the index
    and come from the directory.
    """
    keys, offsets = shard.whole[:2]
    stored = keys[shard.nulls :]
    distinct, first, back = np.unique(stored, return_index=True, return_inverse=True)
    found = shard.places_of(distinct)
    if (found < 0).any():
        raise ValueError("a stored key is not in the index")
    places = np.concatenate([np.arange(shard.nulls), found[back] + np.arange(len(stored)) - first[back]])
    for i in range(0, shard.documents, 512):
        own = places[i : i + 512]
        if (np.diff(own) == 1).all():  # neighbours in the file are read at once
            ids = shard.read(int(own[0]), int(own[-1]) + 1).astype("<u4")
            ids = np.split(ids, offsets[own[1:]] - offsets[own[0]])
        else:
            ids = [shard.read(int(x), int(x) + 1).astype("<u4") for x in own]
        yield pa.array(keys[i : i + 512], pa.int64(), mask=np.arange(i, i + len(own)) < shard.nulls), offsets[own], ids


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document of the shards, found through their index.

    start: the number of ids of all documents before it in key order. Repeated keys and null keys each have their rows; an
    empty manifest gives none.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(*pafs.FileSystem.from_uri(uri))
                for keys, begins, ids in located(shard):
                    counts = np.array([len(x) for x in ids], np.int64)
                    sums = [zlib.crc32(x) for x in ids]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(begins + base), pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(partitions(manifest.sparkSession)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, key: int) -> np.ndarray | None:
    """The ids of one document, from the shards whose range holds its key."""
    for row in manifest.where((F.col("low") <= key) & (F.col("high") >= key)).select("path").collect():
        found = Shard(*pafs.FileSystem.from_uri(row.path)).get(key)
        if found is not None:
            return found
    return None
