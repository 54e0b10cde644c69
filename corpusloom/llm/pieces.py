"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into four machines, all of them arrays:

* the normaliser: rewriting arcs (longest match first) of the model's character map, space to the mark U+2581, and one
  mark put before the text;
* the piece machine: a trie, arcs (state, character, state), whose final states write a piece id at the piece's weight,
  its negative log-probability in a unigram model and 0 in a merge model;
* byte fallback: an arc for a character that no piece of one character holds; it writes the byte pieces of its UTF-8
  form, at the least piece score less 10 in a unigram model and 0 in a merge model;
* the pair machine of a merge model: (piece, piece) at weight 0 if merging the characters of both gives these two pieces
  again, and at infinite weight otherwise. It runs the merges of both pieces side by side and looks for a merge over
  their border. A sequence of pieces is what the merges give if and only if all its neighbours pass; thus, of the paths
  to a place, one is finite.

Composition with an input gives a lattice of arcs (place, place, piece, weight). Its states are places with the last
piece of the best path; the shortest path in the tropical semiring (minimum, plus) is relaxed place by place, for all
words of a batch at once. Of equal paths the one of the longer last piece is taken, as the library does.

No piece holds a mark behind another character, so texts are composed word by word; words met lately are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import trimmed

MARK = "▁"
LINE = "\x01\n"  # put before a line's first word, which has no mark
WORDS = 100_000  # a half of the words that a worker keeps
CHARACTERS = 400_000  # composed at once
KEPT_PAIRS = 1 << 19  # places of a worker's table of pairs
LONGEST = 64  # longer words are composed anew each time
UNIGRAM, MERGES = 1, 2
PENALTY = 10.0  # of a character without piece, below the least score: fixed by the library
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Arcs:
    """A map from int64 keys (two packed numbers) to int32, -1 where no arc is; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def character_map(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a model's character map: a double-array trie of UTF-8 keys, then the texts they become."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    rules, open_ = {}, [(0, b"")]
    while open_:
        at, key = open_.pop()
        base = at ^ (units[at] >> 10 << ((units[at] & 512) >> 6))
        if units[at] >> 8 & 1:
            begin = units[base] & 0x7FFFFFFF
            rules[key.decode("utf-8", "surrogatepass")] = texts[begin : texts.index(b"\0", begin)].decode()
        open_ += [(base ^ label, key + bytes([label])) for label in range(1, 256) if (base ^ label) < len(units) and units[base ^ label] & 0x800000FF == label]
    return rules


class Normaliser:
    """Rewrites a text by the longest rule that fits at each place, then its white space as the model says."""

    def __init__(self, rules: dict[str, str], trim: bool, prefix: bool):
        self.rules, self.trim, self.prefix = rules, trim, prefix
        self.reach: dict[str, int] = {}
        for x in rules:
            self.reach[x[0]] = max(len(x), self.reach.get(x[0], 0))

    def __call__(self, text: str) -> str:
        """The text with spaces for marks, without the mark put before it."""
        if self.rules and not self.reach.keys().isdisjoint(text):
            out, at = [], 0
            while at < len(text):
                for n in range(self.reach.get(text[at], 0), 0, -1):
                    found = self.rules.get(text[at : at + n])
                    if found is not None:
                        out.append(found)
                        at += n
                        break
                else:
                    out.append(text[at])
                    at += 1
            text = "".join(out)
        text = text.replace(MARK, " ")
        return " ".join(x for x in text.split(" ") if x) if self.trim else text


class PieceTransducer:
    """The machines of one model file; what it keeps of words and pairs stays in its process."""

    def __init__(self, path: str | None = None, model: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto, kinds = pb.ModelProto(), pb.ModelProto.SentencePiece
        if model is None:
            with open(path, "rb") as file:
                model = file.read()
        proto.ParseFromString(model)
        spec, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, MERGES) or not proto.trainer_spec.byte_fallback or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only unigram and merge models with byte fallback and a mark before the text")
        self.normal = Normaliser(character_map(spec.precompiled_charsmap), spec.remove_extra_whitespaces, True)
        ids, back, self.bytes = {}, [], np.zeros(256, np.int32)
        for i, piece in enumerate(proto.pieces):
            back.append(piece.piece.replace(MARK, " ").encode())
            if piece.type == kinds.BYTE:
                value = int(piece.piece[1:-1], 16)
                self.bytes[value], back[i] = i, bytes([value])
            elif piece.type == kinds.NORMAL:
                ids[piece.piece] = i
            elif piece.type == kinds.USER_DEFINED:
                raise ValueError("pieces that a user defined are not supported")
            else:
                back[i] = b""
        if any(MARK in x.lstrip(MARK) for x in ids):
            raise ValueError("pieces reach over words")
        self.size, self.lines = len(proto.pieces), not any("\n" in x for x in ids)
        self.lengths = np.array([len(x) for x in back], np.int64)
        self.begins, self.blob = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(back), np.uint8)
        scores = {x: np.float32(proto.pieces[i].score) for x, i in ids.items()}
        self.weights = np.zeros(self.size + 1, np.float32)  # the last is byte fallback
        if self.kind == UNIGRAM:
            self.weights[list(ids.values())] = [-scores[x] for x in ids]
            self.weights[-1] = PENALTY - min(scores.values(), default=0)
        steps = self._merges(ids, scores) if self.kind == MERGES else None
        self._trie({x: i for x, i in ids.items() if steps is None or len(steps[x][-1]) == 1})
        self._forget()

    def _forget(self) -> None:
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seen = np.full(KEPT_PAIRS, -2, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("newer", "older", "seen")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def _trie(self, pieces: dict[str, int]) -> None:
        """The piece machine: `classes` of characters, arcs, and the piece that a state ends."""
        letters = sorted(set("".join(pieces)))
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        states = {"": 0}
        for x in pieces:
            for n in range(1, len(x) + 1):
                states.setdefault(x[:n], len(states))
        walked = [x for x in states if x]
        keys = np.array([states[x[:-1]] << 16 | int(self.classes[ord(x[-1])]) for x in walked], np.int64)
        self.arcs = Arcs(keys, np.array([states[x] for x in walked], np.int32))
        self.ends = np.full(len(states), -1, np.int32)
        self.ends[[states[x] for x in pieces]] = list(pieces.values())

    def _merges(self, ids: dict[str, int], scores: dict) -> dict[str, list[list[str]]]:
        """The pair machine: for each piece the symbols at its ends after each merge and the score of the next one."""
        if any(c not in ids for x in ids for c in x):
            raise ValueError("a character of a piece is no piece")
        steps, first, last, next_ = {}, [self.size], [self.size], [-np.inf]
        self.state = np.zeros(self.size + 1, np.int64)  # byte fallback has state 0
        for x in ids:
            parts = list(x)
            steps[x] = [parts]
            self.state[ids[x]] = len(first)
            while True:
                found = [scores.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]  # noqa: B905
                best = max(found, default=-np.inf)
                first.append(ids[parts[0]])
                last.append(ids[parts[-1]])
                next_.append(best)
                if best == -np.inf:
                    break
                at = found.index(best)
                parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            steps[x] = [parts]
        self.first, self.last, self.next = np.array(first, np.int64), np.array(last, np.int64), np.array(next_, np.float32)
        cuts = [(ids[x[:n]], ids[x[n:]], i) for x, i in ids.items() for n in range(1, len(x)) if x[:n] in ids and x[n:] in ids]
        self.joins = Arcs(np.array([a << 32 | b for a, b, _ in cuts], np.int64), np.array([i for _, _, i in cuts], np.int32))
        self.scores = np.full(self.size, -np.inf, np.float32)
        self.scores[list(ids.values())] = [scores[x] for x in ids]
        return steps

    def _side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b leaves the two pieces."""
        i, j, out, live = self.state[a], self.state[b], np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = self.next[i[live]], self.next[j[live]]
            join = self.joins.get(self.last[i[live]] << 32 | self.first[j[live]])
            score = np.where(join >= 0, self.scores[join], -np.inf)
            over = (join >= 0) & (score > x) & (score >= y)  # the leftmost of equal scores is merged first
            out[live[over]] = False
            on = ~over & ~(np.isneginf(x) & np.isneginf(y))
            live, left = live[on], (x >= y)[on]
            i[live] += left
            j[live] += ~left
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pair machine lets piece b follow piece a."""
        key = a.astype(np.int64) * (self.size + 1) + b
        slot = (key.astype(np.uint64) * _ODD >> np.uint64(64 - KEPT_PAIRS.bit_length() + 1)).astype(np.int64)
        held = self.seen[slot]
        out = (held & 1).astype(bool)
        missed = np.flatnonzero(held >> 1 != key)
        if len(missed):
            fresh, at, back = np.unique(key[missed], return_index=True, return_inverse=True)
            got = self._side_by_side(fresh // (self.size + 1), fresh % (self.size + 1))
            self.seen[slot[missed[at]]] = fresh << 1 | got
            out[missed] = got[back]
        return out

    def lattice(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The input composed with the piece machine and byte fallback: source, target, piece of each arc.

        points: the characters of all words in a row; ends: for each of them, where its word ends. Arcs come by length.
        """
        letters, at = self.classes[points], np.arange(len(points), dtype=np.int32)
        state, place = np.zeros(len(points), np.int32), at
        source, target, piece = [], [], []
        while len(at):
            state = self.arcs.get(state.astype(np.int64) << 16 | letters[place])
            on = state >= 0
            at, state, place = at[on], state[on], place[on] + 1
            final = self.ends[state]
            if not source:  # one character: fallback where none ends here
                other = np.ones(len(points), bool)
                other[at[final >= 0]] = False
                lone = np.flatnonzero(other).astype(np.int32)
                source.append(lone)
                target.append(lone + 1)
                piece.append(np.full(len(lone), self.size, np.int32))
            hit = final >= 0
            source.append(at[hit])
            target.append(place[hit])
            piece.append(final[hit])
            on = place < ends[at]
            at, state, place = at[on], state[on], place[on]
        return np.concatenate(source), np.concatenate(target), np.concatenate(piece)

    def shortest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the shortest path of each normalised word, all in a row, and how many each word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.array([len(x) for x in words], np.int64)
        stop = np.cumsum(counts)
        begin = stop - counts
        owner = np.repeat(np.arange(len(words)), counts)
        source, target, piece = self.lattice(points, stop[owner])
        # a word's states are its places 0 to n; as words follow each other, state 0 of a word is kept apart from the last of the one before
        depth = target - begin[owner[source]]
        order = np.lexsort((source, depth))  # of arcs to one place, the longest first
        source, target, piece, depth = source[order], target[order], piece[order], depth[order]
        least, last, came = np.full(len(points) + 1, np.inf, np.float32), np.full(len(points) + 1, -1, np.int32), np.full(len(points) + 1, -1, np.int64)
        starts = source == begin[owner[source]]
        cuts = np.flatnonzero(np.diff(depth, prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(depth))):  # noqa: B905
            s, t, p, fresh = source[low:high], target[low:high], piece[low:high], starts[low:high]
            cost = np.where(fresh, np.float32(0), least[s]) + self.weights[p]
            if self.kind == MERGES:
                check = np.flatnonzero(~fresh & np.isfinite(cost))
                cost[check[~self.follows(last[s[check]], p[check])]] = np.inf
            open_ = np.flatnonzero(np.isfinite(cost))
            by = open_[np.lexsort((cost[open_], t[open_]))]  # stable: of equal costs the longest arc stays first
            best = by[np.flatnonzero(np.diff(t[by], prepend=-1))]
            least[t[best]], last[t[best]], came[t[best]] = cost[best], p[best], low + best
        found, live, at = [], np.flatnonzero(counts), stop[counts > 0]
        while len(live):
            arc = came[at]
            if (arc < 0).any():
                raise ValueError("a word without path")
            found.append(arc)
            at = source[arc]
            on = at > begin[live]
            live, at = live[on], at[on]
        arcs = np.concatenate(found) if found else np.empty(0, np.int64)
        arcs = arcs[np.argsort(source[arcs])]
        return self._written(piece[arcs], points[source[arcs]], owner[source[arcs]], len(words))

    def _written(self, pieces: np.ndarray, points: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte fallback's arcs replaced by the byte pieces of their character."""
        lone = pieces == self.size
        if lone.any():
            point = points.astype(np.int64)
            wide = np.where(lone, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
            nth = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            each, point, lone, pieces, owner = (np.repeat(x, wide) for x in (wide, point, lone, pieces, owner))
            bits = point >> 6 * (each - 1 - nth)
            head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[each]
            value = np.where(nth > 0, 0x80 | bits & 0x3F, np.where(each > 1, head | bits, bits))
            pieces = np.where(lone, self.bytes[np.where(lone, value, 0)], pieces)
        return pieces.astype(np.int32), np.bincount(owner, minlength=words)

    def _cut(self, text: str) -> list[str]:
        """The words of a normalised text; a run of spaces belongs to the word behind it, a line begins with LINE."""
        if not text:
            return []
        if not self.lines or "\x01" in text:  # one word, its mark put before it already
            return ["\x01" + MARK + text.replace(" ", MARK)]
        words = text.replace("\n", f" {LINE}").split(" ")
        if "" not in words:
            return words
        joined, marks = [], 0
        for word in words:
            if word.startswith(LINE):
                if marks:
                    joined.append(MARK * (marks - 1))
                joined.append(word)
                marks = 0
            elif word:
                joined.append(MARK * marks + word)
                marks = 0
            else:
                marks += 1
        return joined + [MARK * (marks - 1)] * bool(marks)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Words and the ids of their paths, as bytes."""
        order, made, at = sorted(words, key=len), {}, 0
        while at < len(order):
            most = at + 1
            size = len(order[at])
            while most < len(order) and size < CHARACTERS:
                size += len(order[most])
                most += 1
            own = order[at:most]
            ids, counts = self.shortest([x[1:] if x[:1] == "\x01" else MARK + x for x in own])
            raw, stops = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            made |= zip(own, (raw[a:b] for a, b in zip([0, *stops], stops)), strict=True)  # noqa: B905
            at = most
        return made

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and how many each has; an empty text has none."""
        split = [self._cut(self.normal(x)) for x in texts]
        missing = set().union(*split).difference(self.newer)
        extra = {}
        if missing:
            again = missing & self.older.keys()
            fresh = self._learn(missing - again)
            extra = {x: y for x, y in fresh.items() if len(x) > LONGEST}
            kept = {x: self.older[x] for x in again} | {x: y for x, y in fresh.items() if len(x) <= LONGEST}
            if len(self.newer) + len(kept) > WORDS:
                self.older, self.newer = self.newer, {}
                extra |= {x: self.older[x] for x in set().union(*split) if x in self.older}
            self.newer |= kept
        get = (self.newer | extra if extra else self.newer).__getitem__
        found = [b"".join(map(get, x)) for x in split]
        return np.frombuffer(b"".join(found), np.int32), np.array([len(x) // 4 for x in found], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids, without the mark put before it."""
        wide = self.lengths[ids]
        stops = np.cumsum(wide)
        raw = self.blob[np.repeat(self.begins[ids] - (stops - wide), wide) + np.arange(stops[-1] if len(stops) else 0)].tobytes()
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        found = [raw[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905
        return [x[1:] if x.startswith(b" ") else x for x in found]


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, round_trip for each row of docs, also for each of repeated rows; other columns are ignored.

    model: the path of a SentencePiece file; the driver compiles it and sends the machines. Null and empty texts give no
    ids. round_trip: decoding the ids gives the normalised text again (with U+2581 as a space). Texts of any length are
    encoded whole; a word without spaces is one path, relaxed place by place. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceTransducer(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own = batch.slice(i, 256)
                texts = [x or "" for x in own.column(1).to_pylist()]
                ids, counts = machine.encode(texts)
                same = [a == machine.normal(b).encode("utf-8", "surrogatepass") for a, b in zip(machine.decode(ids, counts), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([own.column(0), lists, pa.array(counts), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])
        trimmed()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceTransducer(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own = batch.slice(i, 256)
                ids = [x or [] for x in own.column(1).to_pylist()]
                found = machine.decode(np.array([y for x in ids for y in x], np.int64), np.array([len(x) for x in ids], np.int64))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([x.decode("utf-8", "surrogatepass") for x in found], pa.string())], names=["doc_id", "text"])
        trimmed()

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
