"""Operators against brute force, exact round trips and held-out accuracy on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import decontaminate, fingerprint, language_model, near_dup, pieces, sharding, token_shards, toxicity, url_filter, warc

P = pytest.importorskip("public_tokenizers")
ODD = [(1, "One two three four five six"), (2, None), (3, ""), (4, "   \n "), (5, "a"), (6, "ONE two three four five six"), (6, "ONE two three four five six"), (7,
    "日本 éé ▁x \x01\n  y"), (None, "no id here at all ok"), (9, "w " * 30000)]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], "doc_id long, text string, set_key string, path string, id long")


def empty(spark):
    return docs(spark).limit(0)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_filter(spark, limit, monkeypatch):
    monkeypatch.setattr(url_filter, "HOT", 1)
    rules = [url_filter.Rule(*r) for r in (("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow"), ("*.shop.com/*/buy/", "block"), ("*/odd/end", "block"))]
    urls = ["http://A.Example.net/en/x?q", "https://net", "http://x.net/", None, "no url", "http://notnet/", "http://a.shop.com/q/buy/1", "http://b.org/fr/#x", "http://b.org/fra",
        "http://b.org/fr/#x", "http://q/odd/end\r\n", "http://long.net/" + "a/" * 30000]
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows, rules, max_bytes=limit).collect()}
    assert len(found) == len(urls)
    assert found[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and found[1] == ("net", "", None, "allow")
    assert [found[i][2] for i in (2, 3, 4, 5, 6, 7, 8)] == ["net/", None, None, None, "*.shop.com/*/buy/", "org/fr/", None]
    assert found[3][:2] == ("", "") and found[10][2] == "*/odd/end" and found[11][2] == "net/"
    assert url_filter.filter_urls(rows.limit(0), rules).count() == 0 and url_filter.filter_urls(rows, []).count() == len(urls)


def test_token_shards(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    manifest = token_shards.write_token_shards(docs(spark), path, 1)
    found = token_shards.read_token_shards(manifest).collect()
    plain = Tokenizer.from_file(path)
    ids = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for key, text in order:
        own = ids(text)
        expected.append((key, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert token_shards.lookup(manifest, 1).tolist() == ids(ODD[0][1]).tolist() and token_shards.lookup(manifest, 8) is None
    assert token_shards.read_token_shards(token_shards.write_token_shards(empty(spark), path, 1)).count() == 0


def test_token_ids_of_odd_letters():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain, encoder, rng = Tokenizer.from_file(path), token_shards.WordEncoder(path, 1), random.Random(1)
    assert encoder.by_word
    blocks = ((0x41, 0x250), (0x370, 0x600), (0x620, 0x6D5), (0x900, 0xE00), (0x10A0, 0x1100), (0x1E00, 0x2000), (0xFB00, 0xFB07))
    letters = [chr(c) for b in blocks for c in range(*b) if chr(c).isprintable()]
    texts = ["Yazar İ. Kaya ve D. İ, sonra İ!", "a <|endoftext|> b0 c", "क़. ड़,"] + [c + m for c in letters for m in ".!"]
    texts += ["".join(rng.choice(letters + list(" .,!?'-0129\n\t  ") * 40) for _ in range(50)) for _ in range(500)]
    found = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
    assert found == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_any_other_tokenizer_is_given_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain, encoder = Tokenizer.from_file(path), token_shards.WordEncoder(path, 1)
    assert not encoder.by_word
    texts = ["a  b, c\n d", "", "É ok"]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_keyed_access_reads_no_more_for_larger_shards(tmp_path):
    from pyarrow import fs

    class Counting:
        def __init__(self, file):
            self.file, self.read = file, 0

        def read_at(self, n, at):
            self.read += n
            return self.file.read_at(n, at)

        def __getattr__(self, name):
            return getattr(self.file, name)

    for n in (1_000, 100_000):
        with open(tmp_path / f"s{n}", "wb") as out:
            token_shards.write_shard(out, np.dtype("<u2"), [(list(range(0, 3 * n, 3)), [np.array([i % 65536], "<u2").tobytes() for i in range(n)])])
        shard = token_shards.Shard(fs.LocalFileSystem(), str(tmp_path / f"s{n}"))
        shard.file = Counting(shard.file)
        for i in (0, 5, n - 1):
            assert shard.get(3 * i).tolist() == [i % 65536] and shard.get(3 * i + 1) is None
        assert shard.file.read < 6 * 2000


def test_rows_come_through_the_index(tmp_path):
    from pyarrow import fs

    one = [np.array(x, "<u2").tobytes() for x in ([1], [2, 2], [3], [4, 4, 4], [5])]
    with open(tmp_path / "s", "wb") as out:
        token_shards.write_shard(out, np.dtype("<u2"), [([None, 7, 7, 8, 9], one)])
    shard = token_shards.Shard(fs.LocalFileSystem(), str(tmp_path / "s"))
    read = lambda: [(k, b, x.tolist()) for keys, begins, ids in token_shards.located(shard) for k, b, x in zip(keys.to_pylist(), begins.tolist(), ids, strict=True)]
    assert read() == [(None, 0, [1]), (7, 1, [2, 2]), (7, 3, [3]), (8, 4, [4, 4, 4]), (9, 7, [5])]
    shard.places_of = lambda keys: np.array([1, 4, 3])  # an index that swaps 8 and 9 shows in the rows
    assert read()[3:] == [(8, 7, [5]), (9, 4, [4, 4, 4])]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000).astype(np.uint64))
    assert sorted(token_shards.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_warc(spark):
    big = "é" * 60
    rows = [(1, "u1", big), (2, "u2", big), (2, "u2", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "n", big), (6, "a\nb", "x" * 300000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    found = sorted(map(tuple, warc.read_archives(warc.write_archives(pages), content=True).collect()), key=str)
    expected = []
    for key, url, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 100 and html == big and key != 1
        expected.append((key, "".join(c if c >= " " else "%0A" for c in url or ""), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response",
            1 if revisit else None, None if revisit else bytearray(body)))
    assert found == sorted(expected, key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_zip64(tmp_path):
    import zipfile

    from pyarrow import fs

    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        with z.open("m", "w", force_zip64=True) as m:
            m.write(b"hello")
        z.writestr("c", b"x" * 99, zipfile.ZIP_DEFLATED)
    package = warc.Package(fs.LocalFileSystem().open_input_file(path))
    assert package.read("m") == b"hello"
    with pytest.raises(ValueError):
        package.read("c")


def test_jump_hash(spark):
    def one(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = np.arange(500, dtype=np.uint64)
    assert sharding.jump_hash(keys, 8).tolist() == [one(int(k), 8) for k in keys]
    found = sharding.shard_documents(docs(spark)).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert r.grown_shard in (r.shard, 8) and r.shard == one((r.doc_id if r.doc_id is not None else -1) % (1 << 64), 8)
    for s in range(8):
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))
    assert {r.doc_id: (r.size, r.text_crc32) for r in found}[2] == (1, 0)
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards mix potions in the old tower by the sea"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (5, "abc")], "item_id long, text string")
    edited = item.replace("quick", "quack").replace("seven", "sevn")
    rows = [(1, "start " * 50 + item.upper() + " end" * 20), (2, edited), (3, "clean " * 300), (4, None), (5, item[:70]), (6, item[:30]), (5, item[:70])]
    found = decontaminate.find_leaks(docs(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == Counter({(d, i): (2 if d == 5 else 1) for d in (1, 2, 5) for i in (1, 4)})
    assert min(r.edits for r in found if r.doc_id == 1) == 0
    small = decontaminate.find_leaks(docs(spark, rows), bench, block_bytes=1).collect()
    assert Counter((r.doc_id, r.item_id, r.edits) for r in small) == Counter((r.doc_id, r.item_id, r.edits) for r in found)
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0 and decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.drop_leaks(docs(spark, rows), bench).collect()} == {3, 4, 6}


def test_search_against_alignment_at_every_place():
    """Each window against each text by the full edit-distance table."""

    def least_edits(pattern, text):
        row = np.zeros(len(text) + 1, int)
        for i, c in enumerate(pattern):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = np.array(new)
        return int(row.min())

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 25, 60])))) for i in range(12)]
    windows = decontaminate.Windows(items)
    for _ in range(40):
        own = rng.choice(items)[1]
        begin = rng.randrange(max(1, len(own) - 70))
        piece = list(own[begin : begin + rng.randrange(40, 120)])
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(piece))
            piece[at : at + 1] = rng.choice([[], ["x"], ["y", piece[at]]])
        text = " ".join(word() for _ in range(10)) + " " + "".join(piece) + " " + " ".join(word() for _ in range(10))
        x = decontaminate._points(decontaminate.normal(text))
        found = {m[0]: min(m[3], 99) for m in windows.search(x)}
        wanted = {w for w, t in enumerate(windows.texts) if least_edits(t, x) <= windows.edits[w]}
        assert set(found) == wanted


def test_leak_at_a_document_start(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "clean " * 30), (2, item[3:] + " end" * 20), (3, "calm " * 30), (4, item.replace("quick", "quik")), (5, None), (6, item[:-3])]
    for order in (rows, rows[::-1]):
        found = decontaminate.find_leaks(docs(spark, order).coalesce(1), bench).collect()
        assert {r.doc_id for r in found} == {2, 4, 6}
        sizes = {d: len(decontaminate.normal(t)) for d, t in rows}
        assert all(0 <= r.begin < r.end <= sizes[r.doc_id] for r in found)
    assert {r.doc_id for r in decontaminate.drop_leaks(docs(spark, rows).coalesce(1), bench).collect()} == {1, 3, 5}


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = [r[0] for r in rows]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return {(r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, label, strict=True)}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CROWD", 4)
    monkeypatch.setattr(near_dup, "COMMON", 5)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    base = [word() for _ in range(80)]
    rows = [r for r in ODD if r[0] is not None]
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = word()
        rows.append((100 + i, " ".join(own)))
    rows += [(300 + i, " ".join(word() for _ in range(60))) for i in range(20)]
    found = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert len(found) == len(rows) and {tuple(r) for r in found} == brute_components(rows)
    kept = near_dup.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in brute_components(rows) if r[3]})
    assert near_dup.near_duplicates(empty(spark)).count() == 0 and near_dup.near_duplicates(docs(spark)).count() == len(ODD)


def test_crowded_buckets_do_not_make_all_pairs(spark, monkeypatch):
    """Documents of 64 shared and 36 own words fill buckets but link with none: what is paired must not grow with the square."""
    made, plain = [], near_dup._crossing

    def counted(*args):
        pairs = plain(*args).persist()
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dup, "_crossing", counted)
    shared = " ".join(f"s{i}" for i in range(64))
    for n in (250, 500):
        rows = [(i, shared + "".join(f" o{i}x{j}" for j in range(36))) for i in range(n)] + [(n, shared + " end"), (n + 1, shared + " End now")]
        found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
        assert found == {i: min(i, n) for i in range(n + 2)}
    assert made[1] <= 2.5 * made[0] + 50
    assert made[1] < 500 * 499 // 2 // 10


def test_no_name_is_defined_twice():
    """A second definition of a function silently replaces the first."""
    import ast
    from pathlib import Path

    for path in Path(near_dup.__file__).parents[1].rglob("*.py"):
        for block in [x for x in ast.walk(ast.parse(path.read_text())) if isinstance(x, ast.Module | ast.ClassDef)]:
            names = [x.name for x in block.body if isinstance(x, ast.FunctionDef | ast.ClassDef)]
            assert len(names) == len(set(names)), path


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert (near_dup.sketch(a) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    shared, x, y = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    same = np.mean([near_dup.sketch(np.append(shared, x)) == near_dup.sketch(np.append(shared, y))])
    assert abs(same - 0.6) < 0.15


def encoded(machine, texts):
    ids, counts = machine.encode(texts)
    found = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [x.decode("utf-8", "surrogatepass") for x in machine.decode(ids, counts)] == [machine.normal(t) for t in texts]
    return found


def test_pieces_equal_library(spark):
    import pickle

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), pickle.loads(pickle.dumps(pieces.PieceTransducer(path)))
    rng = random.Random(5)
    texts = [t or "" for _, t in ODD] + ["  a  b ", "\n\n x", "don't!!! stop...", "<s></s>", "a\tb", "😀 ok", "x  \n  y\n", "a" * 5000, "ab" * 3000]
    texts += ["".join(rng.choice("ab .e,th\né▁") for _ in range(60)) for _ in range(200)] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz -=*#/._ABCT019äéßñ中") for _ in range(80)) for _ in range(300)]
    assert encoded(machine, texts) == [library.encode(t) for t in texts]
    found = pieces.encode_documents(docs(spark), path)
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in found.collect())
    back = pieces.decode_documents(found, path).collect()
    assert Counter(r.text for r in back) == Counter((t or "").replace("▁", " ") for _, t in ODD)
    assert pieces.encode_documents(empty(spark), path).count() == 0


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 20)
    monkeypatch.setattr(pieces, "CHARACTERS", 50)
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceTransducer(path)
    for i in range(30):
        texts = [f"the word{i} and {i * 7919} {'x' * 90} again " * 3, f"und das {i}\n"]
        assert encoded(machine, texts) == [library.encode(t) for t in texts]
    assert len(machine.newer) <= 60 and len(machine.older) <= 60


def unigram_model(rules=b"", trim=False):
    """A model of weights made by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, rng = pb.ModelProto(), random.Random(1)
    add = lambda piece, score=0.0, kind=1: model.pieces.add(piece=piece, score=score, type=kind)
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        add(name, 0, kind)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, 6)
    own = set("▁abcde.é") | {("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("abcdeéx") for _ in range(rng.randrange(2, 5))) for _ in range(300)}
    for x in sorted(own):
        add(x, -rng.uniform(2, 12))
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.vocab_size = 1, True, len(model.pieces)
    spec = model.normalizer_spec
    spec.name, spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "own", rules, True, trim, True
    return model.SerializeToString()


def unigram_agrees(blob, letters, salt):
    import sentencepiece

    library, machine, rng = sentencepiece.SentencePieceProcessor(model_proto=blob), pieces.PieceTransducer(model=blob), random.Random(salt)
    texts = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(500)]
    weight = lambda ids: sum(machine.weights[i] for i in ids if i > 258)
    other = 0
    for text, found in zip(texts, encoded(machine, texts), strict=True):
        wanted = library.encode(text)
        other += found != wanted
        assert abs(weight(found) - weight(wanted)) < 1e-3 and machine.decode(np.array(found), np.array([len(found)])) == machine.decode(np.array(wanted), np.array([len(wanted)]))
    assert other <= 15  # of 500; paths of equal weight, told apart by rounding


def test_unigram_shortest_path():
    unigram_agrees(unigram_model(), "aabbccddeeéxyz.   \n😀", 3)


def test_shortest_path_is_the_least_of_all():
    machine = pieces.PieceTransducer(model=unigram_model())
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(unigram_model())
    units = {x.piece: -x.score for x in proto.pieces if x.type == 1}

    def least(text):
        return 0.0 if not text else min((units[text[:n]] + least(text[n:]) for n in range(1, len(text) + 1) if text[:n] in units), default=math.inf)

    rng = random.Random(9)
    for _ in range(60):
        word = "".join(rng.choice("abcdeé") for _ in range(8))
        ids, _ = machine.shortest([word])
        assert abs(sum(machine.weights[i] for i in ids) - least(word)) < 1e-3


def test_normaliser_rules():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    unigram_agrees(unigram_model(model.normalizer_spec.precompiled_charsmap, True), "aabbＡ１½ﬁccddeeéxyz.   \n\t\u3000éÅ", 4)


def test_language_model(spark):
    rng = random.Random(1)
    rows = ODD + [(20 + i, " ".join(rng.choice([["der", "die", "und"], ["the", "of", "and"]][i % 2]) + rng.choice(["", "", "x" + str(rng.randrange(50))]) for _ in range(80))) for i in range(200)]
    for head in (150_000, 5):
        found = language_model.score_documents(docs(spark, rows), head=head).collect()
        words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\n"]
        out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
        count = Counter(w for k, t in rows if not out(k) for w in words(t))
        total, bottom = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
        expected = Counter((k, out(k), len(words(t)), sum(count[w] > 0 for w in words(t)), total, round(sum(math.log10((count[w] + 0.1) / bottom) for w in words(t)), 4)) for k, t in rows)
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == expected
        held = [r for r in found if r.held_out and r.doc_id and r.doc_id >= 20]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score_documents(empty(spark)).count() == 0


def test_model_adds_up_to_one():
    model = language_model.Model.fresh(np.full(40, 1 / 40), seed=3)
    for first in (0, 5, 40):
        score = (model.r[first] @ model.c1 + model.r @ model.c2) @ model.q.T + model.b
        assert np.allclose(np.exp(score - model.log_normaliser(first)[:, None]).sum(axis=1), 1, atol=1e-4)


def test_scores_are_those_of_the_model(spark, monkeypatch):
    """Token after token, with the softmax over all symbols and the share inside a class written out."""
    kept = {}
    fit = language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *a: kept.setdefault("model", fit(*a, rounds=1)))
    monkeypatch.setattr(language_model, "FEWEST", 6)
    monkeypatch.setattr(language_model, "CLASSES", 3)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("a b c d e f g h i j k l m no pq rs tu".split()) for _ in range(rng.randrange(9)))) for i in range(60)] + [(99, None), (None, "a zz b"), (200, "new A words")]
    monkeypatch.setattr(language_model, "vocabulary", lambda n: (6, 3))
    found = language_model.score_documents(docs(spark, rows), head=9).collect()
    cut = lambda t: (t or "").lower().split() + ["\n"]
    count = Counter(w for k, t in rows if not language_model.held_out(k) for w in cut(t))
    top = sorted((w for w in count if w != "\n"), key=lambda w: (-count[w], w))[:6]
    order = ["\n", *top]
    symbol = lambda w: order.index(w) if w in order else 7 + zlib.crc32(w[-2:].encode()) % 3
    inside = [[w for w in count if symbol(w) == 7 + c] for c in range(3)]
    share = lambda w: 1.0 if w in order else (count[w] + 0.1) / (sum(count[x] for x in inside[symbol(w) - 7]) + 0.1 * (len(inside[symbol(w) - 7]) + 1))
    m, expected = kept["model"], Counter()
    for k, t in rows:
        before, total = [10, 10], 0.0
        for w in cut(t):
            score = np.array([(m.r[before[0]] @ m.c1 + m.r[before[1]] @ m.c2) @ m.q[s] + m.b[s] for s in range(10)], float)
            total += math.log10(math.exp(score[symbol(w)]) / np.exp(score).sum() * share(w))
            before = [before[1], symbol(w)]
        expected[k, round(total, 2)] += 1
    near = sorted(((k, s) for (k, s), n in expected.items() for _ in range(n)), key=str)
    got = sorted(((r.doc_id, r.score) for r in found), key=lambda x: str((x[0], round(x[1], 2))))
    assert [k for k, _ in got] == [k for k, _ in near] and all(abs(a - b) < 0.02 for (_, a), (_, b) in zip(got, near, strict=True))


def test_vocabulary_grows_with_the_corpus():
    assert language_model.vocabulary(1000) == (95, 32)
    small, large = language_model.vocabulary(10**8), language_model.vocabulary(10**11)
    assert small[0] == 928 and large[0] == 9283 and large[1] == 1160


def test_every_token_is_learned_from(spark):
    texts = [np.array(x, "<u2") for x in ([3, 0], [0], [1, 2, 0])]
    a, b, w = language_model.in_context(texts, 4)
    assert list(zip(a.tolist(), b.tolist(), w.tolist(), strict=True)) == [(4, 4, 3), (4, 3, 0), (4, 4, 0), (4, 4, 1), (4, 1, 2), (1, 2, 0)]
    rows = spark.createDataFrame([(bytearray(np.array([1, 2] * 20 + [0], "<u2").tobytes()),) for _ in range(50)], "symbols binary")
    model = language_model.fit(rows, np.array([0.03, 0.47, 0.47, 0.03]))
    score = (model.r[2] @ model.c1 + model.r[1] @ model.c2) @ model.q.T + model.b
    assert score.argmax() == 2 and model.log_normaliser(2)[1] - score[2] < 0.3


def test_every_chunk_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(language_model, "_CHUNK", 10)
    monkeypatch.setattr(language_model, "BATCH", 8)
    monkeypatch.setattr(language_model, "LEAST_STEPS", 1)
    seen = Counter()

    class Watching(language_model.Trainer):
        def step(self, a, b, w, rate):
            super().step(a, b, w, rate)
            seen.update(w.tolist())

    monkeypatch.setattr(language_model, "Trainer", Watching)
    texts = [np.array([i % 50 + 1] * 3 + [0], "<u2") for i in range(200)]
    unigram = np.full(51, 1 / 51)
    model = language_model.Model.fresh(unigram)

    class Frame:  # runs the task's function here, so that its steps can be counted
        sparkSession = spark

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in texts], pa.binary())], names=["symbols"])
            return self.made(list(run(iter([batch]))))

        def made(self, batches):
            import pyarrow as pa

            frame = Frame()
            frame.mapInArrow = lambda run, schema: frame.made(list(run(iter(batches))))
            frame.repartition = lambda n: frame
            frame.toArrow = lambda: pa.Table.from_batches(batches)
            return frame

    monkeypatch.setattr(language_model, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    found, _ = language_model._train(Frame(), model, [np.full_like(x, 1e-9) for x in model.parts()], unigram, "<u2", 0, True)
    assert seen == Counter(np.concatenate(texts).tolist()) and not np.allclose(found.q, model.q)


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["idiot", "scum", "trash"]
    rows, labels = list(ODD), [(1, 1, 0), (1, 1, 0), (None, 1, 1), (77777, 0, None)]
    for i in range(600):
        text = [f"w{rng.randrange(300)}" for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            text[3], text[9] = rng.choice(bad), rng.choice(bad).upper() + "!"
        rows.append((100 + i, " ".join(text)))
        if i < 450:
            labels.append((100 + i, int(i % 3 > 0), int(toxic)))
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.toxic for r in toxicity.rate_toxicity(docs(spark, rows), label).collect()}
    assert all(found[100 + i] == (i % 5 == 0) for i in range(450, 600))
    kept = toxicity.drop_toxic(docs(spark, rows), label)
    assert kept.columns == docs(spark).columns and not {100 + i for i in range(450, 600, 5)} & {r.doc_id for r in kept.collect()}
    assert not any(r.toxic for r in toxicity.rate_toxicity(docs(spark), label.limit(0)).collect())
    assert toxicity.rate_toxicity(empty(spark), label).count() == 0


def test_repeated_labels_count_by_the_largest(spark):
    rows = [(i, f"word{i % 7} " * 3 + ("bad1 bad2" if i % 4 == 0 else "fine")) for i in range(200)]
    one = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(200)]
    more = one + [(i, 1, 0) for i in range(200)]
    found = [toxicity.train(docs(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(n), toxicity.categories()) for x, n in ((one, 2), (more, 1), (more, 4))]
    for chain in found[1:]:
        for a, b in zip(found[0], chain, strict=True):
            assert a.hashes.tolist() == b.hashes.tolist() and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias


def plain_chain(sets, labels, folds):
    """The chain by loops over a dense matrix: of each category the chosen features, weights, weights of earlier links and bias."""
    n, before, chain = len(sets), [[] for _ in sets], []
    for label in labels:
        usable = [i for i in range(n) if label[i] in (0, 1)]

        def fitted(train, label=label, before=before):
            y = [label[i] for i in train]
            share, chi = sum(y) / len(y), {}
            for f in sorted(set().union(*[sets[i] for i in train])):
                held = sum(f in sets[i] for i in train)
                hits = sum(f in sets[i] and label[i] == 1 for i in train)
                if toxicity.LEAST <= held <= 0.5 * len(y):
                    chi[f] = (hits - held * share) ** 2 / max(held * share * (1 - share) * (1 - held / len(y)), 1e-9)
            best = sorted(sorted((f for f in chi if chi[f] > 10.8), key=lambda f: (-chi[f], f))[: toxicity.FEATURES])
            x = np.array([[f in sets[i] for f in best] for i in train], dtype=float).reshape(len(train), len(best))
            extra = np.array([before[i] for i in train], dtype=float).reshape(len(train), len(before[0]))
            w, u, b = np.zeros(len(best)), np.zeros(extra.shape[1]), math.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5))
            scale = np.sqrt(x.sum(axis=0) + 0.5)
            rate, at = 1 / max(1.0, np.sqrt(max([1.0, *(x @ (1 / scale))]))), (w, u, b)
            for t in range(120):
                r = np.array(y) - 1 / (1 + np.exp(-np.clip(x @ at[0] + extra @ at[1] + at[2], -30, 30)))
                new = (at[0] + rate * 4 * (x.T @ r - 0.5 * at[0]) / scale**2, at[1] + rate * (extra.T @ r - 0.5 * at[1]) / ((extra**2).sum(axis=0) + 0.5), at[2] + rate * 4 * r.mean())
                at = tuple(p + t / (t + 3) * (p - q) for p, q in zip(new, (w, u, b), strict=True))
                w, u, b = new
            return best, w, u, b

        odds = []
        for i in range(n):
            best, w, u, b = fitted([j for j in usable if j % folds != i % folds]) if i < folds else models[i % folds]  # noqa: F821
            if i < folds:
                models = [(best, w, u, b)] if i == 0 else [*models, (best, w, u, b)]  # noqa: F821
            odds.append(sum(v for f, v in zip(best, w, strict=True) if f in sets[i]) + float(np.dot(u, before[i])) + b)
        chain.append(fitted(usable))
        before = [[*x, min(20, max(-20, o))] for x, o in zip(before, odds, strict=True)]
    return chain


def test_chain_against_a_dense_matrix():
    rng = random.Random(12)
    texts, low, toxic = [], [], []
    for i in range(240):
        bad = i % 4 == 0
        texts.append(" ".join([f"w{rng.randrange(40)}" for _ in range(12)] + (["scum"] if bad and rng.random() < 0.9 else []) + (["spam!"] if i % 3 == 0 else [])))
        low.append(int(i % 3 == 0) if i % 11 else -1)
        toxic.append(int(bad) if i % 13 else -1)
    own = [toxicity.features(t) for t in texts]
    chain = toxicity.fit_chain(np.repeat(np.arange(240), [len(x) for x in own]), np.concatenate(own), {"low": np.array(low), "toxic": np.array(toxic)})
    expected = plain_chain([set(x.tolist()) for x in own], [low, toxic], toxicity.FOLDS)
    for link, (best, w, u, b) in zip(chain, expected, strict=True):
        assert link.hashes.tolist() == best and link.weights == pytest.approx(w, abs=1e-8) and link.earlier == pytest.approx(u, abs=1e-8) and link.bias == pytest.approx(b, abs=1e-8)
    held = {f: v for f, v in zip(expected[0][0], expected[0][1], strict=True)}
    first = sum(held.get(f, 0.0) for f in own[5].tolist()) + expected[0][3]
    second = sum(v for f, v in zip(expected[1][0], expected[1][1], strict=True) if f in set(own[5].tolist())) + expected[1][2][0] * first + expected[1][3]
    assert toxicity.score_chain(chain, own[5]) == pytest.approx([1 / (1 + math.exp(-first)), 1 / (1 + math.exp(-second))])


def test_texts_of_megabytes(spark):
    """Texts of several MB pass the searches of near-duplicates, leaks and fingerprints whole: what tells them apart stands at their end."""
    big = " ".join(f"w{i * 7919 % 100003}" for i in range(400000))
    rows = [(1, big), (2, big + " tail one two three"), (3, " ".join(reversed(big.split())) + " the passage of the benchmark is hidden here at the very end of all")]
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    bench = spark.createDataFrame([(7, "the passage of the benchmark is hidden here at the very end")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()} == {(3, 7)}
    prints = [r.fingerprint for r in fingerprint.fingerprint_documents(docs(spark, rows)).orderBy("doc_id").collect()]
    assert len(set(prints)) >= 2


def test_fingerprints(spark):
    rows = [(k, t) for k, t in ODD if k != 6] + [(20, "alpha beta gamma delta " * 20), (21, "alpha beta gamma delta " * 20), (22, " ".join(f"w{i}" for i in range(300)))]
    found = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (k, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)]
        third = len(t) // 3
        edited = t[: len(t) - third] + (following[1] or "")[:third]
        r = found[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        pair = lambda a, b: sum(a[j : j + 8] == b[j : j + 8] for j in range(0, 256, 8)) / 32
        assert r.near_edited == pair(r.fingerprint, r.edited_fingerprint) and r.near_next == pair(r.fingerprint, found[following[0]].fingerprint)
        if t == edited:
            assert r.near_edited == 1
    assert found[20].fingerprint == found[21].fingerprint and found[22].near_edited > found[22].near_next
    assert fingerprint.fingerprint_documents(empty(spark)).count() == 0
    again = fingerprint.fingerprint_documents(docs(spark))
    assert again.count() == len(ODD)


def test_signature_against_brute_force(spark):
    """Component by component: k-mers numbered by occurrence, hashed, the first two from each rotation's start, in text order."""
    f = fingerprint
    rng = random.Random(6)
    texts = [None, "", "one", "one two three four", "a b c " * 9, " ".join(rng.choice("x y z w v".split()) for _ in range(70)), "word" * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.f for r in rows.select("i", f.order_minhash(f.F.col("t")).alias("f")).collect()}
    asked = []

    def hashes(columns):
        """xxhash64 of tuples of (kind, value), by Spark."""
        one = [tuple(c) for c in columns]
        asked.append(len(one))
        cells = [f"xxhash64({', '.join(x)})" for x in one]
        return list(spark.range(1).selectExpr(f"array({', '.join(cells)}) AS h").first().h) if cells else []

    long = lambda x: f"{x}L" if x != -(1 << 63) else "(-9223372036854775807L - 1L)"
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    for i, text in enumerate(texts):
        symbols = [w[j : j + 12] for w in re.findall(r"\S+", text or "") for j in range(0, len(w), 12)]
        s = hashes([[f"'{x}'"] for x in symbols]) or [0]
        starts = range(max(1, len(s) - 2))
        grams = hashes([[long(s[j]), *[long(s[j + d]) if j + d < len(s) else "CAST(NULL AS BIGINT)" for d in (1, 2)]] for j in starts])
        seen, number = Counter(), []
        for g in grams:
            number.append(seen[g >> 31])
            seen[g >> 31] += 1
        base = hashes([[long(g >> 31), str(n)] for g, n in zip(grams, number, strict=True)])
        expected = []
        for salt in range(4):
            own = hashes([[long(h >> 31), str(salt)] for h in base])
            order = sorted(wrap((h & ~0x7FFFFFFF) | j) for j, h in enumerate(own))
            tuples = []
            for t in range(8):
                point = -(1 << 63) + t * (1 << 61)
                begin = sum(x < point for x in order)
                spots = sorted(order[(begin + r) % len(order)] & 0x7FFFFFFF for r in range(min(2, len(order))))
                tuples.append([str(t + 8 * salt), f"array({', '.join(long(grams[p]) for p in spots)})"])
            expected += [h & 0xFFFFFFFF for h in hashes(tuples)]
        assert found[i] == expected, text


def test_order_matters(spark):
    one = [f"w{i}" for i in range(400)]
    swapped = one[200:] + one[:200]
    rows = spark.createDataFrame([(" ".join(one), " ".join(swapped))], "a string, b string")
    a, b = rows.select(fingerprint.order_minhash(fingerprint.F.col("a")), fingerprint.order_minhash(fingerprint.F.col("b"))).first()
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 32
    assert 0.2 < same < 0.8  # the same k-mers but for two; pairs across the cut changed their order


def write_tables(spark, folder, rows, labels, items):
    docs(spark, rows).withColumnRenamed("id", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows against brute force on what the one before kept: odd rows, repeats and clashing columns included."""
    import sentencepiece

    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 8)))
    item = " ".join(word() for _ in range(30))
    rows, labels = list(ODD), []
    for i in range(300):
        text = [word() for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            text[2], text[7] = "scum", "IDIOT!"
        rows.append((100 + i, " ".join(text)))
        labels.append((100 + i, int(i % 4 > 0), int(toxic)))
    base = [word() for _ in range(60)]
    rows += [(600 + i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(5)] + [(700, word() + " " + item + " " + word()), (701, item[5:110]), (702, rows[30][1]), (702, rows[30][1])]
    write_tables(spark, tmp_path, rows, labels, [(1, item), (2, None), (3, "")])
    seen, given = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "encoding"]
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    for name, stage in pipeline.STAGES:
        given, before = seen, key(seen)
        seen = stage(spark, given, str(tmp_path))
        if name == "encoding":
            break
        seen.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        assert seen.columns == given.columns
        kept = key(seen)
        if name == "toxicity":
            assert before - kept == Counter({(k, t): n for (k, t), n in before.items() if "scum" in (t or "")})
        elif name == "near_duplicates":
            with_id = [x for x in before if x[0] is not None]
            best = {x[0] for x in brute_components(with_id) if x[3]}
            assert kept == Counter({x: 1 if x[0] is not None else n for x, n in before.items() if x[0] is None or x[0] in best})
            assert sum(600 <= (k or 0) < 605 for k, _ in kept) == 1
        else:
            clean = decontaminate.normal(item)
            leaks = {k for k, t in before if any(clean[i : i + 64] in decontaminate.normal(t) for i in range(len(clean) - 63))}
            assert leaks == {700, 701} and {k for k, _ in before} - {k for k, _ in kept} == leaks
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in seen.collect()) == Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in given.collect())
    whole = pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.round_trip) for r in whole.collect()) == Counter((r.doc_id, tuple(r.ids), len(r.ids), True) for r in seen.collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    write_tables(spark, tmp_path, [], [], [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    sharding.write_shards(docs(spark), str(tmp_path / "out"), 4)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == len(ODD) and found.where(F.col("shard") != sharding.shard_of("doc_id", 4)).count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(docs(spark).withColumn("shard", F.lit(1)), str(tmp_path / "no"))
    sharding.write_shards(empty(spark), str(tmp_path / "empty"))


def test_repeated_keys_are_dealt_over_shards(spark):
    rows = [(7, "same text here")] * 400 + [(i, f"word{i}") for i in range(20)]
    manifest = token_shards.write_token_shards(docs(spark, rows), P.path("word_bpe_49k.json"), 1)
    found = token_shards.read_token_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(k for k, _ in rows) and len({r.ids_crc32 for r in found if r.doc_id == 7}) == 2
    assert manifest.where("low <= 7 AND high >= 7").count() > 1 and token_shards.lookup(manifest, 7) is not None


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><nav><a href=/>Home</a></nav>Site</header>
<div class="cookie-notice">We use cookies <button>OK</button></div><main><h1>Head &amp line</h1><article class="post"><header class="entry-header"><p class="byline">By X</p></header>
<p title="a > b">First para <a href="q">with link</a> and
 more<br>text.<p>Second <b>bold</b><i>glued</i> &lt;tag&gt; &#233;&nbsp;z<ul><li>one<li>two</ul><div class="adSlot">Buy</div><aside>side</aside>
<form>Name <input><label>q</label></form><span class="ad">inline ad</span> tail <!-- c <p> --><script>if (a<b) "</p>"</script>a < b<footer>tags</footer></article>
<section id="comments"><article class="comment"><p>A long comment about this article and its many words and so on and on.</p></article></section></main>
<div class="sidebar">Many words here in this sidebar to read, but they are no main text at all</div><div>a plain block of text that stands outside of the article</div><footer>&copy; 2020</footer>"""


def test_main_text(spark):
    from corpusloom.llm import html_text

    plain = "<body><div><a>Home</a> | <a>News</a></div><h1>A story</h1><p>The council met on Monday to talk about the new bridge, which is late.</p><p>Nobody came.</p><p>The next meeting will be held in a month, it said.</p><div><a>Next story</a></div>"
    article = ["Head & line", "By X", "First para with link and more text.", "Second boldglued <tag> é z", "one", "two", "tail a < b"]
    long = "<article>" + "".join(f"<p>w{i}" for i in range(50000)) + "</article>"
    tags = "<div>" * 30000 + "deep " * 30 + "</div>" * 30000
    cases = {PAGE: article, plain: ["A story", "The council met on Monday to talk about the new bridge, which is late.", "Nobody came.", "The next meeting will be held in a month, it said."],
        None: [], "": [], "<!-- never closed": [], "<script>x": [], "<p>": [], long: [f"w{i}" for i in range(50000)], tags: [" ".join(["deep"] * 30)], "</p></div><article>&am</article>": ["&am"],
        "<div id=content><p>a</p><div class='share-links'>b</div></div>c": ["a"], "<article><p>x<p hidden>y</p><div style='display: none'>z</div></article>": ["x"]}
    rows = [(i, f"http://{i}", s, "old", 1) for i, s in enumerate(cases)] + [(None, None, PAGE, "old", 1), (0, "http://0", PAGE, "old", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, words int")
    found = html_text.extract_pages(pages).collect()
    assert len(found) == len(rows)
    expected = {(r[0], r[1], "\n".join(cases[r[2]])) for r in rows}
    assert {(r.page_id, r.url, r.text) for r in found} == expected and all(r.n_chars == len(r.text) for r in found)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_tree_follows_its_table():
    from corpusloom.llm import html_text

    tree, rng = html_text.grown(), np.random.default_rng(5)
    for page in html_text.LABELLED:
        own = np.array(page, dtype=float)
        assert ((tree.predict(html_text.featured(own[:, :5])) >= 0.5) == (own[:, 5] == 1)).mean() >= 0.75
    x = np.column_stack([c for _ in range(3) for c in (rng.integers(0, 400, 2000), rng.random(2000))] + [rng.integers(-1, 2, 2000), rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)])
    kept = tree.predict(x) >= 0.5
    for (scope, named), label in html_text.ANYWHERE.items():
        assert (kept[(x[:, 6] == scope) & (x[:, 7] == named)] == (label == 1)).all()
    grown = html_text.Tree(x[:200, :6], (x[:200, 2] > 50) ^ (x[:200, 3] > 0.5), depth=30)
    assert ((grown.predict(x[:200, :6]) >= 0.5) == ((x[:200, 2] > 50) ^ (x[:200, 3] > 0.5))).all()


def test_whitening_against_an_eigendecomposition(spark):
    from corpusloom.llm import whitening

    rng = np.random.default_rng(2)
    base = (rng.normal(size=(700, 20)) @ rng.normal(size=(20, 20)) + 30).astype(np.float32)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(np.vstack([base, np.repeat(base[:1], 300, axis=0)]))] + [(2000, None, 1, "x"), (2001, [], 1, "x"), (2002, [float("nan")] * 20, 1, "x"), (2003,
        [None] + [1.0] * 19, 1, "x"), (2004, [float("-inf")] * 20, 1, "x"), (None, base[3].tolist(), 1, "x"), (2005, [1.0, 2.0], 1, "x"), (2006, [2.0, 5.0], 1, "x"), (2007, [3.0], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string").repartition(13)
    found = whitening.whiten(table).toPandas()
    x = np.floor(64 * np.vstack([base, np.repeat(base[:1], 300, axis=0)]).astype(float)).astype(int) + 1000000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    expected = ((x * n - sums) / n) @ v[:, :16] / np.sqrt(e[:16])
    own = found[found.vec_id < 1000].sort_values(["vec_id", "component"], kind="stable")
    got = own.whitened.to_numpy().reshape(1000, 16)
    sign = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * sign).max() < 1e-8
    assert (own.n == n).all() and own.explained.to_numpy()[:16] == pytest.approx(e[:16] / e.sum(), rel=1e-9) and own.identity_error.max() < 1e-9
    assert own.deviation.tolist() == np.repeat(((x * n - sums) ** 2).sum(axis=1), 16).tolist() and [int(d) for d in own.deviation_wide] == own.deviation.tolist()
    assert found.vec_id.isna().sum() == 16 and not set(found.vec_id) & set(range(2000, 2005))
    two = found[found.vec_id.isin([2005, 2006])].sort_values(["vec_id", "component"])
    assert two.whitened.abs().tolist()[::2] == pytest.approx([1, 1]) and two.whitened.isna().tolist() == [False, True] * 2 and two.explained.tolist() == pytest.approx([1, 0] * 2)
    one = found[found.vec_id == 2007].iloc[0]
    assert np.isnan(one.whitened) and np.isnan(one.explained) and one.deviation == 0
    assert whitening.whiten(table.limit(0)).count() == 0


def test_merging_loses_nothing():
    from corpusloom.llm import whitening

    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (400, 7)) + rng.integers(0, 10**9, 7)
    parts = [whitening.summary(p) for p in (x[:1], x[1:4], x[4:300], x[300:])]
    state = parts[0]
    for p in parts[1:]:
        state = whitening.merged(state, p)
    whole = whitening.summary(x)
    assert state[0] == 400 and state[1].tolist() == x.sum(axis=0).tolist() == whole[1].tolist()
    assert state[2] == pytest.approx(whole[2], rel=1e-10) and np.abs(np.abs((state[3] * whole[3]).sum(axis=1)) - 1).max() < 1e-10
    huge = np.array([[1 << 40, 0], [-(1 << 40), 3]])
    model = {"n": 1 << 31, "near": np.zeros(2, np.int64), "over": np.array([5, 6])}
    assert whitening._deviation(huge, model) == [((1 << 71) - 5) ** 2 + 36, ((1 << 71) + 5) ** 2 + (3 * (1 << 31) - 6) ** 2]


def test_filter_audit(spark):
    from itertools import permutations

    from corpusloom.llm import filter_audit

    rng = random.Random(9)
    texts = [None, "", "a | b", "ABC def", "w " * 250, "same text here"] + [" ".join(rng.choice(("A", "b", "$", "c%d" % i)) + str(rng.randrange(400)) for i in range(rng.randrange(300))) for _ in range(12)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None]), "x", 1) for i in range(80)] + [(7, "same text here", "en", "x", 1), (None, "same text here", "en", "x", 1), (90, "v" * 100000, "long", "x", 1)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 80, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (500, 1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, bits int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for key, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails.append(own + "E" * (key is not None and any(k is not None and k < key and (o or "") == t for k, o, *_ in rows)))
    expected, shares = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(k, f) for k, f in left if x in f]
                left = [(k, f) for k, f in left if x not in f]
                before = [f for _, f in own if x in f and set(f) & set(order[: step - 1])]
                expected[part, order, step] = (len(left), len(gone), len(before), sum(f == x for _, f in own), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone))
                shares[part, x] += len(gone)
    found = filter_audit.audit_filters(table, known).collect()
    assert len(found) == len(expected)
    for r in found:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == expected[r.part, r.filter_order, r.step]
        assert r.shapley == shares[r.part, r.filter_order[r.step - 1]]
    assert filter_audit.audit_filters(table.limit(0), known).count() == 0
    assert {r.good_lost for r in filter_audit.audit_filters(table, known.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        filter_audit.audit_filters(table, known, {"E": lambda t, w: F.lit(True)})
