"""The corpus operators against plain Python, round trips and held-out labels; and the odd cases that each defines."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codehistory.llm import attention, common, decontam, language, ngrams, pieces, quality, quotes, scoring, substrings, tokenfiles, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, a long one, copies, runs, repeated rows, a null id."""
    rng = random.Random(5)
    base = prose(rng, 60)
    texts = [None, "", " \n\t", "one two", base, base, base.replace("w1", "W1"), prose(rng, 30_000), "a " * 50, "a b " * 40, "x\n" + base[:100] + "\n\ny", "Ünï ćödé 漢字 ▁ <s> \x00 é" * 4]
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, base, "en", "s", 0)], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words():
    import pyarrow as pa

    w = words.of(pa.array(["Ab  c\n", None, "", "dé f"]), lower=True)
    assert words.strings(w, np.arange(len(w.start))) == [b"ab", b"c", "dé".encode(), b"f"] and w.first.tolist() == [0, 2, 2, 2, 4]
    assert words.joined(w, np.array([0, 1])) == b"ab c"


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    trees = language.learn(docs.where("doc_id % 3 <> 0"))
    got = language.identify(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 0").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    marks = {r.doc_id: r.lang_pred for r in language.identify(odd, trees).collect()}
    assert len(marks) == 13 and marks[0] == marks[1] == marks[2] == "und" and language.identify(none, trees).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.learn(none)).collect()} == {"und"}


def test_language_of_every_label(spark):
    """More than 200 languages, the smallest and those of one long text too, and texts near the sample's size."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def tongue(i, n):
        own = random.Random(i)
        vocabulary = ["".join(own.choice(letters) for _ in range(own.randrange(3, 9))) for _ in range(30)]
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    rows = [(i, tongue(i, 60 if i < 229 else 20), f"l{i:03}", "s", 0) for i in range(230)] + [(1000, tongue(1000, 30_000), "long", "s", 0)]
    rows += [(2000 + i, tongue(2000, 200), "big", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    trees = language.learn(docs)
    assert sorted(trees) == sorted({r[2] for r in rows})
    test = table(spark, [tongue(229, 40), tongue(1000, 40), tongue(2000, 40)])
    assert [r.lang_pred for r in sorted(language.identify(test, trees).collect())] == ["l229", "long", "big"]
    # however small the sample, each language has a text
    assert sorted(language.learn(docs, sample_bytes=1, sample_text=50)) == sorted(trees)


def test_code_lengths():
    tree = language.train([b"abab"])
    key, _ = language._keys(np.frombuffer(b"ab", np.uint8), np.array([0, 2]), language.ORDER)
    # after four line ends, a was seen once: n = 1, d = 1; then b after a likewise
    assert tree.bits(key).tolist() == [1.0, 1.0]


def ppm(texts, order=4):
    """Counts of bytes after contexts of 0 to 4 bytes, in plain Python."""
    seen = {}
    for text in texts:
        raw = b"\n" * order + lower(text).encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                seen.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    return seen


def code_length(seen, text, order=4):
    raw, bits = b"\n" * order + lower(text).encode(), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            after = seen.get(raw[i - k : i])
            if after is None:
                continue
            n, d = sum(after.values()), len(after)
            if raw[i] in after:
                bits -= np.log2(after[raw[i]] / (n + d))
                break
            bits -= np.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_language_by_hand(spark):
    """Predictions, scores and code lengths of whole texts against prediction by partial matching byte by byte; equal codes go to the first name."""
    rng = random.Random(12)
    own = {"aa": ["the cat and the hat", "A hat, the cat!"], "bb": ["le chat et le chapeau", "été à la plage"], "cc": ["le chat et le chapeau", "été à la plage"], "zz": ["漢字 かな 交じり文"]}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in own.items() for t in v)], "doc_id long, text string, lang string")
    trees = language.learn(docs)
    seen = {k: ppm(v) for k, v in own.items()}
    texts = ["The hat", "chapeau d'été", "漢字", "漢字 cat", "12 !?", "", None, "x" * 3000 + " le chat", *("".join(rng.choice("thecatléà 漢\n") for _ in range(30)) for _ in range(40))]
    got = {r.doc_id: r for r in language.identify(table(spark, texts), trees).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        bits = {k: code_length(v, text) for k, v in seen.items()}
        best = min(sorted(bits), key=lambda k: round(bits[k], 3))
        assert got[i].lang_pred == best and best != "cc"
        assert got[i].bits_per_byte == pytest.approx(bits[best] / len(text.encode()), rel=1e-4)
        assert got[i].score == pytest.approx(1 / sum(2.0 ** max(bits[best] - b, -1000) for b in bits.values()), rel=1e-2)


@pytest.mark.parametrize("top", [2, 300, 70_000, 2**32 - 1])
def test_packing(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 59, 1024, 5000):
        ids = np.where(rng.random(n) < 0.02, rng.integers(0, top, n), rng.integers(0, max(1, top // 50), n)).astype(np.uint64)
        w, e, limit, jumps, skips = tokenfiles.pack(ids)
        assert (tokenfiles.unpack(w, e, limit, jumps, n) == ids).all() and len(jumps) == len(skips) == -(-n // tokenfiles.LANE)
        for a, b in ((0, n), (n // 2, n), (n // 3, n // 2), (n, n)):
            assert (tokenfiles.span(w, e, limit, jumps, skips, n, a, b) == ids[a:b]).all()
        assert len(w) <= n


def test_lanes_alone():
    """A reader that starts inside a block needs the words and escapes of its lanes only."""
    rng = np.random.default_rng(3)
    ids = np.where(rng.random(9000) < 0.01, 2**31, rng.integers(0, 200, 9000)).astype(np.uint64)
    w, e, limit, jumps, skips = tokenfiles.pack(ids)
    assert len(e) and len(w) < 2500
    broken, gone = w.copy(), e.copy()
    broken[: int(jumps[5])] = 0
    gone[: int(skips[5])] = 7
    broken[int(jumps[7]) :] = 0
    assert (tokenfiles.span(broken, gone, limit, jumps, skips, 9000, 5 * 1024, 7 * 1024) == ids[5 * 1024 : 7 * 1024]).all()


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    more = spark.createDataFrame([(100, "x <|endoftext|> y", "en", "s", 0), (101, "x  <|endoftext|>\n\n", "en", "s", 0)], DOCS)
    docs = odd.unionByName(more)
    got = tokenfiles.written(docs, path).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    start = 0
    for doc, text in sorted(texts, key=lambda r: (r[0] is not None, r[0])):
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert any((r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), crc) for r in got), doc
        start += len(ids)
    assert len(got) == len(texts) and tokenfiles.written(none, path).count() == 0
    assert [87, 220, 50256, 331, 0] == model.encode("x <|endoftext|> y", add_special_tokens=False).ids + [0]
    tokenfiles.write(docs, f"{tmp_path}/t", path)
    some = {r.doc_id: r.ids for r in tokenfiles.select(spark, f"{tmp_path}/t", docs.where("doc_id in (1, 7, 100)").select("doc_id")).collect()}
    assert some == {d: model.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts if d in (1, 7, 100)}
    assert {r.doc_id: r.ids for r in tokenfiles.read(spark, f"{tmp_path}/t").collect()}[7] == some[7]


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("most", [40, 1 << 20])
def test_token_units(special, most):
    """White space of all kinds in runs, added tokens, long words; and a memory that is often full."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = not special
    encoder = tokenfiles.Encoder(path, special, most)
    white = [" ", "\n", "  ", "\n\n", "\r", "\t", "\r\n", "\u00a0", "\u3000", "\x0b", "\x1c", "\x85", "\u2028"]
    texts = ["a\r\nb", "a\tb\n", "a\t\nb", " a\tb", "a b\tc", "mot\u00a0 : x", "一\u3000二 三", "one <|endoftext|>\ttwo\n", "one  <|endoftext|> two", "<|endoftext|>", None, "", "\r", " ", "a b\nc", "l'été, l'(été)! 'Tis \"'twas'\".'s,'t", "it's don'T 'll x", "w" * 500]
    rng = random.Random(1)
    for inside in (white[:4], white):
        texts += ["".join(rng.choice(["ab", "c1", "é", "x.", "—", "'s", "'", "(", "É", "÷", "Ã", "!?", "7,", *inside]) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    for a in range(0, len(texts), 500):
        part = pa.array(texts[a : a + 500])
        ids, n = encoder(part)
        assert len(n) == len(part) and len(encoder.memory.place) <= most
        for text, got in zip(part.to_pylist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == model.encode(text or "", add_special_tokens=False).ids, repr(text)
    lowered = tokenfiles.Encoder(P.path("word_bpe_49k.json"))
    assert not lowered.cuts and lowered(pa.array(["One two", "x"]))[0].tolist() == [i for x in ("One two", "x") for i in Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(x, add_special_tokens=False).ids]


def test_pieces(spark, odd, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in pieces.encode(odd, path).collect():
        text = texts[r.doc_id] or ""
        ids = model.encode(text)
        assert r.ids == ids and r.decoded == model.decode(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        raw = text.encode()
        assert r.tiled and r.n_bytes == len(raw) and all(a <= b for a, b in zip(r.begins, r.ends, strict=True))
        spaced = b"".join(raw[a:b] for a, b in zip(r.begins, r.ends, strict=True))
        assert spaced == raw
    assert pieces.encode(none, path).count() == 0


def test_character_map():
    """A map of one entry: ﬁ becomes fi, and both letters come from the ligature."""
    blob = _map_of("ﬁ".encode(), b"fi")
    m = pieces.CharacterMap(blob)
    assert m.longest("xﬁ".encode(), 1) == (3, b"fi") and m.longest(b"x", 0) == (0, None)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize(("dummy", "escape", "extra"), [(True, True, True), (False, False, False), (True, True, False), (False, True, True)])
def test_normalisation_by_compiled_maps(rule, dummy, escape, extra):
    """Texts and source places against the library, for its compiled maps of compatibility forms."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=escape, remove_extra_whitespaces=extra)
    own = pieces.Codec.__new__(pieces.Codec)
    own.rules, own.plain = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec, False
    own.map = pieces.CharacterMap(own.rules.precompiled_charsmap)
    letters = ["a", "b", " ", "  ", "é", "ﬁ", "①", "ｱ", "ﾞ", "が", "㍿", "\u3000", "\t", "A\u030a", "\u200b", "ß", "İ", "𝔸", "\x07", "½", "\n", "漢"]
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        got, align = own.normalise(text.encode())
        want, places = library.normalize(text, with_offsets=True)
        assert got.decode() == want, repr(text)
        to = np.cumsum([0, *(len(c.encode()) for c in text)])
        begins = np.cumsum([0, *(len(c.encode()) for c in want)])
        # the library counts a blank in front, which has no source, to the first character
        assert [int(align[b]) for b in begins[:-1]] == [int(to[p]) for p in places[:-1]], repr(text)


def _map_of(source: bytes, target: bytes) -> bytes:
    """A double array with one chain, each node in a block of its own."""
    import struct

    units = [0] * (256 * (len(source) + 2))
    node = 0
    for i, b in enumerate(source):
        child = 256 * (i + 1)
        units[node] |= (child ^ node) << 10
        node = child ^ b
        units[node] = b
    leaf = 256 * (len(source) + 1)
    units[node] |= (leaf ^ node) << 10 | 1 << 8
    units[leaf] = 1 << 31
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + target + b"\0"


def contaminated(docs, tests):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in tests:
        w = find(text)
        for i in range(max(0, len(w) - 13) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, items = find(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    items |= windows[k]
        out[doc] = (len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_decontamination(spark, odd, none, block):
    rng = random.Random(7)
    tests = [(10, prose(rng, 40)), (9, prose(rng, 20)), (8, "q1 q2 q3"), (7, ""), (6, None), (5, "q1 q2 q3")]
    texts = [prose(rng, 100), prose(rng, 50) + " " + tests[0][1].upper() + "! " + prose(rng, 30), tests[1][1][10:], "z q1, q2 q3 z " * 3, prose(rng, 2000) + " q1 q2 q3", None, "", tests[0][1] + " " + tests[1][1]]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.find_contaminated(table(spark, texts), bench, block_bytes=block).collect()}
    assert got == contaminated(list(enumerate(texts)), [t for t in tests if t[1] is not None])
    # rows without an id, and rows that share one, are told apart
    alike = [(None, texts[1]), (None, "clean words only"), (None, ""), (None, None), (7, texts[0]), (7, tests[0][1]), (7, tests[0][1])]
    rows = decontam.find_contaminated(spark.createDataFrame(alike, "doc_id long, text string"), bench, block_bytes=block).collect()
    want = [(d, *contaminated([(0, t)], [x for x in tests if x[1] is not None])[0]) for d, t in alike]
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows), key=key) == sorted(want, key=key)
    assert decontam.find_contaminated(odd, bench, block_bytes=block).count() == 14 and decontam.find_contaminated(none, bench).count() == 0
    assert decontam.find_contaminated(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert {r.doc_id for r in decontam.drop_contaminated(table(spark, texts), bench, block_bytes=block).collect()} == {k for k, v in got.items() if not v[3]}


def test_large_benchmarks():
    """Windows of some MB of items are flat arrays: the memory is a small multiple of the text."""
    import tracemalloc

    rng = np.random.default_rng(4)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 400)) for _ in range(800)]
    size = sum(map(len, items))
    rows = pa.table({"item_id": [str(i) for i in range(800)], "text": items})
    tracemalloc.start()
    got = decontam.prepare(rows, 13)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(got.pos) == 800 * 388 and peak < 80 * size and sum(x.nbytes for x in vars(got).values() if hasattr(x, "nbytes")) < 12 * size + (1 << 21)


def kept(rows):
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, doc), doc)
    out = {}
    for doc, text in rows:
        w, gone = split(text), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < doc:
                gone |= set(range(i, i + 13))
        out[doc] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("vocabulary", [3, 40, 5000])
def test_substrings(spark, vocabulary):
    """Few words make runs and overlaps, many make prose; passages are copied between texts."""
    rng = random.Random(vocabulary)
    texts = [prose(rng, rng.randrange(5, 150), vocabulary) for _ in range(40)]
    for _ in range(40):
        source = split(rng.choice(texts))
        a = rng.randrange(len(source))
        i = rng.randrange(len(texts))
        texts[i] += " " + " ".join(source[a : a + rng.randrange(10, 60)])
    texts += [texts[3], texts[5], "a " * 30, "b " + "a " * 25, "a b " * 20]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(table(spark, texts)).collect()}
    assert got == kept(list(enumerate(texts)))


def test_substrings_odd(odd, none):
    got = substrings.remove_repeats(odd).collect()
    want = kept([(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()])
    assert len(got) == 14 and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert substrings.remove_repeats(none).count() == 0
    cut = {r.doc_id: r.text for r in substrings.cut_repeats(odd).collect()}
    assert cut[0] is None and cut[5] == "" and cut[10].startswith("x") and substrings.cut_repeats(odd).columns == odd.columns


def thue_morse(k):
    """Two strings that differ at every byte and that a polynomial modulo a power of two takes for one."""
    x = "a"
    for _ in range(k):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [10, 11, 13])
def test_long_words_apart(spark, k):
    """Words built to collide under the old hash, in windows and as whole copies; and long sequences of two such words."""
    x, y = thue_morse(k)
    common = "c1 c2 c3 c4 c5 c6 c7 c8 c9 c10 c11 c12"
    order = thue_morse(12)[0]
    texts = [f"{common} {x}", f"{common} {y}", f"{common} {x} tail", " ".join(order), " ".join(thue_morse(12)[1])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(table(spark, texts)).collect()}
    assert got == kept(list(enumerate(texts))) and got[1][1] == 0 and got[2][1] == 13
    w = words.of(pa.array([f"{x} {y}"]))
    assert w.hash[0] != w.hash[1] and w.other[0] != w.other[1] and w.hash[0] != w.other[0]
    # a hash does not depend on the words beside it
    alone = words.of(pa.array(["ab"]))
    beside = words.of(pa.array([f"{x} ab {y}"]))
    assert (alone.hash[0], alone.other[0]) == (beside.hash[1], beside.other[1])


def test_substrings_without_filters(spark, monkeypatch):
    """Where the filters are full, the exact joins decide alone: the same result."""
    rng = random.Random(17)
    passage = prose(rng, 40)
    texts = [f"{prose(rng, 30, 60)} {passage} {prose(rng, 30, 60)}" if i % 3 == 0 else prose(rng, 90, 60) for i in range(60)] + ["a b " * 40, "z " * 40, "y " + "z " * 30, "a b " * 40]
    want = kept(list(enumerate(texts)))
    for bits in (27, 12):
        monkeypatch.setattr(substrings, "membership", lambda df, column, bits=bits: common.membership(df, column, bits) if bits > 12 else common.Filter(np.full(64, 2**64 - 1, np.uint64), 52))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(table(spark, texts)).collect()}
        assert got == want
    # more copies than are broadcast
    monkeypatch.setattr(substrings, "BROADCAST", 0)
    for bits in (27, 12):
        monkeypatch.setattr(substrings, "membership", lambda df, column, bits=bits: common.membership(df, column, bits) if bits > 12 else common.Filter(np.full(64, 2**64 - 1, np.uint64), 52))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(table(spark, texts)).collect()}
        assert got == want
    # a key of most rows is joined by broadcast, the others by shuffle
    monkeypatch.setattr(common, "HOT", 3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(table(spark, texts)).collect()} == want


def test_repeats_are_compared(spark, monkeypatch):
    """Where names of different windows collide, nothing is removed that no other document said before: the words decide."""
    rng = random.Random(23)
    texts = [prose(rng, 60) for _ in range(4)]
    texts.append(texts[0][:200] + " " + texts[1][:200])
    docs = table(spark, texts)
    assert substrings.remove_repeats(docs).where("n_removed > 0").count() == 1
    docs = substrings._plain(docs, "doc_id", "text")
    said = "doc_id long, h long, text string, begins array<int>, firsts array<long>"
    repeats = spark.createDataFrame([(2, 7, texts[2], [0, 1, 30], [0, 0, 0])], said)
    assert substrings._compared(docs, repeats, 13).count() == 0
    good = spark.createDataFrame([(4, 7, texts[4], [0, 1, 2], [0, 0, 0])], said)
    assert [sorted(r.begins) for r in substrings._compared(docs, good, 13).collect()] == [[0, 1, 2]]


def test_symbols():
    """Equal windows have equal symbols wherever they stand, levels go on until none fits, and each new symbol spans words of its reach."""
    rng = random.Random(2)
    for vocabulary in (2, 30, 3000):
        part = split(prose(rng, 13, vocabulary))
        texts = [" ".join(split(prose(rng, rng.randrange(40), vocabulary)) + part + split(prose(rng, rng.randrange(40), vocabulary))) for _ in range(20)]
        w = words.of(pa.array(texts))
        begin, key = substrings.anchors(w)
        at = [int(w.first[i]) + next(j for j in range(10**6) if split(t)[j : j + 13] == part) for i, t in enumerate(texts)]
        assert len(set(key[np.searchsorted(begin, at)].tolist())) == 1
        found = list(substrings.levels(w, 13))
        assert 1 <= len(found) <= 8 and all(len(x.fits(13, len(w.start))) for x in found[1:])


def linked(rows):
    sets = {}
    for doc, text in rows:
        w = split(lower(text))
        sets[doc] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_ngram_join(spark):
    rng = random.Random(3)
    texts = [prose(rng, 80) for _ in range(6)]
    shared = prose(rng, 40)
    for i in range(60):
        w = split(texts[i % 6])
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 20) + " " + shared for _ in range(20)] + [texts[0].upper(), "one two", "One Two", "", None, "one"]
    big = split(prose(rng, 3000))
    texts += [" ".join(big), " ".join(big[:2900]), " ".join(big[:1500] + split(prose(rng, 1500)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.linked(table(spark, texts)).collect()}
    assert got == linked(list(enumerate(texts)))
    left = {r.doc_id for r in ngrams.drop_near_copies(table(spark, texts)).collect()}
    assert left == {c for _, c in got.values()}


def test_ngram_join_odd(odd, none):
    got = ngrams.linked(odd).collect()
    want = linked([(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()])
    assert len(got) == 14 and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert ngrams.linked(none).count() == 0


def test_toxicity(spark, odd, none):
    rng = random.Random(9)
    bad = ["idiot", "scum"]
    texts = [prose(rng, 100) + (f" {rng.choice(bad)} {rng.choice(bad)} " if i % 4 == 0 else " ") + prose(rng, 40) for i in range(300)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    assert all(got[i].toxic == (i % 4 == 0) for i in range(200, 300)) and all(0 <= r.severity <= 2 for r in got.values())
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {i for i, r in got.items() if not r.toxic}
    assert toxicity.grade(odd, model).where("toxic").count() == 0 and toxicity.grade(none, model).count() == 0
    assert toxicity.grade(docs, toxicity.fit(docs, labels.limit(0))).where("toxic").count() == 0


def counted(text):
    w = split(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(repeated)


def test_quality(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    refs = quality.references(docs)
    for source in (docs, odd):
        texts = {r.doc_id: r.text for r in source.collect()}
        for r in quality.judge(source, refs).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(texts[r.doc_id]), r.doc_id
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    judged = [(r.kept, good[r.doc_id]) for r in quality.judge(docs, refs).collect() if r.doc_id in good and not r.base_failed]
    assert sum(k == q for k, q in judged) >= 0.95 * len(judged)
    assert quality.judge(none, refs).count() == 0 and quality.judge(odd, quality.references(none)).count() == 14


def test_quality_of_every_language(spark):
    """More than 200 languages, of which each has its own words; clean texts of the smallest are kept."""
    from pyspark.sql import functions as F

    rng = random.Random(8)

    def text(i, n):
        return " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{rng.choice('abcdefgh')}{rng.choice('eta')}" for _ in range(n))

    rows = [(10 * i + k, text(i, 120 if i < 219 else 90), f"l{i:03}", "s", 0) for i in range(220) for k in range(2)]
    docs = spark.createDataFrame(rows, DOCS)
    refs = quality.references(docs)
    assert refs.names == sorted({r[2] for r in rows})
    got = {r.doc_id: r for r in quality.judge(docs, refs).collect()}
    assert len(got) == len(rows) and all(got[10 * 219 + k].kept for k in range(2))
    # without its label a text is held against the nearest language, which is its own
    blind = {r.doc_id: r for r in quality.judge(docs.withColumn("lang", F.lit(None).cast("string")), refs).collect()}
    assert all((r.character_distance, r.word_distance) == pytest.approx((blind[k].character_distance, blind[k].word_distance)) for k, r in got.items())


def test_distance():
    assert quality.distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == 1.0 and quality.distance(np.array([[0.5, 0.5]]), np.array([0.5, 0.5]))[0] == 0.0


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there general!\nHow are you doing today?"),
        (1, 1, "assistant", "> how are you  doing today\nI am fine, thanks to you all."),
        (1, 2, "user", "> I am fine, thanks to you all.\n>> How are you doing today?\n\nGood to hear that from you."),
        (1, 3, "user", "> Hello there general\n> how are you doing today?\nNobody replied to the first one"),
        (1, 4, "user", "no quotes > here"),
        (2, 0, "user", None),
        (None, 1, "user", "x"),
        (2, 1, "user", "> Hello there general!\nother conversation"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 8
    pick = lambda *k: (got[k].parent_turn, got[k].thread, got[k].depth, got[k].n_quotes, got[k].n_linked)
    assert pick(1, 1) == (0, 0, 1, 1, 1) and pick(1, 2) == (1, 0, 2, 2, 2) and pick(1, 3) == (0, 0, 1, 1, 1)
    assert pick(1, 4) == (3, 4, 0, 0, 0) and pick(2, 1) == (0, 1, 0, 1, 0) and pick(None, 1)[0] is None
    assert got[1, 2].body == "Good to hear that from you." and got[1, 4].body == "no quotes > here" and got[2, 0].body == ""
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_short_quotations(spark):
    """Short messages and texts without blanks are linked; a common short line gives way to a longer one."""
    rows = [
        (1, 0, "Yes, do it"),
        (1, 1, "我同意这个计划"),
        (1, 2, "?"),
        (1, 3, "filler"),
        (1, 4, "> Yes, do it\nOn it"),
        (1, 5, "> 我同意这个计划。\n好"),
        (1, 6, "> ?\nMeaning?"),
        (1, 7, ">\n> \nnothing quoted"),
        (2, 0, "ok\nthe whole of a longer message"),
        (2, 1, "ok"),
        (2, 2, "> ok\n> the whole of a longer message\nthen"),
        (2, 3, "> ok\n> words that nobody wrote\nthen"),
        *[(3, i, "yes") for i in range(0, 5000, 50)],
        *[(3, i + 7, "> yes\nindeed") for i in range(0, 5000, 50)],
        (3, 9000, "> yes\nmuch later"),
    ]
    docs = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_linked) for r in quotes.link(docs).collect()}
    assert len(got) == len(rows)
    assert [got[1, i] for i in (4, 5, 6, 7)] == [(0, 1), (1, 1), (2, 1), (6, 0)]
    assert got[2, 2] == (0, 1) and got[2, 3] == (1, 1) and got[3, 9000] == (4950, 1)
    assert all(got[3, i + 7] == (i, 1) for i in range(0, 5000, 50))


def threads(rows):
    """Parents and paths of messages by the rules, in plain Python."""
    import unicodedata

    def plain(x):
        x = re.sub(r"\s+", " ", x.lower())
        while x and (x[0].isspace() or unicodedata.category(x[0])[0] == "P"):
            x = x[1:]
        while x and (x[-1].isspace() or unicodedata.category(x[-1])[0] == "P"):
            x = x[:-1]
        return x

    parts = lambda t: {plain(t) or re.sub(r"\s+", "", t), *map(plain, t.split("\n"))} - {""}
    bodies, quoted = {}, {}
    for turn, text in rows:
        runs = []
        for line in (text or "").split("\n"):
            depth = re.match(r"^[ \t]*((?:>[ \t]?)*)", line).group(1).count(">")
            line = re.sub(r"^[ \t]*(?:>[ \t]?)+", "", line)
            if runs and runs[-1][0] == depth:
                runs[-1][1].append(line)
            else:
                runs.append((depth, [line]))
        has = any(d for d, _ in runs)
        bodies[turn] = "\n".join("\n".join(x) for d, x in runs if not d).strip(" \t\n") if has else text or ""
        quoted[turn] = [(d, "\n".join(x)) for d, x in runs if d]
    out = {}
    for turn in sorted(bodies):
        found = []
        for d, q in quoted[turn]:
            hits = [(len(p), s) for s in bodies if s < turn for p in parts(q) & parts(bodies[s])]
            if hits:
                found.append((d, -max(hits)[1]))
        parent = -min(found)[1] if found else None
        out[turn] = (parent, len(quoted[turn]), len(found), [*out[parent][3], turn] if found else [turn])
    return out, bodies


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotations_at_random(spark, seed):
    """Random threads with nested, broken, repeated and unknown quotes against the rules; paths put replies under what they quote."""
    rng = random.Random(seed)
    said = ["Yes", "yes!", "see you at noon", "Noon it is.", "what about the\nother plan", "no idea", "漢字です", "...", "one\n\ntwo"]
    rows = []
    for conv in range(6):
        texts = []
        for _ in range(25):
            text = rng.choice(said)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                source = rng.choice(texts) if texts and rng.random() < 0.85 else "nobody said this"
                mark = rng.choice(["> ", ">", "> > ", ">>"])
                text = "\n".join(mark + x for x in source.split("\n")) + "\n" + text
            texts.append(text if rng.random() > 0.04 else None)
            texts = [t or "" for t in texts]
        rows += [(conv, 3 * i, "user", t) for i, t in enumerate(texts)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for conv in range(6):
        want, bodies = threads([(t, x) for c, t, _, x in rows if c == conv])
        order = sorted(want)
        for r in (r for r in got if r.conv_id == conv):
            parent, n_quotes, n_linked, path = want[r.turn]
            before = order[order.index(r.turn) - 1] if r.turn else None
            assert (r.parent_turn, r.n_quotes, r.n_linked, r.path, r.thread, r.depth) == (before if parent is None else parent, n_quotes, n_linked, path, path[0], len(path) - 1), (conv, r.turn)
            assert r.body == bodies[r.turn]
        paths = sorted(r.path for r in got if r.conv_id == conv)
        assert all(p[:-1] in paths[:i] for i, p in enumerate(paths) if len(p) > 1)


def test_long_quotations(spark):
    """Thousands of passages in one message: each line is copied once."""
    text = "\n".join(f"> line {i}\nanswer {i}" for i in range(4000))
    rows = [(1, 0, "user", "\n".join(f"line {i}" for i in range(4000))), (1, 1, "user", text)]
    got = {r.turn: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_quotes, got[1].n_linked, got[1].parent_turn) == (4000, 4000, 0) and got[1].body.count("\n") == 3999


def test_columns_of_any_name(spark):
    """Extra columns whose names the operators use themselves, dots in names, and no column lost or moved."""
    rng = random.Random(3)
    passage = prose(rng, 30)
    texts = [passage, f"{prose(rng, 20)} {passage}", f"{passage}", "", None, f"{passage} x"]
    names = ["row", "id", "new", "begins", "_begins", "_gone", "_of", "_bad", "one", "two", "n", "a.b", "tag", "component_id", "first", "hit"]
    docs = table(spark, texts)
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for step in (substrings.cut_repeats, ngrams.drop_near_copies, lambda d: decontam.drop_contaminated(d, bench), lambda d: toxicity.drop_toxic(d, model)):
        got = step(docs)
        assert got.schema.names == docs.schema.names
        rows = got.collect()
        assert rows and all(r[name] == name for r in rows for name in names)
    assert {r.doc_id: r.text for r in substrings.cut_repeats(docs).collect()} == {0: passage, 1: " ".join(split(texts[1])[:20]), 2: "", 3: "", 4: None, 5: "x"}


def test_attention_gradients():
    """The hand-written gradients against differences."""
    rng = np.random.default_rng(1)
    v, counts = attention.vocabulary(np.array([5, 4, 3, 2, 1, 0]))
    sample = [rng.integers(0, v.size, n) for n in (3, 50, 0)]
    model = attention.Model(counts + 1.0, np.array([0, 0, 1, 1, 2, 2, 2]))
    for k, w in model.p.items():
        model.p[k] = w.astype(np.float64)
    x, y, on, _ = next(attention.windows(sample, v))
    assert on.sum() == sum(len(s) + 1 for s in sample)
    _, g = model.gradients(x, y, on)
    for k in ("E", "Q", "V", "R", "A", "C", "W"):
        w = model.p[k]
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        w[at] += 1e-5
        up = model.gradients(x, y, on)[0]
        w[at] -= 2e-5
        down = model.gradients(x, y, on)[0]
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_attention_reach():
    """Every subword has a number, each sees at least half a window, and what may follow sums to 1."""
    rng = np.random.default_rng(2)
    v, counts = attention.vocabulary(np.append(rng.integers(1, 9, 5000), 0))
    assert v.size == 5000 and len(set(v.number[:5000].tolist())) == 5000 and v.number[5000] == v.other
    group = attention.groups(rng.random((len(counts), 64)).astype(np.float32), counts)
    assert len(group) == 5002 and np.bincount(group).max() <= 4 * 71
    model = attention.Model(counts + 1.0, group)
    model.p["R"][:] = 0
    text = rng.integers(0, 5000, 200)
    before = attention.score_each(model, v, [text])
    assert len(before) == 201
    for back in (1, 20, 32):
        for at in (32, 63, 64, 65, 100, 127, 128, 200):
            other = text.copy()
            other[at - back] = (other[at - back] + 1) % 5000
            after = attention.score_each(model, v, [other])
            assert after[at] != before[at] and (after[: at - back] == pytest.approx(before[: at - back], abs=1e-4)), (at, back)
    x, _, _, _ = next(attention.windows([v.number[text]], v))
    y = np.arange(v.size + 2).reshape(-1, 1)
    last = np.repeat(x[2:3], len(y), 0)
    on = np.zeros((len(y), attention.WINDOW - attention.OVERLAP), bool)
    on[:, 7] = True
    assert np.exp(model.score(last, np.repeat(y, on.shape[1], 1), on).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_attention_alone():
    """Batched scores of texts of all lengths against a loop over one text, subword by subword, and against the windows that learn."""
    rng = np.random.default_rng(6)
    v, counts = attention.vocabulary(np.append(rng.integers(1, 9, 300), 0))
    model = attention.Model(counts + 1.0, attention.groups(rng.random((len(counts), 64)).astype(np.float32), counts))
    p, step = model.p, attention.WINDOW - attention.OVERLAP
    texts = [rng.integers(0, 300, n) for n in (0, 1, 31, 32, 33, 64, 200)]
    got = np.split(attention.score_each(model, v, texts), np.cumsum([len(x) + 1 for x in texts])[:-1])
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for text, scores in zip(texts, got, strict=True):
        seen, target = [v.begin, *v.number[text]], [*v.number[text], v.end]
        for t, y in enumerate(target):
            low = max(0, t // step * step - attention.OVERLAP)
            e = p["E"][seen[low : t + 1]]
            weight = softmax(e @ p["K"] @ (e[-1] @ p["Q"]) * attention.WIDTH**-0.5 + p["R"][np.arange(t - low, -1, -1)])
            h = e[-1] + weight @ (e @ p["V"]) @ p["O"]
            z = h + np.maximum(h @ p["A"] + p["a"], 0) @ p["B"] + p["b"]
            g = model.group[y]
            a, b = model.first[g], model.first[g + 1]
            want = np.log(softmax(z @ p["C"] + p["c"])[g]) + np.log(softmax(z @ p["W"][:, a:b] + p["w"][a:b])[model.slot[y]])
            assert scores[t] == pytest.approx(want, abs=2e-4), (len(text), t)
    numbers = [v.number[x] for x in texts]
    slow = np.concatenate([model.score(x, y, on) for x, y, on, _ in attention.windows(numbers, v)])
    assert np.allclose(np.concatenate(got), slow, atol=1e-4)
    assert sum(len(x) for x, *_ in attention.windows(numbers, v, every=3)) == -(-sum(-(-(len(x) + 1) // step) for x in texts) // 3)


def test_scores_are_a_distribution(spark):
    """The probabilities of all that may follow a text add up to 1 in the mixture that scores."""
    path = P.path("piece_bpe_32k.model")
    texts = ["the cat sat on the mat and the dog ran"] * 5 + ["a dog ran to the cat"] * 3
    docs = table(spark, texts).withColumn("held_out", F.lit(False))
    blocks = docs.select("doc_id", "text", "held_out").mapInArrow(scoring._blocks(path), scoring.BLOCK)
    rows = blocks.collect()
    pairs = Counter()
    for r in rows:
        pairs.update(dict(zip(r.pairs, r.pair_counts, strict=True)))
    learned = scoring.learn(docs.select("doc_id", "text"), spark.createDataFrame(list(pairs.items()), "key long, c long"), path, blocks)
    n = len(learned.own) - 1
    start = scoring.subwords(path, pa.array(["the cat"]))[0]
    far = learned.followed(start[-1] * (n + 2) + np.arange(n + 1), np.array([pairs[int(start[-1]) * (n + 2) + i] for i in range(n + 1)]))
    flat = np.concatenate([np.concatenate([start, [i], [n]]) for i in range(n)] + [np.append(start, n)])
    size = np.array([len(start) + 2] * n + [len(start) + 1])
    near = np.exp(attention.score_flat(attention.Scorer(learned.model), learned.vocabulary, flat, size))
    after = near[np.cumsum(size) - np.where(np.arange(n + 1) < n, 2, 1)]
    assert (learned.mix * after + (1 - learned.mix) * far).sum() == pytest.approx(1, abs=1e-3)


def test_weights_learn_from_every_partition(spark):
    """Averaged changes come from all partitions: they do not depend on how rows are dealt, but for the order, and fit the texts better."""
    path = P.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 5 == 1).alias("held_out"))
    blocks = docs.repartition(3).mapInArrow(scoring._blocks(path), scoring.BLOCK).cache()
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("x")).groupBy(F.col("x.pairs").alias("key")).agg(F.sum("x.pair_counts").alias("c")).where("c > 0")
    first = scoring.learn(docs.where("not held_out"), pairs, path, sample_bytes=50_000)
    more = scoring.refine(blocks, first, every=1)
    one = scoring._distinct(words.of(pa.array(["a b c " * 40, None, "d", ""])), path)[0]
    some, opens, closes = scoring._spans(one, np.array([True, True, False, True]), 1)
    assert some.n.tolist() == [48, 48, 24, 0, 0] and opens.tolist() == [True, False, False, True, True] and closes.tolist() == [False, False, True, True, True]
    held = scoring.subwords(path, pa.array([r.text for r in docs.where("held_out and text is not null").limit(30).collect()]))
    fit = [attention.score_each(x.model, x.vocabulary, held).mean() for x in (first, more)]
    assert fit[1] > fit[0]
    assert scoring.refine(blocks.where("block < 0"), first) is first
    # the rounds together take every span once, whatever their number
    def spans(every):
        out = []
        for turn in range(every):
            some, opens, closes = scoring._spans(one, np.array([True, True, False, True]), every, turn)
            tokens = np.split(some.tokens, np.cumsum(some.n)[:-1]) if len(some.n) else []
            out += [(tuple(t.tolist()), bool(o), bool(c)) for t, o, c in zip(tokens, opens, closes, strict=True)]
        return sorted(out)

    assert spans(1) == spans(3) == spans(7)
    rest = scoring._resting([None, *range(6400)])
    assert not rest[0] and 50 < rest.sum() < 150


def test_gradients(spark):
    """The gradient of embeddings, where one subword stands in many places and before a text, against differences."""
    rng = np.random.default_rng(5)
    v, counts = attention.vocabulary(np.array([9, 5, 3, 2, 1]))
    counts[v.end] = 4
    model = attention.Model(counts.astype(float), np.arange(len(counts)) % 3)
    model.p = {k: w.astype(float) for k, w in model.p.items()}
    x, y, on, _ = next(attention.windows([rng.integers(0, 5, n) for n in (3, 70, 0)], v))
    grads = model.gradients(x, y, on)[1]
    for row in (0, 3, v.begin):
        w = model.p["E"]
        old = w[row, 2]
        w[row, 2] = old + 1e-3
        more = model.gradients(x, y, on)[0]
        w[row, 2] = old - 1e-3
        less = model.gradients(x, y, on)[0]
        w[row, 2] = old
        assert grads["E"][row, 2] == pytest.approx((more - less) / 2e-3, rel=0.02, abs=1e-4)


def test_scores(spark, odd, none):
    path = P.path("piece_bpe_32k.model")
    from pyspark.sql import functions as F

    marked = odd.withColumn("held_out", F.col("doc_id") % 4 == 1)
    rows = marked.collect()
    train = Counter(w for r in rows if not r.held_out for w in [*split(lower(r.text)), None])
    n, v = sum(train.values()), len(train)
    got = scoring.score(marked, path).collect()
    assert len(got) == 14
    for r in got:
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        tokens = [*split(lower(text)), None]
        base = sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[w] > 0 for w in tokens), n) and abs(base - r.base_score) < 1e-6 * abs(base) + 1e-9 and r.score < 0
    assert scoring.score(none.withColumn("held_out", F.lit(True)), path).count() == 0


def test_scores_learn_from_all(spark):
    """Pairs, ends and long texts outside of a sample of next to nothing count; the score is a distribution."""
    import pyarrow as pa

    path = P.path("piece_bpe_32k.model")
    texts = ["the cat sat"] * 30 + ["a dog ran " * 15_000, None]
    docs = table(spark, texts).select("doc_id", "text")
    n = scoring._pieces(path).get_piece_size()
    sub = scoring.subwords(path, pa.array(texts))
    want = Counter()
    for x in sub:
        chain = [n + 1, *x.tolist(), n]
        want.update(a * (n + 2) + b for a, b in zip(chain, chain[1:]))
    cut = scoring._distinct(words.of(pa.array(texts), lower=True), path)[0]
    _, pairs, counts = scoring._counted(cut, np.ones(len(texts), bool))
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == dict(want)
    pairs = spark.createDataFrame(list(want.items()), "key long, c long")
    got = scoring.learn(docs, pairs, path, sample_bytes=1)
    assert got.seen.sum() == sum(want.values()) and got.seen[n + 1] == 32 and (got.kinds > 0).sum() == len({k // (n + 2) for k in want})
    for before in (sub[0][0], n + 1, n - 1):
        key = before * (n + 2) + np.arange(n + 1)
        c = np.array([want.get(k, 0) for k in key.tolist()])
        assert abs(got.followed(key, c).sum() - 1) < 1e-9
    share = np.exp(got.model.p["w"]) / np.exp(got.model.p["w"]).sum()
    assert abs(share[got.model.order == got.vocabulary.end][0] - 32 / (sum(want.values()))) < 0.01
    cut = scoring.sampled(docs, sample_bytes=1 << 40, sample_text=1000).to_pylist()
    long = sorted((r for r in cut if r["doc_id"] == 30), key=lambda r: r["nr"])
    assert "".join(r["text"] for r in long) == texts[30] and [r["opens"] for r in long] == [True] + [False] * 149 and [r["closes"] for r in long] == [False] * 149 + [True]
    # a word order that only the pair counts know beats its reverse
    held = spark.createDataFrame([(i, t, i > 31) for i, t in enumerate([*texts, "the cat sat", "sat cat the"])], "doc_id long, text string, held_out boolean")
    score = {r.doc_id: r.score for r in scoring.score(held, path).collect()}
    assert len(score) == 34 and score[32] > score[33] and score[0] == pytest.approx(score[32])


def test_pipeline(spark):
    """Each stage against brute force on what the stage before it kept."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "sentencepiece"] and pipeline.ORACLE_SQL is None
    stages = dict(pipeline.STAGES)
    clean = stages[names[0]](spark, docs, DATA)
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.grade(docs, model).where("not toxic").collect()} and clean.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    single = stages[names[1]](spark, clean, DATA)
    assert {r.doc_id for r in single.collect()} == {c for _, c in linked(rows).values()}
    rows = [(r.doc_id, r.text) for r in single.collect()]
    cut = stages[names[2]](spark, single, DATA)
    want = kept(rows)
    for r in cut.collect():
        assert hashlib.sha256(" ".join(split(r.text)).encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)
    rows = [(r.doc_id, r.text) for r in cut.collect()]
    left = stages[names[3]](spark, cut, DATA)
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert {r.doc_id for r in left.collect()} == {d for d, x in contaminated(rows, tests).items() if not x[3]}
    assert stages[names[4]](spark, left, DATA).count() == left.count()


def test_no_import_from_outside():
    """No module outside of the subpackage imports it."""
    import ast

    root = Path(__file__).resolve().parents[2] / "codehistory"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            names.append(getattr(node, "module", None) or "")
            assert not any("llm" in n.split(".") for n in names), path
