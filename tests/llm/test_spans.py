"""Runs, phrases and fingerprints against plain Python, and the odd cases that each defines."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from codehistory.llm import common, fingerprints, periodic, phrases, queries, substrings
from codehistory.llm.prefix import Prefix

DOCS = "doc_id long, text string, lang string, source string, row long, period int, h long, part int"


def table(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, 4) for i, t, lang in rows], DOCS)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(60)}" for _ in range(80))
    texts = [None, "", " \n\t", "one two", base, base, "a " * 50, "a b\t" * 40, "漢 字 é " * 9 + "z", base + " " + base + " " + base, " ".join(f"w{rng.randrange(900)}" for _ in range(20_000))]
    return [*((i, t, "en" if i % 2 else None) for i, t in enumerate(texts)), (4, base, None), (4, "other text here", "en"), (None, base, "en"), (None, "a " * 30, "fr")]


def test_prefix_hashes():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, 150_000)
    hashes, one = Prefix(x), lambda n: np.array([n])
    for _ in range(200):
        a, b = np.sort(rng.integers(0, len(x), 2)).tolist()
        n = int(rng.integers(0, min(12, len(x) - b) + 1))
        same = bool((x[a : a + n] == x[b : b + n]).all())
        assert bool(hashes.equal(one(a), one(b), one(n))[0]) == same
        assert (hashes.span(one(a), one(a + n))[0] == hashes.span(one(b), one(b + n))[0]) == same
        assert hashes.span(one(a), one(a + n))[0] == Prefix(x[a : a + n]).span(one(0), one(n))[0]
        most = min(90, len(x) - b)
        differ = np.flatnonzero(x[a : a + most] != x[b : b + most])
        assert hashes.forward(one(a), one(b), one(most))[0] == (differ[0] if len(differ) else most)
        most = min(90, a)
        differ = np.flatnonzero(x[a - most : a][::-1] != x[b - most : b][::-1])
        assert hashes.backward(one(a), one(b), one(most))[0] == (differ[0] if len(differ) else most)


def runs_of(x, least=12):
    """(start, length, period) by looking at every period."""
    out = set()
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and not any(x[i : j + p - q] == x[i + q : j + p] for q in range(1, p)):
                out.add((i, j + p - i, p))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def left_by(x, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(x) if k not in gone)


def made_up(rng):
    x = []
    while len(x) < rng.choice([5, 60, 250]):
        unit = [f"w{rng.randrange(rng.choice([2, 3, 40]))}" for _ in range(rng.randrange(1, 30))]
        x += rng.choice([unit * rng.randrange(2, 6) + unit[: rng.randrange(len(unit))], unit, ["w1"] * rng.randrange(40)])
    return x


@pytest.mark.parametrize("tile,group", [(16, 100), (64, 1 << 19), (4096, 1 << 19)])
def test_runs(spark, monkeypatch, tile, group):
    """Every run, however tiles lie across it."""
    monkeypatch.setattr(periodic, "TILE", tile)
    monkeypatch.setattr(periodic, "GROUP", group)
    for seed in range(60):
        x = made_up(random.Random(seed))
        numbers = {w: i for i, w in enumerate(dict.fromkeys(x))}
        found = periodic.solve(np.array([numbers[w] for w in x], np.int32), np.array([0, len(x)]))
        assert sorted((s, e - s, p) for s, e, p in (periodic._stitched(found) if len(found) else found).tolist()) == sorted(runs_of(x)), seed


def test_runs_when_hashes_collide(monkeypatch):
    """A longest common extension that is too long is noticed, and the tile is compared place by place."""
    x = [*range(100, 130), *[1, 2, 3, 4, 5, 6, 7, 8, 9, 10] * 4, *range(200, 240)]
    monkeypatch.setattr(Prefix, "forward", lambda self, a, b, most: most)
    found = periodic.solve(np.array(x, np.int32), np.array([0, len(x)]))
    assert {(s, e - s, p) for s, e, p in found.tolist()} == set(runs_of(x))


def test_runs_of_documents(spark):
    rng = random.Random(4)
    rows = odd_rows() + [(100 + k, "  ".join(made_up(rng)), "en") for k in range(25)]
    want = Counter()
    for i, t, _ in rows:
        x = split(t)
        r = runs_of(x) if len(x) < 1000 else []
        want[i, len(x), tuple(r), hashlib.sha256(left_by(x, r).encode()).hexdigest()] += 1
    got = periodic.find(table(spark, rows).repartition(3), texts=True).collect()
    assert Counter((r.doc_id, r.n_words, tuple((q.start, q.length, q.period) for q in r.runs), r.collapsed_sha256) for r in got) == want
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in got if r.collapsed is not None)
    assert periodic.find(table(spark, []).limit(0)).count() == 0


def test_long_runs(spark):
    """A text of one word and one of long periods, over many tiles."""
    rng = random.Random(3)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(9000)]
    texts = ["a " * 100_000, " ".join(["x", "y", *unit, *unit, *unit[:500], "z"])]
    got = {r.doc_id: [(q.start, q.length, q.period) for q in r.runs] for r in periodic.find(table(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got == {0: [(0, 100_000, 1)], 1: [(2, 18_500, 9000)]}


def test_repeating_texts(spark):
    """The texts of the query repeat what its definition says."""
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 40)), "en") for i in range(200)] + [(None, "a b", "en"), (7, None, "en")]
    want = Counter()
    for i, t, _ in rows:
        w, h = split(t), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[a + (k - a) % p] if k >= a else w[k] for k in range(n))
        want[i, t] += 1
    got = Counter((r.doc_id, r.text) for r in queries._repeating(table(spark, rows)).collect())
    assert {k: v for k, v in got.items() if k[1]} == {k: v for k, v in want.items() if k[1]} and sum(got.values()) == len(rows)


def mined(rows, top, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = {}, Counter()
    for _, text, lang in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            c.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        kept = []
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        for g, a in cand.items():
            inside = lambda d, g=g: any(d[i : i + len(g)] == g for i in range(len(d) - len(g) + 1))
            if any(len(d) > len(g) and 100 * b >= 80 * a and inside(d) for d, b in cand.items()):
                continue
            score, k = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]  # noqa: E741
    return sorted(out)


@pytest.mark.parametrize("top", [3, 40, 100_000])
def test_phrases(spark, top):
    """Few phrases (the threshold has to go down, as most of the best pairs lie in longer phrases), some, and all of them."""
    rng = random.Random(6)
    fixed = [[f"{a}{k}" for k in range(4)] for a in "pqrstuvw"]
    rows = []
    for i in range(150):
        w = []
        for _ in range(25):
            w += rng.choice(fixed) if rng.random() < 0.3 else [f"{rng.choice('Aabé漢')}{rng.randrange(6)}" for _ in range(rng.randrange(1, 4))]
            w[-1] += rng.choice(["", "", "", ".", ",\n", "\x0b", "\t"])
        rows.append((i, " ".join(w), rng.choice(["en", "en", "fr", None])))
    rows += [(1000, None, "en"), (1001, "", "xx"), (1002, "a a a a a a", "one"), rows[0], rows[0]]
    got = sorted(tuple(r) for r in phrases.mine(table(spark, rows).repartition(3), top, 4).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == mined(rows, top, 4)
    assert phrases.mine(table(spark, []).limit(0)).count() == 0


def test_worth_is_exact(spark):
    """Products beyond 64 bits."""
    a, l, r = 4_611_686_018_427_387_905, 6_917_529_027_641_081_857, 9_223_372_036_854_775_807  # noqa: E741
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._worth("a", "l", "r").alias("s")).first().s
    assert got == 2000000 * a // (l + r)


def test_fingerprints(spark):
    rng = random.Random(9)
    said = lambda n: " ".join("".join(rng.choice("abcdefé漢") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    for n in (1, 3, 40, 500, 4000):
        a, b = said(n), said(n)
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        x, again, y, e, moved = fingerprints.prints(pa.array([a, a, b, edited, said(5) + " " + a]))
        assert x == again and str(x) == str(again) and fingerprints.Print.parse(str(x)) == x and str(x) != str(y)
        assert fingerprints.likeness(x, again) == 1 and fingerprints.likeness(x, y) < 0.4 and fingerprints.likeness(x, e) == fingerprints.likeness(e, x) >= 0.55
        if n >= 40:
            assert fingerprints.likeness(x, y) == 0 and fingerprints.likeness(x, moved) > 0.8
        assert fingerprints.common_beginning(x, e) <= len(edited.encode()) and len(str(x)) < 1200
    one, two, nothing = fingerprints.prints(pa.array(["a" * 30_000, "a" * 20_000 + "b" * 10_000, None]))
    assert 0.55 < fingerprints.likeness(one, two) < 0.7 and fingerprints.likeness(one, nothing) == 0 and fingerprints.likeness(nothing, nothing) == 1


def test_fingerprints_beside_the_next(spark):
    """Every row with the next one, over partitions and within; ids that repeat and that are missing too."""
    rng = random.Random(2)
    rows = odd_rows() + [(50 + k, " ".join(f"v{rng.randrange(99)}" for _ in range(rng.randrange(60))), "en") for k in range(120)]
    plain = sorted({i for i, _, _ in rows if i is not None}, reverse=True)
    texts = {i: sorted(t or "" for j, t, _ in rows if j == i) for i in plain}
    for parts in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = fingerprints.with_edited(table(spark, rows).repartition(5), queries._last_third).collect()
        assert len(got) == len(rows) and sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t, _ in rows)
        by = {r.doc_id: r for r in got if len(texts.get(r.doc_id, [])) == 1}
        for i, after in zip(plain, plain[1:], strict=False):
            if len(texts[i]) == len(texts[after]) == 1:
                t, following = texts[i][0], texts[after][0]
                n = len(t) // 3
                edited = t[: len(t) - n] + following[:n]
                a, b, e = fingerprints.prints(pa.array([t, following, edited]))
                r = by[i]
                assert (r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (hashlib.sha256(edited.encode()).hexdigest(), str(a), str(e))
                assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, e), fingerprints.likeness(a, b))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    alone = fingerprints.with_edited(table(spark, [(5, "one text here", "en")]), queries._last_third).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    # without ids the last row is followed by the first again
    two = {r.n_chars: r.edited_sha256 for r in fingerprints.with_edited(table(spark, [(1, "abcdef", "en"), (2, "uvwxyz123", "en")]), queries._last_third).collect()}
    assert two == {6: hashlib.sha256(b"abcduv").hexdigest(), 9: hashlib.sha256(b"uvwxyzabc").hexdigest()}
    assert fingerprints.with_edited(table(spark, []).limit(0), queries._last_third).count() == 0
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(table(spark, [(5, "one text here", "en")])).collect()} == {5: alone[0].fingerprint}


def removed_by_words(rows, window=13):
    """(id, kept text) of each row, with what an id says in any of its rows counted as said by it."""
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i) if i is not None else first.get(key, 10**9)
    out = []
    for i, t in rows:
        w = split(t)
        gone = {k + j for k in range(len(w) - window + 1) for j in range(window) if i is not None and first[tuple(w[k : k + window])] < i}
        out.append((i, hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 5])
def test_repeats_of_rows_that_share_an_id(spark, monkeypatch, bits):
    """Different texts under one id, repeats between them and by others; with names of few bits, which collide, too."""
    monkeypatch.setattr(substrings, "NAME_BITS", bits)
    rng = random.Random(12)
    a, b, c = prose(rng, 40), prose(rng, 40), prose(rng, 60)
    rows = [(1, a), (1, b), (1, a), (2, prose(rng, 5) + " " + a), (2, b[10:] + " " + c), (3, c), (3, a + " " + b), (4, b), (4, prose(rng, 30)), (5, prose(rng, 30) + " " + c + " " + a), (None, a), (6, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert got == removed_by_words(rows)
    texts = sorted(((r.doc_id, hashlib.sha256(" ".join(split(r.text)).encode()).hexdigest()) for r in substrings.cut_repeats(docs).collect()), key=str)
    assert texts == got


def test_what_repeats_no_longer_need_goes(spark):
    folder = Path(common.shared_dir(spark))
    before = set(folder.iterdir())
    rows = odd_rows()
    found = substrings.remove_repeats(table(spark, rows))
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before if not p.name.startswith(".")}
    assert left == {"contents", "copies", "repeats"}
    assert found.count() == len(rows)


def test_what_chance_shares_is_not_joined(spark):
    """Short sequences that many texts share by chance, and no repeat: less than 60 percent of the windows are left for the joins (two rounds leave 77)."""
    rng = random.Random(4)
    docs = substrings._plain(table(spark, [(i, prose(rng, 100, 20), "en") for i in range(400)]), "doc_id", "text")
    filters = spark.sparkContext.broadcast(substrings._filters(docs, 13))
    left = docs.mapInArrow(substrings._stretches(13, filters), "doc_id long, h long, at int, text binary")
    assert sum(len(r.text.split()) - 12 for r in left.collect()) < 0.6 * 400 * 88


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_only_rows_that_share_an_id_need_a_hash(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "BROADCAST", most)
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "c"), (None, "d"), (None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in substrings._plain(docs, "doc_id", "text", substrings._again(docs, "doc_id")).collect():
        found.setdefault(r.doc_id, []).append(r.h)
    # a table of more such ids than are broadcast has a hash in every row
    assert len(set(found[1])) == 2 and len(set(found[3])) == 1 and (found[2] == [0]) == (most > 1) and len(found[None]) == 2
    alone = docs.where("doc_id = 2")
    assert [r.h for r in substrings._plain(alone, "doc_id", "text", substrings._again(alone, "doc_id")).collect()] == [0]
