"""Collocations against brute force."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import odd
import pytest
from dossier.llm import phrases


def words_of(text):
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
        yield re.findall("[^ \t]+", piece)


def counted(rows):
    out = Counter()
    for lang, text in rows:
        for ws in words_of(text):
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    out[lang or "und", tuple(ws[i:i + k])] += 1
    return out


def by_hand(rows, least, top=2000, covered=80):
    f = counted(rows)
    n = Counter()
    for (lang, p), times in f.items():
        n[lang] += times if len(p) == 1 else 0
    held = {key: a for key, a in f.items() if a >= least}
    inner = {}
    for (lang, p), a in held.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = lang, p[i:i + k]
                inner[key] = max(inner.get(key, 0), a)
    out = {}
    for (lang, p), a in held.items():
        if len(p) > 1 and 100 * inner.get((lang, p), -1) < covered * a:
            cuts = [(floor(Fraction(2000000 * a, f[lang, p[:k]] + f[lang, p[k:]])), k)
                    for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append(
                (-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, rank, p.decode(), -a, left, right, n[lang], -score)
            for lang, found in out.items()
            for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


def texts(seed, size=60):
    chance = random.Random(seed)
    common, rare = ["a", "b", "É", "é", "the"], [f"r{k}" for k in range(40)]
    passage = [f"p{k}" for k in range(60)]
    out = []
    for k in range(size):
        words = [chance.choice(common if chance.random() < 0.7 else rare) for _ in range(80)]
        if k % 3 == 0:
            at = chance.randrange(20)
            words[10:10] = passage[at:at + chance.randint(3, 40)]
        text = "".join(w.upper() * (chance.random() < 0.2) or w
                       + chance.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "])
                       for w in words)
        out.append((chance.choice(["en", "en", "en", None, "fr"]), text))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def got(df):
    return sorted(tuple(r) for r in df.select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed, least, top", [(1, 5, 2000), (2, 3, 15), (3, 2, 2000)])
def test_collocations_equal_brute_force(spark, seed, least, top):
    rows = texts(seed)
    assert got(phrases.collocations(frame(spark, rows), least, top)) == sorted(
        by_hand(rows, least, top))


def test_stretches_salts_and_parts_change_nothing(spark):
    rows = texts(4, 90)
    want = {(lang, " ".join(p)): a for (lang, p), a in counted(rows).items()}
    docs = frame(spark, [(lang or "und", text) for lang, text in rows]).withColumnRenamed(
        "text", "body").repartition(5)
    hot = ({("en", "a b"), ("en", "the a"), ("fr", "a a")}, {("en", "a b", "a"), ("en", "a b", "")})
    for routes, chunk, places, gathered, most in [
            ((set(), set()), 1 << 20, 1 << 20, 1 << 20, 1 << 20), (hot, 300, 37, 50, 20),
            (hot, 3000, 1000, 1, 1), ((set(), set()), 1 << 20, 64, 200, 400)]:
        found = phrases._flows(phrases._sent(docs, routes, chunk, places), 3, gathered, most)
        sums, whole = Counter(), {}
        for r in found.collect():
            if r.part:
                sums[r.lang, r.phrase] += r.n
            else:
                assert (r.lang, r.phrase) not in whole
                whole[r.lang, r.phrase] = r.n
        assert not set(sums) & set(whole)
        assert {k: a for k, a in {**sums, **whole}.items() if a >= 3} == {
            k: a for k, a in want.items() if a >= 3}


def test_paths_are_compacted_and_hold_every_edge_once(spark):
    rows = texts(5, 120)
    found, _ = phrases.counts(frame(spark, rows), 2)
    edges, nodes = (found.filter(f"k = {k}").drop("k") for k in (4, 3))
    for rounds in (1, 4):
        paths = phrases._paths(edges, nodes, rounds).collect()
        held = Counter((p.lang, " ".join(p.words[i:i + 4]), p.n)
                       for p in paths for i in range(len(p.words) - 3))
        assert held == Counter((r.lang, r.phrase, r.n) for r in edges.collect())
        assert max(len(p.words) for p in paths) > 4
        assert max(len(p.words) for p in paths) <= 4 + 2 ** rounds


def test_odd_rows(spark):
    docs = odd.table(spark)
    rows = [(None, t) for _, t, *_ in odd.rows()]
    named = docs.withColumnRenamed("id", "lang").selectExpr("'en' as `a.b`", "map(1, 2) as m", "*")
    named = named.withColumn("lang", named.text.substr(1, 0)).withColumn("lang", named.body)
    want = [(lang.replace("und", "body"), *rest) for lang, *rest in by_hand(rows, 2)]
    assert got(phrases.collocations(named, 2)) == sorted(want)
    empty = odd.table(spark, empty=True).withColumnRenamed("id", "lang")
    assert got(phrases.collocations(empty)) == []
    blank = frame(spark, [(None, None), ("en", ""), ("en", " .,\n"), ("en", "word")])
    assert got(phrases.collocations(blank, 1)) == []


def test_a_long_text(spark):
    text = " ".join(odd.words(5000, k) + "." for k in range(40))
    rows = [("en", text), ("en", "w1 w2 w3 w4"), ("fr", text[:1000])]
    assert got(phrases.collocations(frame(spark, rows), 8)) == sorted(by_hand(rows, 8))


def test_large_counts_stay_exact(spark):
    rows = [(10**17 + 3, 10**18 + 7, 10**18 + 9), (2**62, 2**62, 2**62), (30, 31, 10**18),
            (4 * 10**12 + 1, 4 * 10**12 + 3, 4 * 10**12 + 5)]
    done = spark.createDataFrame(rows, "a long, l long, r long").select(
        "a", "l", "r", phrases.cut_score().alias("score")).collect()
    assert [x.score for x in done] == [floor(Fraction(2000000 * x.a, x.l + x.r)) for x in done]


def test_a_task_holds_a_bounded_stretch_of_text():
    """What a task holds while it cuts one chunk of text, words that never repeat included."""
    import tracemalloc

    import numpy as np

    words = np.random.default_rng(3).integers(0, 1 << 40, phrases.CHUNK_BYTES // 6)
    raw = b" ".join(b"%05x" % (w & 0xFFFFF) for w in words.tolist())
    raws = [raw[at:at + 6000] for at in range(0, len(raw), 6000)]
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in phrases._adjacency(raws, ["en"] * len(raws), (set(), set())))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 0.9 * len(words)
    assert peak < 100 << 20
