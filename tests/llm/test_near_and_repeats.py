"""SimHash classes, components and repeated passages against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import odd
from dossier.llm import components, repeats, simhash
from dossier.llm.wordhash import Words, sliding

SPACE = rb"[^\x20\x09-\x0D]+"


def fingerprint(text, shingle=3):
    words = re.findall(SPACE, (text or "").encode().lower())
    if not words:
        return 0
    parts = [b" ".join(words[k:k + shingle]) for k in range(max(len(words) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: dict, distance: int) -> dict:
    """Least key reachable over links, by comparing all pairs."""
    least = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= distance and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


@pytest.mark.parametrize("crowd", [1, 64])
@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_join_what_is_near(spark, crowd, distance):
    chance = random.Random(distance)
    seeds = [chance.getrandbits(64) for _ in range(6)]
    prints = {}
    for k in range(60):
        value = chance.choice(seeds)
        for _ in range(chance.randint(0, 4)):
            value ^= 1 << chance.randrange(64)
        prints[k] = value
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in prints.values()})
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance,
                          crowd=crowd).collect()
    reached = {v: v for v in signed}
    for _ in signed:
        for e in edges:
            reached[e.a] = reached[e.b] = min(reached[e.a], reached[e.b])
    want = classes({v: v & (1 << 64) - 1 for v in signed}, distance)
    assert all((reached[a] == reached[b]) == (want[a] == want[b]) for a in signed for b in signed)
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= distance for e in edges)


def test_classes_of_texts(spark):
    base = odd.words(300, 5)
    texts = [base, base.upper(), base + " tail", base.replace("w7", "x7", 1), odd.words(300, 6),
             None, "", " \x0b ", "ab", "AB", "a b", odd.words(5000, 7)]
    got = {r.doc_id: r for r in simhash.near_classes(odd.plain(spark, texts)).collect()}
    prints = {k: fingerprint(t) for k, t in enumerate(texts)}
    want = classes(prints, 3)
    for k in prints:
        assert (got[k].fingerprint, got[k].component_id) == (f"{prints[k]:016x}", want[k])
    kept = simhash.near_dedup(odd.plain(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_near_duplicates_of_odd_rows(spark):
    docs = odd.table(spark)
    got = simhash.near_classes(docs)
    assert got.count() == len(odd.rows())
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    prints = {k: fingerprint(r[1]) for k, r in enumerate(odd.rows())}
    rows = kept.collect()
    assert len(rows) == len(set(classes(prints, 3).values()))
    # the null id of the blank class is not the one that stays
    assert {r.doc_id for r in rows if not (r.text or "").strip()} == {1}
    none = odd.table(spark, empty=True)
    assert simhash.near_classes(none).count() == 0 and simhash.near_dedup(none).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [
        (200, 200), (300, 301), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == ({k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
                   | {300: 300, 301: 300})
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def spans_by_hand(docs: list[tuple], length: int) -> dict:
    """(id, first word, words) of all words in a stretch that occurs earlier."""
    seen, out = set(), set()
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    for k in order:
        words = re.findall(SPACE, (docs[k][1] or "").encode())
        hit = [False] * (len(words) + 1)
        for s in range(len(words) - length + 1):
            key = tuple(words[s:s + length])
            if key in seen:
                hit[s:s + length] = [True] * length
            seen.add(key)
        s = 0
        for e, on in enumerate(hit):
            if not on:
                if e > s:
                    out.add((docs[k][0], s, e - s))
                s = e + 1
    return out


@pytest.mark.parametrize("length,window,edge", [(12, 5, 3), (50, 30, 8)])
def test_spans_equal_brute_force(spark, length, window, edge):
    chance = random.Random(length)
    pool = [[f"v{chance.randrange(60)}" for _ in range(chance.randint(length - 2, 3 * length))]
            for _ in range(5)]
    docs = []
    for k in range(40):
        words = []
        for _ in range(chance.randint(0, 4)):
            part = chance.choice(pool)
            a = chance.randint(0, edge)
            words += part[a:len(part) - chance.randint(0, edge)]
            words += [f"u{chance.randrange(50)}" for _ in range(chance.randint(0, 20))]
        docs.append((k, " ".join(words) if words else None))
    docs.append((99, "loop de " * (2 * length)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.n_words) for r in repeats.repeated_spans(
        table, length, window).collect()}
    want = spans_by_hand(docs, length)
    assert got == want and want
    texts = {r.doc_id: r.text for r in repeats.cut_repeats(table, length, window).collect()}
    for k, text in docs:
        words = re.findall(SPACE.decode(), text or "")
        for _, s, n in sorted((w for w in want if w[0] == k), reverse=True):
            del words[s:s + n]
        assert re.findall(SPACE.decode(), texts[k] or "") == words


def test_repeats_of_odd_rows(spark):
    docs = odd.table(spark)
    spans = repeats.repeated_spans(docs).collect()
    assert {(r.doc_id, r.source_id) for r in spans} == {
        (9, 8), (11, 10), (14, 14), (15, 14), (None, 10)}
    cut = repeats.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(odd.rows())
    texts = {r.row: r.text for r in cut.collect()}
    assert texts[0] is None and texts[8] == "" and texts[9] == odd.rows()[9][1]
    assert texts[10] == texts[11] == "other "
    none = odd.table(spark, empty=True)
    assert repeats.repeated_spans(none).count() == 0 and repeats.cut_repeats(none).count() == 0


def test_equal_rows_are_worked_on_once(spark):
    shared, tail, *own = odd.words(120, 31), odd.words(90, 32), *(odd.words(60, k) for k in (35, 36, 37))
    once = [(1, f"{shared} {own[0]}"), (7, f"{shared} {tail} {own[1]}"),
            (None, f"{tail} {shared} {own[2]}"), (8, odd.words(200, 34))]
    docs = once + [once[1]] * 300 + [once[2]] * 300 + [once[3]] * 300
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = repeats._keyed(table, "doc_id", "text")
    found = repeats._candidates(rows, 50, 30)
    places = {r.mark: r.places for r in found.collect()}
    assert len(places) >= 3 and all(len(p) == len(set(p)) for p in places.values())
    stretches = repeats._stretches(rows, found, 50, 30).filter("not done")
    assert stretches.count() == stretches.select("h1", "h2", "mark", "start").distinct().count()
    got = [(r.doc_id, r.start_word, r.n_words) for r in repeats.repeated_spans(table).collect()]
    assert len(got) == len(set(got)) and set(got) == spans_by_hand(once, 50)
    cut = repeats.cut_repeats(table)
    assert cut.count() == len(docs)
    assert {(r.doc_id, r.text, r.n) for r in cut.groupBy("doc_id", "text").agg(
        F.count("*").alias("n")).collect()} == {
        (1, once[0][1], 1), (7, f"{tail} {own[1]}", 301), (None, own[2], 301), (8, once[3][1], 301)}


def test_word_hashes_do_not_depend_on_the_batch():
    alone = [Words([t]).hash.tolist() for t in (b"a bb  c", b"", b"bb\tc a")]
    together = Words([b"a bb  c", b"", b"bb\tc a"])
    parts = [together.hash[a:b].tolist() for a, b in zip(together.first, together.first[1:])]
    assert parts == alone and len(set(sum(alone, []))) == 3


def test_sliding():
    values = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 16, 30):
        assert sliding(values, width, np.minimum).tolist() == [
            values[k:k + width].min() for k in range(51 - width)]


def _joins(df):
    """The names of the joins that the plan may run, as it stands before it adapts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(\w+Join\w*) ", plan)


def test_tables_of_an_entry_a_row_are_merged_and_not_broadcast(spark):
    prints = spark.range(300).select(F.xxhash64("id").alias("fp"))
    assert set(_joins(simhash.links(prints))) == {"SortMergeJoin"}
    docs = odd.plain(spark, [odd.words(80, k) for k in range(30)])
    kept = _joins(simhash.near_dedup(docs))
    assert "SortMergeJoin" in kept and "BroadcastHashJoin" in kept      # of hot fingerprints
    edges = spark.createDataFrame([(k, k // 2) for k in range(2, 90)], "a long, b long")
    assert set(_joins(components._to_least(edges, True))) == {"SortMergeJoin"}


def test_hubs_are_linked_like_other_nodes(spark):
    edges = [(k, 5000) for k in range(3000)] + [(5000 + k, 5001 + k) for k in range(30)]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 3031 and set(got.values()) == {0}
