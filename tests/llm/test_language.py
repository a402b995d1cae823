"""Language identification: held-out accuracy, calibration, whole texts, odd rows."""

import random
import unicodedata

import numpy as np
import odd
import pytest
from dossier.llm import language, queries

SYLLABLES = {"aa": ["ba", "lo", "ti", "ra"], "bb": ["sch", "unt", "eig", "ra"], "cc": ["ño", "que", "ti"]}


def text(lang, n, chance):
    return " ".join("".join(chance.choice(SYLLABLES[lang]) for _ in range(chance.randint(1, 4)))
                    for _ in range(n))


def labelled(spark, n, seed, shortest=3):
    chance = random.Random(seed)
    rows = [(k, text(lang, chance.randint(shortest, 120), chance), lang)
            for k in range(n) for lang in [chance.choice(list(SYLLABLES))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(spark):
    return language.train(labelled(spark, 900, 1), sample_rows=600)


def test_unseen_texts(spark, model):
    unseen = labelled(spark, 300, 2)
    rows = language.identify(unseen, model).join(unseen, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    # accepted predictions are right, and the mean score is about the share of right ones
    assert np.mean([r.lang == r.lang_pred for r in rows if not r.rejected]) >= 0.98
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.lang == r.lang_pred for r in rows])) < 0.05


def test_labels_are_what_is_learned(spark):
    docs = labelled(spark, 400, 3)
    chance = random.Random(4)
    names = [r.lang for r in docs.select("lang").orderBy("doc_id").collect()]
    chance.shuffle(names)
    shuffled = spark.createDataFrame(
        [(k, n) for k, n in enumerate(names)], "doc_id long, other string").join(docs, "doc_id")
    wrong = language.train(shuffled, lang_col="other", sample_rows=300)
    rows = language.identify(docs, wrong).join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) < 0.7
    assert wrong.threshold > 0.5                    # such a model rejects what it says


def test_fit_repeats_itself_and_leaves_out_what_it_may_not_use(spark, model):
    again = language.train(labelled(spark, 900, 1).repartition(7), sample_rows=600)
    assert (again.table == model.table).all() and again.threshold == model.threshold
    docs = labelled(spark, 300, 5)
    part = language.train(docs, docs.lang != "bb", sample_rows=200)
    assert part.languages == ["aa", "cc"]
    half = docs.doc_id % 2 == 0
    alone = language.train(docs.filter("doc_id % 2 = 0"), sample_rows=200)
    both = language.train(docs.withColumn("lang", docs.lang), half, sample_rows=200)
    assert (alone.table == both.table).all()


def plain(texts):
    """Buckets by a loop over the characters of one text."""
    out = []
    for t in texts:
        codes = [0] + [ord(c) if unicodedata.category(c)[0] in "LM" else 0 for c in t.lower()] + [0]
        found = {}
        for i in range(len(codes)):
            mixed = codes[i] * 0x9E3779B1 & 0xFFFFFFFF
            for size in (2, 3, 4):
                part = (codes[i:i + size] + [0] * 4)[:size]
                mixed = (mixed ^ part[-1]) * 0x85EBCA6B & 0xFFFFFFFF
                mixed ^= mixed >> 15
                if any(part) if size == 2 else all(part[1:-1]):
                    b = (mixed + size & 0xFFFFFFFF) * 0xC2B2AE35 % 2 ** 32 >> 18
                    found[b] = found.get(b, 0) + 1
        out.append(found)
    return out


def test_grams_equal_a_plain_loop_whatever_the_stretch(monkeypatch):
    texts = ["Éa  b-cd 12", "", "x", "123", "नमस्ते world", "long " * 20 + "end", "İi ß"]
    want = plain(texts)
    for stretch in (1 << 20, 7, 5, 1):
        monkeypatch.setattr(language, "STRETCH", stretch)
        got = [{} for _ in texts]
        for rows, first, buckets, _ in language.spread(texts):
            for row, start, stop in zip(rows, first, [*first[1:], len(buckets)]):
                for b in buckets[start:stop].ravel().tolist():
                    if b < language.BUCKETS:
                        got[row][b] = got[row].get(b, 0) + 1
        assert got == want


def test_threshold_and_temperature():
    score, right = np.array([.9, .8, .8, .6, .3]), np.array([True, True, True, True, False])
    assert language.threshold_of(score, right, 0.0) == .6
    assert language.threshold_of(score, right, 0.2) == 0.0
    assert language.threshold_of(score, ~right, 0.0) > .9
    logits = np.array([[5.0, 0], [5, 0], [5, 0], [0, 5]])
    honest = language.softmax(logits / language.temperature_of(logits, np.array([0, 0, 1, 1])))
    assert honest.max() == pytest.approx(0.75, abs=0.01)


def test_odd_rows(spark, model):
    docs = odd.table(spark).selectExpr("*", "'x' as lang_pred", "1 as `a.b`", "map(1, 2) as m")
    rows = language.identify(docs, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd.rows())
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == "und" for r in rows) == sum(
        not any(c.isalpha() for c in r[1] or "") for r in odd.rows())
    assert language.identify(odd.table(spark, empty=True), model).count() == 0
    nothing = language.train(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {(r.lang_pred, r.score, r.rejected) for r in language.identify(docs, nothing).collect()} == {
        ("und", 0.0, True)}
    one = language.train(docs.selectExpr("doc_id", "text", "'aa' as lang"))
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"aa", "und"}


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op13_language_id(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
