import random
from contextlib import contextmanager
import re

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RESUME, SKILLS
from dossier import lexicon as L
from dossier.functions import sets
from dossier.functions import text as X
from dossier.functions.terms import TermSet
from dossier.operators import features, matching, pairing, training, verdict
from dossier.plans import screening

WORDS = ["python", "java", "the", "cloud", "data", "engineer", "éclair", "go", "aws", "with", "senior"]


def _stuffing(resume, target):
    """Plain restatement of the rule, for comparison."""
    words = [w for w in re.findall(r"\b[a-z]{3,}\b", resume.lower()) if w not in L.CONTENT_STOPWORDS]
    want = {w for w in re.findall(r"\b[a-z]{3,}\b", target.lower()) if w not in L.CONTENT_STOPWORDS}
    if not words or not want:
        return 0.0
    hits = [w for w in words if w in want]
    most = max((hits.count(w) for w in set(hits)), default=0)
    penalty = min(0.3, most * 0.02) if most > 10 else 0
    return round(min(1.0, len(hits) / len(words) * 2.0 + penalty), 4)


def test_keyword_stuffing_against_brute_force(spark):
    rnd = random.Random(5)
    docs = [(i, 0, " ".join(rnd.choices(WORDS, k=rnd.choice([0, 3, 40, 200])))) for i in range(60)]
    target = "Python data engineer with cloud éclair"
    left = spark.createDataFrame(docs, "doc_id INT, job_id INT, text STRING").select(
        "doc_id", "job_id", X.content_words(X.fold(F.col("text"))).alias("content"))
    left = pairing.word_counts(left, "content", "counts")
    right = spark.createDataFrame([(0, target)], "job_id INT, d STRING").select(
        "job_id", F.array_distinct(X.content_words(X.fold(F.col("d")))).alias("target"))
    got = {r.doc_id: r.v for r in pairing.pair(left, right).select("doc_id", pairing.keyword_stuffing(
        F.col("counts"), F.size("content"), F.col("target")).alias("v")).collect()}
    assert got == {i: _stuffing(t, target) for i, _, t in docs}
    assert _stuffing("python " * 5 + "java " * 4 + "aws " * 3, "Looking for Python, Java and AWS") == 1.0


def test_sets(spark):
    df = spark.createDataFrame([(["Python", "Java", "SQL"], ["Python", "JavaScript"], [])],
                               "a ARRAY<STRING>, b ARRAY<STRING>, z ARRAY<STRING>")
    row = df.select(sets.jaccard(F.col("a"), F.col("b")).alias("j"), sets.jaccard(F.col("a"), F.col("z")).alias("e"),
                    sets.skill_gap(F.col("a"), F.col("b")).alias("g")).first()
    assert row.j == 0.25 and row.e == 0.0
    assert (row.g.matched, row.g.missing, row.g.extra) == (["Python"], ["JavaScript"], ["Java", "SQL"])


@pytest.mark.parametrize("years, required, relevant, mentioned, want", [
    (10.0, 5.0, ["AI_ML", "Data"], ["AI_ML", "Data", "QA"], 1.0), (3.0, 5.0, ["AI_ML"], ["AI_ML"], 0.6),
    (10.0, 5.0, ["AI_ML"], [], 0.0), (10.0, 0.0, ["A", "B", "C"], ["A", "B"], 0.6667),
    (0.0, 0.0, [], [], 0.1), (2.0, 0.0, [], [], 0.3), (0.5, 0.0, ["A"], ["A"], 0.35)])
def test_experience_relevance(spark, years, required, relevant, mentioned, want):
    df = spark.createDataFrame([(years, required, relevant, mentioned)],
                               "y DOUBLE, r DOUBLE, a ARRAY<STRING>, m ARRAY<STRING>")
    assert df.select(pairing.experience_relevance(*[F.col(c) for c in "yram"]).alias("v")).first().v == want


def test_semantic_blend(spark):
    df = spark.createDataFrame([(0.5, 1.0, 5), (0.5, 1.0, 15), (0.5, 1.0, 0)], "c DOUBLE, r DOUBLE, n INT")
    got = [r.v for r in df.select(pairing.semantic_similarity(
        F.col("c"), F.col("r"), F.col("n"), F.col("n") == 0).alias("v")).collect()]
    assert got == [0.75, 0.5, 0.0]


def test_skill_density(spark):
    df = spark.createDataFrame([(5, 1.0, 10), (3, 0.0, 300), (3, 0.0, 0), (90, 1.0, 5)], "n INT, y DOUBLE, w INT")
    got = [r.v for r in df.select(pairing.skill_density(F.col("n"), F.col("y"), F.col("w")).alias("v")).collect()]
    assert got == [5.0, 1.5, 0.0, 20.0]


@contextmanager
def without_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key)


def test_matching_paths_agree(spark):
    docs = spark.createDataFrame(
        [(1, RESUME), (2, "React Native and react; .NET"), (3, ""), (4, "C++ c# go-getter ci/cd")],
        "doc_id INT, text STRING").withColumn("folded", X.fold(F.col("text")))
    dim = matching.term_dimension(matching.builtin_terms(spark, SKILLS))
    broadcast = {tuple(r) for r in matching.match_terms(docs, dim).collect()}
    with without_broadcast(spark):
        shuffled = {tuple(r) for r in matching.match_terms(docs, dim).collect()}
    assert broadcast == shuffled and (2, "skill", "React") in broadcast
    terms = TermSet(SKILLS)
    for r in docs.select("doc_id", terms.hits(F.col("folded")).alias("s")).collect():
        assert set(r.s) == {t for d, k, t in broadcast if d == r.doc_id and k == "skill"}


def test_longest_matching_against_brute_force(spark):
    vocabulary = ["data", "data engineer", "engineer", "senior data", "big data engineer", "x"]
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choices(["big", "senior", "data", "engineer", "x", "y"], k=9))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id INT, folded STRING")
    dim = matching.term_dimension(spark.createDataFrame([("k", t) for t in vocabulary], "kind STRING, term STRING"))
    want = set()
    for i, text in docs:
        tokens = text.split()
        hits = [(-len(v.split()), p, v) for v in vocabulary for p in range(len(tokens))
                if tokens[p:p + len(v.split())] == v.split()]
        taken = set()
        for n, p, v in sorted(hits):
            if not taken & set(range(p, p - n)):
                taken |= set(range(p, p - n))
                want.add((i, v, p))
    def found():
        return {(r.doc_id, r.term, r.pos) for r in matching.match_terms_longest(df, dim).collect()}

    assert found() == want
    with without_broadcast(spark):
        assert found() == want


@pytest.mark.parametrize("match, generic, stuffing, density, cls, p, label, confidence", [
    (0.77, 0.12, 0.18, 3.5, 0, (0.9045, 0.0573, 0.0382), "Authentic", 0.9045),
    (0.45, 0.10, 0.10, 2.0, 0, (0.7775, 0.1335, 0.0890), "Suspicious", 0.7775),
    (0.38, 0.10, 0.10, 2.0, 1, (0.15, 0.70, 0.15), "Potentially Fake", 0.85),
    (0.38, 0.75, 0.85, 12.0, 2, (0.05, 0.10, 0.85), "Potentially Fake", 0.85)])
def test_classify(spark, match, generic, stuffing, density, cls, p, label, confidence):
    df = spark.createDataFrame([(match, generic, stuffing, density)], "final_match_score DOUBLE, "
                               "generic_phrase_score DOUBLE, keyword_stuffing_score DOUBLE, skill_density DOUBLE")
    row = verdict.classify(df).first()
    assert (row.classification, row.confidence, (row.prob_0, row.prob_1, row.prob_2)) == (label, confidence, p)
    assert len(row.top_features) <= 3
    gated = verdict.classify(df, F.lit(False)).first()
    assert (gated.classification, gated.confidence, gated.top_features) == ("Not a Resume", 1.0, [])


def test_reviews_override(spark):
    df = spark.createDataFrame([(1, "Potentially Fake"), (2, "Authentic"), (3, "Suspicious")],
                               "doc_id INT, classification STRING")
    reviews = spark.createDataFrame([(1, "Disagree", "a"), (2, "Disagree", "b"), (3, "Agree", "c")],
                                    "doc_id INT, consensus STRING, reasoning STRING")
    got = {r.doc_id: r.classification for r in verdict.apply_reviews(df, reviews, ("doc_id",)).collect()}
    assert got == {1: "Suspicious", 2: "Authentic", 3: "Suspicious"}


def test_align_features(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "doc_id INT, a DOUBLE, b DOUBLE")
    assert features.align_features(df, ["b", "a", "c"]).first().asDict() == {"b": 2.0, "a": 0.0, "c": 0.0}


def test_screening_sample(spark):
    docs = spark.createDataFrame([(1, 7, RESUME), (2, 7, "")], "doc_id LONG, job_id LONG, text STRING")
    jobs = spark.createDataFrame([(7, "", "Python and Docker on AWS")], "job_id LONG, title STRING, description STRING")
    vectors = {"doc_vectors": spark.createDataFrame([], "doc_id LONG, vec ARRAY<DOUBLE>"),
               "job_vectors": spark.createDataFrame([], "job_id LONG, vec ARRAY<DOUBLE>")}
    rows = {r.doc_id: r for r in screening.screen(
        docs, jobs, skills=SKILLS, as_of_year=AS_OF, **vectors).collect()}
    r = rows[1]
    assert [c for c in r.asDict() if c in L.FEATURES] == L.FEATURES
    assert r.skill_overlap_score == round(3 / 9, 4) and r.years_experience == 8.5 and r.num_skills == 9.0
    assert r.experience_graduation_gap == -0.5 and r.gap_years == 4.0 and r.overlapping_jobs == 0.0
    # no vectors: half of the token recall, which is 3 of (python, docker, on, aws)
    assert r.semantic_similarity == 0.375
    assert rows[2].classification == "Not a Resume" and rows[2].skill_density == 0.0
    compat = screening.screen(docs, jobs, skills=SKILLS, as_of_year=AS_OF, compat=True).filter("doc_id = 1").first()
    assert compat.gap_years == 0.0


def test_screening_embeds_both_sides(spark):
    posting = ("We look for a platform engineer with Python, Docker and AWS who runs a cloud platform, "
               "migrates legacy systems and reduces deployment time for several teams")
    docs = spark.createDataFrame(
        [(1, 7, f"{RESUME}\n{posting}"), (2, 7, "Pastry chef\nBaked bread and cakes for weddings " * 20)],
        "doc_id LONG, job_id LONG, text STRING")
    jobs = spark.createDataFrame([(7, "", posting)], "job_id LONG, title STRING, description STRING")
    got = {r.doc_id: r.semantic_similarity for r in screening.score(docs, jobs, skills=SKILLS).collect()}
    assert got[1] > 0.25 > got[2]
    with pytest.raises(ValueError):
        screening.score(docs, jobs, doc_vectors=docs.selectExpr("doc_id", "array(1.0) AS vec"))


def test_embedding_is_unit_length(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "doc_id INT, words ARRAY<STRING>")
    vecs, _ = training.embed(docs, "words", size=64)
    for r in vecs.collect():
        norm = sum(v * v for v in r.vec)
        assert abs(norm - (1.0 if r.words else 0.0)) < 1e-5


def test_admit_phrases(spark):
    phrases = spark.createDataFrame(
        [(1, "quantum chips", [1.0, 0.0]), (1, "far away", [0.0, 1.0]), (2, "quantum chips", [1.0, 0.0]),
         (1, "Python", [1.0, 0.0]), (1, "ab", [1.0, 0.0])], "doc_id INT, phrase STRING, vec ARRAY<DOUBLE>")
    seeds = spark.createDataFrame([(0, [0.9, 0.1])], "seed_id INT, vec ARRAY<DOUBLE>")
    matched = spark.createDataFrame([(2,)], "doc_id INT")
    dim = matching.term_dimension(matching.builtin_terms(spark, SKILLS))
    out = matching.admit_phrases(phrases, matched, dim, seeds)
    assert [tuple(r) for r in out.collect()] == [(1, "Quantum Chips")]


def test_overlapping_hits_of_a_long_text(spark, monkeypatch):
    """Blocks of three tokens: clusters reach over many blocks and are found all the same."""
    monkeypatch.setattr(matching, "BLOCK", 3)
    rnd = random.Random(4)
    vocabulary = ["a", "a b", "b a b", "c c", "d"]
    docs = [(i, " ".join(rnd.choices("abcde", k=n))) for i, n in [(1, 60), (2, 7), (3, 1), (None, 20)]]
    docs += [(4, "c " * 41), (5, ""), (6, "e e e")]
    df = spark.createDataFrame(docs, "doc_id INT, folded STRING")
    dim = matching.term_dimension(spark.createDataFrame([("k", t) for t in vocabulary], "kind STRING, term STRING"))
    want = set()
    for i, text in docs:
        tokens, taken = text.split(), set()
        for n, p, v in sorted((-len(v.split()), p, v) for v in vocabulary for p in range(len(tokens))
                              if tokens[p:p + len(v.split())] == v.split()):
            if not taken & set(range(p, p - n)):
                taken |= set(range(p, p - n))
                want.add((i, v, p))
    got = [(r.doc_id, r.term, r.pos) for r in matching.match_terms_longest(df, dim).collect()]
    assert set(got) == want and len(got) == len(want)
    hits = spark.createDataFrame([(1, p, 2) for p in [0, 1, 2, 5, 6, 9]], "doc_id INT, pos INT, n_tokens INT")
    found = matching.hit_clusters(hits, 2).collect()
    assert {(r.pos, r.cluster) for r in found} == {(0, 0), (1, 0), (2, 0), (5, 5), (6, 5), (9, 9)}


def test_nearest_seed_in_blocks(spark):
    rnd = random.Random(5)
    unit = lambda: (lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v])([rnd.gauss(0, 1) for _ in range(4)])
    seeds = [(k, unit()) for k in range(70)] + [(80, [1.0, 0.0, 0.0, 0.0]), (75, [1.0, 0.0, 0.0, 0.0])]
    vectors = [(k, unit()) for k in range(30)] + [(98, [1.0, 0.0, 0.0, 0.0]), (99, None)]
    got = {r.id: r for r in matching.nearest_seed(
        spark.createDataFrame(vectors, "id INT, vec ARRAY<DOUBLE>"),
        spark.createDataFrame(seeds, "seed_id LONG, vec ARRAY<DOUBLE>"), 0.9, block=4).collect()}
    for k, v in vectors[:-1]:
        sims = [(min(1.0, max(0.0, sum(a * b for a, b in zip(v, s)))), -i) for i, s in seeds]
        best, at = max(sims)
        assert abs(got[k].best_sim - best) < 1e-9 and got[k].best_seed == -at
        assert got[k].admitted == (best > 0.9)
    assert got[98].best_seed == 75 and got[99].best_sim == 0.0 and not got[99].admitted
    none = matching.nearest_seed(spark.createDataFrame(vectors, "id INT, vec ARRAY<DOUBLE>"),
                                 spark.createDataFrame([], "seed_id LONG, vec ARRAY<DOUBLE>"))
    assert {r.admitted for r in none.collect()} == {False}


def test_terms_admitted_from_texts(spark):
    texts = ["data engineering is what we do", "data engineering for banks", "we love software testing here",
             "python and nothing else", "data engineering with python", "software testing of software testing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, folded STRING")
    dim = matching.term_dimension(matching.builtin_terms(spark, SKILLS).filter("kind = 'skill'"))
    embed = lambda df: training.embed(df, "words", size=4096, model=training.fit_encoder(
        docs.select(F.split("folded", " ").alias("words")), "words", 4096))[0]
    got = {tuple(r) for r in matching.admit_terms(docs, dim, embed, least=2, score=1.0).collect()}
    # a text with a known term admits nothing, and no seed is near a lone word
    assert got == {(0, "Data Engineering"), (1, "Data Engineering"), (2, "Software Testing"), (5, "Software Testing")}


def test_failing_items_are_rows(spark):
    text = f"{RESUME} and more"
    docs = spark.createDataFrame([(1, 7, text), (2, 7, None), (3, 7, "  "), (4, 8, text), (5, None, text), (6, 7, "x" * 3000),
                                  (7, 7, text)], "doc_id LONG, job_id LONG, text STRING")
    jobs = spark.createDataFrame([(7, "", "Python and Docker on AWS")], "job_id LONG, title STRING, description STRING")
    vectors = {"doc_vectors": spark.createDataFrame([(1, [1.0, 0.0]), (7, [1.0])], "doc_id LONG, vec ARRAY<DOUBLE>"),
               "job_vectors": spark.createDataFrame([(7, [1.0, 0.0])], "job_id LONG, vec ARRAY<DOUBLE>")}
    got = {r.doc_id: r for r in screening.screen_each(docs, jobs, longest=2000, skills=SKILLS, **vectors).collect()}
    assert {k: r.error for k, r in got.items()} == {
        1: None, 2: "no text", 3: "empty text", 4: "unknown job", 5: "no job given", 6: "text too long",
        7: "no value for semantic_similarity"}
    assert got[1].classification and all(r.classification is None for k, r in got.items() if k != 1)


def test_batch_ids_follow_content(spark):
    docs = [(k, k % 2, f"text {k}") for k in range(10)]
    jobs = spark.createDataFrame([(0, "t", "d"), (1, "t", "d"), (2, "t", "d")], "job_id LONG, title STRING, description STRING")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id LONG, job_id LONG, text STRING")
    ids = lambda rows: {r.job_id: r.batch_id for r in screening.batch_ids(frame(rows), jobs).collect()}
    first = ids(docs)
    assert set(first) == {0, 1} and first[0] != first[1] and ids(docs[::-1]) == first
    changed = ids([*docs[:-1], (9, 1, "other")])
    assert changed[0] == first[0] and changed[1] != first[1]
    assert ids([*docs, (10, 0, None)])[0] != first[0]


def test_hashed_cosine_equals_vectors(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, ["c"]), (3, []), (4, ["x", "a"])], "doc_id INT, words ARRAY<STRING>")
    weights = training.fit_weights(docs, "words", 8)
    vectors, model = training.embed(docs, "words", size=8)
    assert weights == pytest.approx(model.stages[1].idf.toArray().tolist())
    left = training.hash_words(pairing.word_counts(docs, "words", "counts"), "counts", weights, "hashed")
    right = training.embed_weighted(docs.select(F.col("doc_id").alias("other"), F.array_distinct("words").alias("w")),
                                    "w", weights, "vec").filter("other = 4")
    one = {r.doc_id: r.vec for r in vectors.collect()}
    for r in left.join(right, F.lit(True)).select("doc_id", training.hashed_cosine(F.col("hashed"), F.col("vec")).alias("c")).collect():
        assert r.c == pytest.approx(sum(a * b for a, b in zip(one[r.doc_id], one[4])), abs=1e-9)


def test_target_vector_holds_its_own_buckets_alone(spark):
    jobs = spark.createDataFrame([(1, ["a", "b", None]), (2, []), (3, None)], "job_id INT, words ARRAY<STRING>")
    rows = training.embed_weighted(jobs, "words", [1.0] * 256, "vec").orderBy("job_id").collect()
    assert [len(r.vec) for r in rows] == [2, 0, 0]
    assert sum(v * v for v in rows[0].vec.values()) == pytest.approx(1.0)


def test_word_counts_keep_their_order(spark):
    docs = spark.createDataFrame([(["b", "a", "b", None],), ([],), (None,)], "words ARRAY<STRING>")
    got = [r.n and [tuple(x) for x in r.n] for r in pairing.word_counts(docs, "words", "n").collect()]
    assert got == [[("a", 1), ("b", 3)], [], None]
