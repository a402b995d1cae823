"""Set similarity, vectors, pairing and pair scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import lexicon as L
from dossier.functions import sets
from dossier.functions import spans as S
from dossier.functions import text as X
from dossier.functions.terms import extract_skills, normalize_aliases
from dossier.functions.vectors import cosine
from dossier.operators import matching as M
from dossier.operators import pairing as P
from dossier.operators import ranking, training
from dossier.plans import inputs as I
from dossier.plans import screening
from dossier.plans.catalog import duck as D
from dossier.plans.catalog import query
from dossier.plans.catalog.text import (
    LONGEST_CTES, PROFILES, SKILLS, SKILLS_CTE, docs, folded, postings, profiles)
from dossier.session import cut_lineage

Y = I.AS_OF

# ------------------------------------------------- sets: brands traded
BRANDS_SQL = """WITH t AS (SELECT o_custkey AS c, l_suppkey AS s, p_brand AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  JOIN part ON p_partkey = l_partkey),
cb AS (SELECT c, list_sort(list(DISTINCT b)) AS have FROM t GROUP BY c),
sb AS (SELECT s, list_sort(list(DISTINCT b)) AS want FROM t GROUP BY s),
pr AS (SELECT DISTINCT c, s FROM t),
x AS (SELECT c AS doc_id, s AS job_id, have, want FROM pr JOIN cb USING (c) JOIN sb USING (s))"""


def brand_pairs(spark, d):
    """Customers and suppliers that traded, each with its set of brands (25 at most)."""
    t = (I.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"))
         .join(I.table(spark, d, "lineitem").select(
             F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("job_id"), "l_partkey"),
             "o_orderkey")
         .join(I.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
         .select("doc_id", "job_id", "p_brand").distinct())
    t = cut_lineage(t)  # three aggregates read it: the joins run once
    have = t.groupBy("doc_id").agg(F.array_sort(F.collect_set("p_brand")).alias("have"))
    want = t.groupBy("job_id").agg(F.array_sort(F.collect_set("p_brand")).alias("want"))
    return t.select("doc_id", "job_id").distinct().join(have, "doc_id").join(want, "job_id")


@query("m1_jaccard", f"{BRANDS_SQL} SELECT doc_id, job_id, {D.jaccard('have', 'want')} AS score FROM x")
def jaccard(spark, d):
    return brand_pairs(spark, d).select(
        "doc_id", "job_id", sets.jaccard(F.col("have"), F.col("want")).alias("score"))


@query("m2_skill_gap", f"""{BRANDS_SQL}, g AS (SELECT doc_id, job_id, list_sort(list_intersect(have, want)) AS m,
  list_sort(list_filter(want, lambda v: NOT list_contains(have, v))) AS mi, list_sort(list_filter(have, lambda v: NOT list_contains(want, v))) AS ex FROM x)
SELECT doc_id, job_id, array_to_string(m, '|') AS matched, array_to_string(mi, '|') AS missing, array_to_string(ex, '|') AS extra,
  len(m) AS match_count, len(mi) AS missing_count, len(ex) AS extra_count FROM g""")
def gap(spark, d):
    g = brand_pairs(spark, d).select("doc_id", "job_id", sets.skill_gap(F.col("have"), F.col("want")).alias("g"))
    lists = ("matched", "missing", "extra")
    return g.select("doc_id", "job_id", *[F.array_join(f"g.{n}", "|").alias(n) for n in lists],
                    "g.match_count", "g.missing_count", "g.extra_count")


# ------------------------------------------------- documents x benchmark
DOC_PAIRS = f"""WITH {I.DOCUMENTS_SQL}, {I.TARGETS_SQL},
a AS (SELECT doc_id, job_id, {D.fold('text')} AS f FROM docs), b AS (SELECT job_id, {D.fold('description')} AS t FROM targets)"""


@query("m3_token_recall", f"""{DOC_PAIRS}, c AS (SELECT doc_id, job_id, {D.tech_tokens('f')} AS r FROM a),
e AS (SELECT job_id, {D.tech_tokens('t')} AS w FROM b)
SELECT doc_id, job_id, {D.token_recall('r', 'w')} AS recall FROM c JOIN e USING (job_id)""")
def recall(spark, d):
    left = I.documents(spark, d).withColumn("folded", X.fold(F.col("text"))).select(
        "doc_id", "job_id", X.tech_tokens(folded()).alias("tokens"))
    right = I.document_targets(spark, d).withColumn("folded", X.fold(F.col("description"))).select(
        "job_id", X.tech_tokens(folded()).alias("target_tokens"))
    return P.pair(left, right).select(
        "doc_id", "job_id", sets.token_recall(F.col("tokens"), F.col("target_tokens")).alias("recall"))


@query("m10_keyword_stuffing", f"""{DOC_PAIRS}, c AS (SELECT doc_id, job_id, {D.content_words('f')} AS words FROM a),
e AS (SELECT job_id, list_distinct({D.content_words('t')}) AS target FROM b),
p AS (SELECT doc_id, job_id, words, target FROM c JOIN e USING (job_id)), {D.stuffing_ctes('p')}
SELECT doc_id, job_id, keyword_stuffing_score FROM stuffed""")
def stuffing(spark, d):
    left = I.documents(spark, d).withColumn("folded", X.fold(F.col("text"))).select(
        "doc_id", "job_id", X.content_words(folded()).alias("content"))
    left = P.word_counts(left, "content", "counts").select(
        "doc_id", "job_id", "counts", F.size("content").alias("n"))
    right = I.document_targets(spark, d).withColumn("folded", X.fold(F.col("description"))).select(
        "job_id", F.array_distinct(X.content_words(folded())).alias("target"))
    return P.pair(left, right).select("doc_id", "job_id", P.keyword_stuffing(
        F.col("counts"), F.col("n"), F.col("target")).alias("keyword_stuffing_score"))


@query("m12_pairing", f"WITH {I.DOCUMENTS_SQL}, {I.TARGETS_SQL} SELECT job_id, count(*) AS n_documents, "
       "CAST(sum(length(text)) AS BIGINT) AS chars FROM docs JOIN targets USING (job_id) GROUP BY job_id")
def pairing(spark, d):
    left = I.documents(spark, d).select("job_id", F.length("text").alias("chars"))
    return P.pair(left, I.document_targets(spark, d).select("job_id")).groupBy("job_id").agg(
        F.count("*").alias("n_documents"), F.sum("chars").alias("chars"))


@query("o1_rank_documents", f"""{DOC_PAIRS}, c AS (SELECT doc_id, job_id, {D.content_words('f')} AS words, {D.tech_tokens('f')} AS r FROM a),
e AS (SELECT job_id, list_distinct({D.content_words('t')}) AS target, {D.tech_tokens('t')} AS w FROM b),
p AS (SELECT * FROM c JOIN e USING (job_id)), {D.stuffing_ctes('p')},
g AS (SELECT doc_id, job_id, keyword_stuffing_score, {D.token_recall('r', 'w')} AS recall FROM stuffed)
SELECT doc_id, job_id, keyword_stuffing_score, recall,
  row_number() OVER (PARTITION BY job_id ORDER BY recall DESC, keyword_stuffing_score DESC, doc_id) AS rank FROM g""")
def rank_documents(spark, d):
    left = I.documents(spark, d).withColumn("folded", X.fold(F.col("text"))).select(
        "doc_id", "job_id", X.content_words(folded()).alias("content"), X.tech_tokens(folded()).alias("tokens"))
    left = P.word_counts(left, "content", "counts").select(
        "doc_id", "job_id", "counts", "tokens", F.size("content").alias("n"))
    right = I.document_targets(spark, d).withColumn("folded", X.fold(F.col("description"))).select(
        "job_id", F.array_distinct(X.content_words(folded())).alias("target"), X.tech_tokens(folded()).alias("target_tokens"))
    scored = P.pair(left, right).select(
        "doc_id", "job_id",
        P.keyword_stuffing(F.col("counts"), F.col("n"), F.col("target")).alias("keyword_stuffing_score"),
        sets.token_recall(F.col("tokens"), F.col("target_tokens")).alias("recall"))
    return ranking.ranked(scored, ["job_id"], [
        F.desc("recall"), F.desc("keyword_stuffing_score"), F.asc("doc_id")])


# ---------------------------------------------------------------- vectors
@query("m5_cosine", f"""WITH s AS (SELECT label, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY label)
SELECT vec_id, label, round({D.cosine('embedding', 'vec')}, 6) AS cos FROM embeddings JOIN s USING (label)""")
def cosines(spark, d):
    t = I.table(spark, d, "embeddings")
    seeds = t.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("seed"))
    return t.join(seeds, "label").select(
        "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("seed")), 6).alias("cos"))


WORDS_SQL = f"""WITH f AS (SELECT doc_id, text, {D.fold('text')} AS f FROM documents),
c AS MATERIALIZED (SELECT doc_id, text, {D.content_words('f')} AS words FROM f)"""


def _components(df):
    """The components that are not zero, one row each."""
    return df.select("doc_id", F.posexplode("vec").alias("bucket", "x")).filter("x <> 0").select(
        "doc_id", "bucket", F.round("x", 6).alias("x"))


@query("m4_embed", f"{WORDS_SQL}, {D.hashed_ctes('c', 'doc_id', 'words', 'h')} "
       "SELECT doc_id, b AS bucket, round(x, 6) AS x FROM h WHERE x <> 0")
def embed(spark, d):
    words = docs(spark, d).select("doc_id", X.content_words(folded()).alias("words"))
    return _components(training.embed(words, "words")[0])


# the encoder sees every distinct text once, so repeated texts weigh less in its frequencies
@query("m7_embed_distinct", f"""{WORDS_SQL}, u AS MATERIALIZED (SELECT text, any_value(words) AS words FROM c GROUP BY text),
{D.hashed_ctes('u', 'text', 'words', 'h')}
SELECT c.doc_id, b AS bucket, round(x, 6) AS x FROM h JOIN c USING (text) WHERE x <> 0""")
def embed_distinct(spark, d):
    def encode(texts):
        words = texts.withColumn("words", X.content_words(X.fold(F.col("text"))))
        return training.embed(words, "words")[0].select("text", "vec")
    return _components(training.embed_distinct(
        docs(spark, d).select("doc_id", "text"), "text", encode))


# ------------------------------------------- candidate texts x postings
_steps = "list_filter(list_transform(ys, lambda v, i: v - ys[i - 1]), lambda s: s > 2)"
_speed = D.round_exact(f"{D.promotion_keywords('f')} / CAST(len(ys) AS DOUBLE)", 4)
FACTS_SQL = f"""{PROFILES}, {SKILLS_CTE},
d1 AS (SELECT doc_id, job_id, f, skills, {D.word_count('f')} AS n_words, {D.content_words('f')} AS words,
  {D.tech_tokens('norm')} AS tokens, {D.spans('f', Y)} AS sp, {D.spans('f', Y, 'overlap')} AS so,
  {D.mentioned_years('f')} AS ys, {D.claimed_years('f')} AS claimed, {D.graduation_year('f', Y)} AS graduation_year,
  {D.achievement_count('f')} AS achievement_count, {D.generic_phrase_score('f')} AS generic_phrase_score,
  {D.certification_count('f')} AS num_certifications, {D.education_level('f')} AS education_level_encoded,
  {D.mentioned_categories('f')} AS mentioned, {D.likeness('f')} AS likeness, {D.evidence('f')} AS ev FROM k),
d2 AS (SELECT *, {D.years_experience('sp', 'claimed')} AS years_experience, {D.overlap_pairs('so')} AS overlapping_jobs,
  coalesce(list_sum({_steps}), 0) AS gap_years, CASE WHEN len(ys) > 1 THEN {_speed} ELSE 0e0 END AS promotion_speed,
  {D.alignment('ev', 'skills', L.default_skills())} AS skill_experience_alignment, len(skills) AS num_skills FROM d1),
d3 AS MATERIALIZED (SELECT *, {D.round_exact(f'({Y} - graduation_year) - years_experience', 2)} AS experience_graduation_gap,
  {D.density('num_skills', 'years_experience', 'n_words')} AS skill_density FROM d2)"""
_term_hits = D.term_hits("norm", L.default_skills())
TARGETS_SQL = f"""{I.POSTINGS_SQL},
j1 AS (SELECT job_id, {D.fold('title')} AS t, {D.fold('description')} AS f FROM postings),
j2 AS (SELECT *, lower({D.normalize_aliases('f', ci=False)}) AS norm, CASE WHEN {D.strip('t')} <> '' THEN t ELSE f END AS aim FROM j1),
j3 AS MATERIALIZED (SELECT job_id, list_distinct({D.content_words('f')}) AS target, {D.tech_tokens('norm')} AS target_tokens,
  {D.word_count('norm')} AS target_length, {_term_hits} AS target_skills, {D.required_years('aim')} AS required_years,
  {D.relevant_categories('aim')} AS relevant FROM j2)"""
_recall = D.token_recall("tokens", "target_tokens")
_exp = D.experience_relevance("years_experience", "required_years", "relevant", "mentioned")
SCORES_SQL = f"""{FACTS_SQL}, {TARGETS_SQL},
p0 AS (SELECT * FROM d3 JOIN j3 USING (job_id)),
{D.stuffing_ctes('p0', 'p1')},
{D.hashed_ctes('d3', 'doc_id', 'words', 'hd')},
{D.hashed_ctes('j3', 'job_id', 'target', 'ht', 'hd')},
dots AS (SELECT p1.doc_id, sum(a.x * b.x) AS cos FROM p1 JOIN hd a USING (doc_id) JOIN ht b ON b.job_id = p1.job_id AND b.b = a.b GROUP BY p1.doc_id),
p2 AS (SELECT p1.*, least(1e0, greatest(0e0, coalesce(dots.cos, 0e0))) AS cos, {_recall} AS recall FROM p1 LEFT JOIN dots USING (doc_id)),
p3 AS (SELECT *, {D.jaccard('skills', 'target_skills')} AS skill_overlap_score,
  {D.semantic('cos', 'recall', 'target_length')} AS semantic_similarity, {_exp} AS experience_relevance_score FROM p2),
p4 AS (SELECT *, {D.round_exact('6e-1 * semantic_similarity + 2.5e-1 * skill_overlap_score + 1.5e-1 * experience_relevance_score', 4)}
  AS final_match_score FROM p3)"""


def scored(spark, d):
    return screening.score(I.profiles(spark, d), I.postings(spark, d))


_MATCH = ["semantic_similarity", "skill_overlap_score", "experience_relevance_score", "final_match_score"]


@query("m6_m8_match_scores", f"{SCORES_SQL} SELECT doc_id, job_id, {', '.join(_MATCH)}, "
       "CASE WHEN final_match_score >= 7e-1 THEN 'strong' WHEN final_match_score >= 3.5e-1 THEN 'moderate' ELSE 'weak' END AS band FROM p4")
def match_scores(spark, d):
    return scored(spark, d).select(
        "doc_id", "job_id", *_MATCH, X.match_band(F.col("final_match_score")).alias("band"))


@query("m14_feature_frame", f"{SCORES_SQL} SELECT doc_id, job_id, "
       + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in L.FEATURES) + " FROM p4")
def feature_frame(spark, d):
    return screening.feature_table(I.profiles(spark, d), I.postings(spark, d))


SCREEN_SQL = f"""{SCORES_SQL},
v0 AS (SELECT *, final_match_score AS match, generic_phrase_score AS generic, keyword_stuffing_score AS stuffing, skill_density AS density FROM p4),
{D.probs_ctes('v0')},
screened AS (SELECT doc_id, job_id, final_match_score, CASE WHEN likeness >= 45 THEN label ELSE 'Not a Resume' END AS classification,
 CASE WHEN likeness >= 45 THEN conf ELSE 1e0 END AS confidence, CASE WHEN likeness >= 45 THEN r0 ELSE 0e0 END AS prob_0,
 CASE WHEN likeness >= 45 THEN r1 ELSE 0e0 END AS prob_1, CASE WHEN likeness >= 45 THEN r2 ELSE 0e0 END AS prob_2 FROM judged)"""


def screened(spark, d):
    return screening.screen(I.profiles(spark, d), I.postings(spark, d))


@query("screen_profiles", f"{SCREEN_SQL} SELECT * FROM screened")
def screen(spark, d):
    return screened(spark, d).select(
        "doc_id", "job_id", "final_match_score", "classification", "confidence",
        "prob_0", "prob_1", "prob_2")


@query("a13_label_summary", f"""{SCREEN_SQL} SELECT job_id, count(CASE WHEN classification = 'Authentic' THEN 1 END) AS authentic, count(CASE WHEN classification = 'Suspicious' THEN 1 END) AS suspicious,
 count(CASE WHEN classification = 'Potentially Fake' THEN 1 END) AS potentially_fake, count(CASE WHEN classification = 'Not a Resume' THEN 1 END) AS not_a_resume, 0 AS errors FROM screened GROUP BY job_id""")
def summary(spark, d):
    return ranking.label_summary(screened(spark, d))


@query("m9_skill_alignment", f"{PROFILES}, {SKILLS_CTE}, v AS (SELECT doc_id, skills, {D.evidence('f')} AS ev FROM k) "
       f"SELECT doc_id, {D.alignment('ev', 'skills', L.default_skills())} AS alignment FROM v")
def alignment(spark, d):
    staged = profiles(spark, d).select("doc_id", "folded", extract_skills(folded(), SKILLS).alias("skills"))
    return staged.select("doc_id", P.skill_alignment(folded(), F.col("skills"), SKILLS).alias("alignment"))


@query("m11_experience_relevance", f"{FACTS_SQL}, {TARGETS_SQL} SELECT doc_id, job_id, {_exp} AS relevance FROM d3 JOIN j3 USING (job_id)")
def relevance(spark, d):
    left = profiles(spark, d).select(
        "doc_id", "job_id", S.text_years_experience(folded(), Y).alias("years"),
        M.mentioned_categories(folded()).alias("mentioned"))
    right = P.target_facts(I.postings(spark, d), SKILLS).select("job_id", "required_years", "relevant")
    return P.pair(left, right).select("doc_id", "job_id", P.experience_relevance(
        F.col("years"), F.col("required_years"), F.col("relevant"), F.col("mentioned")).alias("relevance"))


@query("m13_skill_density", f"{FACTS_SQL} SELECT doc_id, skill_density FROM d3")
def density(spark, d):
    staged = profiles(spark, d).select(
        "doc_id", F.size(extract_skills(folded(), SKILLS)).alias("n"),
        S.text_years_experience(folded(), Y).alias("years"), X.word_count(folded()).alias("words"))
    return staged.select("doc_id", P.skill_density(
        F.col("n"), F.col("years"), F.col("words")).alias("skill_density"))


@query("m1_posting_skills", f"WITH {TARGETS_SQL} SELECT job_id, array_to_string(target_skills, '|') AS skills, target_length FROM j3")
def posting_skills(spark, d):
    return postings(spark, d).select(
        "job_id", F.array_join(extract_skills(folded(), SKILLS), "|").alias("skills"),
        X.word_count(F.lower(normalize_aliases(folded()))).alias("target_length"))


def _listing(items, k, empty):
    text = (f"array_to_string(list_transform(list_sort({items})[1:{k}], lambda x: x), ', ') || "
            f"CASE WHEN len({items}) > {k} THEN '...' ELSE '' END")
    return text if empty is None else f"CASE WHEN len({items}) = 0 THEN 'Not detected' ELSE {text} END"


def _titled(kind):
    words = "string_split(lower(term), ' ')"
    return (f"(SELECT doc_id, list(DISTINCT list_aggregate(list_transform({words}, lambda w: upper(w[1]) || w[2:]), "
            f"'string_agg', ' ')) AS items FROM longest WHERE kind = '{kind}' GROUP BY doc_id)")


@query("p5_preview", f"""{PROFILES}, {SKILLS_CTE}, {LONGEST_CTES},
a AS (SELECT k.doc_id, skills, {D.spans('f', Y)} AS sp, {D.claimed_years('f')} AS claimed, {D.graduation_year('f', Y)} AS grad,
  coalesce(e.items, []) AS edu, coalesce(j.items, []) AS jobs FROM k LEFT JOIN {_titled('education')} e USING (doc_id)
  LEFT JOIN {_titled('job_title')} j USING (doc_id)),
b AS (SELECT *, {D.years_experience('sp', 'claimed')} AS years FROM a)
SELECT doc_id, 'Experience: ~' || CAST(years AS VARCHAR) || ' years' || chr(10) || 'Past Roles: ' || {_listing('jobs', 3, 1)} || chr(10) || 'Education: ' ||
 {_listing('edu', 3, 1)} || ' (Class of ' || grad || ')' || chr(10) || chr(10) || 'Top Skills: ' || {_listing('skills', 10, None)} AS preview FROM b""")
def preview(spark, d):
    """Roles and education come from the competing match: 'Scrum Master' is no 'Master'."""
    texts = profiles(spark, d)
    dim = M.term_dimension(M.builtin_terms(spark).filter("kind <> 'generic'"))

    def of(kind):
        return F.collect_set(F.when(F.col("kind") == kind, F.initcap(F.lower("term"))))

    found = M.match_terms_longest(texts, dim).groupBy("doc_id").agg(
        of("education").alias("edu"), of("job_title").alias("jobs"))
    staged = texts.select(
        "doc_id", extract_skills(folded(), SKILLS).alias("skills"),
        S.text_years_experience(folded(), Y).alias("years"),
        S.graduation_year(folded(), Y).alias("grad")).join(found, "doc_id", "left")
    return staged.select("doc_id", ranking.preview(
        F.col("years"), F.col("jobs"), F.col("edu"), F.col("grad"), F.col("skills")).alias("preview"))


@query("p6_result_payload", f"""{SCREEN_SQL} SELECT doc_id, job_id, CASE WHEN likeness >= 45 THEN label ELSE 'Not a Resume' END AS classification,
 final_match_score, len(list_intersect(skills, target_skills)) AS match_count, CAST(num_skills AS DOUBLE) AS num_skills FROM judged""")
def payload(spark, d):
    """Fields read back from the stored JSON payload."""
    def field(path):
        return F.get_json_object("full_results", path)

    return ranking.result_struct(screened(spark, d)).select("doc_id", "job_id", "full_results").select(
        "doc_id", "job_id", field("$.classification.classification").alias("classification"),
        field("$.scores.final_match_score").cast("double").alias("final_match_score"),
        field("$.skills.match_count").cast("int").alias("match_count"),
        field("$.validation.num_skills").cast("double").alias("num_skills"))


_HALF = "CAST(('0x' || substr(md5(text), {0}, 15)) AS BIGINT)"


@query("batch_ids", f"""WITH {I.PROFILES_SQL}, {I.POSTINGS_SQL},
s AS (SELECT job_id, count(*) AS n, sum({_HALF.format(1)}::HUGEINT) AS s1, sum({_HALF.format(17)}::HUGEINT) AS s17 FROM profiles GROUP BY job_id)
SELECT job_id, sha256(title || chr(10) || description || chr(10) || n || chr(10) || s1 || chr(10) || s17) AS batch_id FROM postings JOIN s USING (job_id)""")
def batch_ids(spark, d):
    return screening.batch_ids(I.profiles(spark, d), I.postings(spark, d))
