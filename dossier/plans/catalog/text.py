"""Text normalisation, tokens, patterns and dictionaries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dossier import lexicon as L
from dossier.functions import terms as N
from dossier.functions import text as X
from dossier.operators import matching as M
from dossier.operators import training
from dossier.plans import inputs as I
from dossier.plans.catalog import duck as D
from dossier.plans.catalog import query
from dossier.session import write_once

SKILLS = N.TermSet(L.default_skills())


def folded():
    return F.col("folded")


DOCS = f"WITH f AS (SELECT doc_id, text, {D.fold('text')} AS f FROM documents)"
PROFILES = f"WITH {I.PROFILES_SQL}, f AS (SELECT doc_id, job_id, text, {D.fold('text')} AS f FROM profiles)"
POSTINGS = (f"WITH {I.POSTINGS_SQL}, f AS (SELECT job_id, title, description, "
            f"{D.fold('title')} AS t, {D.fold('description')} AS f FROM postings)")
TURNS = f"WITH f AS (SELECT conv_id, turn, role, text, {D.fold('text')} AS f FROM conversations)"


def docs(spark, d):
    return I.texts(spark, d, "documents", "doc_id").withColumn(
        "folded", X.fold(F.col("text")))


def profiles(spark, d):
    return I.profiles(spark, d).withColumn("folded", X.fold(F.col("text")))


def postings(spark, d):
    return I.postings(spark, d).withColumn("folded", X.fold(F.col("description")))


def turns(spark, d):
    return I.texts(spark, d, "conversations", "conv_id", "turn").withColumn("folded", X.fold(F.col("text")))


def text_query(name, select, sql, source="docs"):
    """A row-local query over a whole corpus: key columns plus expressions."""
    load, prefix, keys = {
        "docs": (docs, DOCS, ["doc_id"]), "profiles": (profiles, PROFILES, ["doc_id"]),
        "postings": (postings, POSTINGS, ["job_id"]),
        "turns": (turns, TURNS, ["conv_id", "turn"])}[source]
    columns = ", ".join([*keys, *[f"{e} AS {n}" for n, e in sql.items()]])

    @query(name, f"{prefix} SELECT {columns} FROM f")
    def run(spark, d):
        made = select(folded(), F.col("text" if source != "postings" else "description"))
        return load(spark, d).select(*keys, *[e.alias(n) for n, e in made.items()])


def digest(col):
    return F.md5(col)


# ------------------------------------------------------------ normalising
text_query("t1_alias_expansion", lambda f, text: {"normalized": N.normalize_aliases(text)},
           {"normalized": D.normalize_aliases("text")}, "profiles")

_cascade = "description"
for _a in sorted(L.ALIASES, key=len, reverse=True):
    _p = "(?i)\\b" + N.escape(_a) + "\\b"
    _cascade = f"regexp_replace({_cascade}, {D.q(_p)}, {D.q(L.ALIASES[_a])}, 'g')"
text_query("t1_alias_cascade", lambda f, text: {"normalized": N.normalize_aliases(text, cascade=True)},
           {"normalized": _cascade}, "postings")


@query("t2_canonical_skill", f"""{POSTINGS}, t AS (SELECT unnest({D.found('description', r'[^\s,]+')}) AS token FROM f)
SELECT coalesce({D.canonical('lower(trim(token))')}, token) AS skill, count(*) AS n FROM t GROUP BY 1""")
def canonical(spark, d):
    tokens = F.explode(F.regexp_extract_all("description", F.lit(r"([^\s,]+)")))
    return (I.postings(spark, d).select(tokens.alias("token"))
            .groupBy(N.canonical_skill(F.col("token")).alias("skill")).agg(F.count("*").alias("n")))


# ----------------------------------------------------------------- tokens
_CONTENT, _TECH, _FRAGMENTS = D.content_words("f"), D.tech_tokens("f"), D.fragments("f")


def _listed(items, name):
    """Size of an array and a digest of its members."""
    return {name: F.size(items), "digest": F.md5(F.array_join(items, "|"))}


text_query("t3_content_words", lambda f, text: {
    **_listed(X.content_words(f), "n_words"), "n_distinct": F.size(F.array_distinct(X.content_words(f)))}, {
    "n_words": f"len({_CONTENT})", "n_distinct": f"len(list_distinct({_CONTENT}))",
    "digest": f"md5({D.joined(_CONTENT)})"})
text_query("t4_tech_tokens", lambda f, text: _listed(F.array_sort(X.tech_tokens(f)), "n_tokens"), {
    "n_tokens": f"len({_TECH})", "digest": f"md5({D.joined(f'list_sort({_TECH})')})"})
text_query("t5_word_count", lambda f, text: {"words": X.word_count(f)}, {"words": D.word_count("f")})
text_query("t5_word_count_turns", lambda f, text: {"words": X.word_count(f)},
           {"words": D.word_count("f")}, "turns")
text_query("t6_fragments", lambda f, text: _listed(X.fragments(f), "n_fragments"), {
    "n_fragments": f"len({_FRAGMENTS})", "digest": f"md5({D.joined(_FRAGMENTS)})"})
text_query("t7_words_per_line", lambda f, text: {
    "lines": X.filled_lines(f), "mean_words": F.round(X.words_per_line(f), 6)}, {
    "lines": D.count("f", r"[^\n]*\S[^\n]*"), "mean_words": f"round({D.words_per_line('f')}, 6)"})
_SCRUBBED = f"substr(regexp_replace(text, {D.q(L.SCRUB_PATTERN)}, '', 'g'), 1, {L.SCRUB_LENGTH})"
text_query("t8_scrub_text", lambda f, text: {"digest": F.md5(X.scrub_text(text))},
           {"digest": f"md5({_SCRUBBED})"})
text_query("t8_scrub_text_profiles", lambda f, text: {"scrubbed": X.scrub_text(text)},
           {"scrubbed": _SCRUBBED}, "profiles")
text_query("t9_education_context", lambda f, text: {"context": X.education_context(f)},
           {"context": D.education_context("f")}, "profiles")


@query("t10_language_counts", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def languages(spark, d):
    return I.table(spark, d, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


text_query("t11_count_items", lambda f, text: {"items": X.count_items(text)}, {
    "items": f"len(list_filter(string_split(coalesce(text, ''), ','), lambda p: {D.strip('p')} <> ''))"})


@query("t12_norm_key", "SELECT lower(trim('  ' || upper(p_name) || ' ')) AS name_key, count(*) AS n FROM part GROUP BY 1")
def norm_keys(spark, d):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))
    return I.table(spark, d, "part").groupBy(X.norm_key(raw).alias("name_key")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- patterns
def _likeness(f, text):
    judged = X.resume_likeness(f)
    return {"score": judged.score, "is_resume": judged.is_resume.cast("int")}


for _src in ("docs", "profiles"):
    _suffix = "" if _src == "docs" else "_profiles"
    text_query("x6_generic_phrase_score" + _suffix, lambda f, text: {"score": M.generic_phrase_score(f)},
               {"score": D.generic_phrase_score("f")}, _src)
    text_query("x7_achievement_count" + _suffix, lambda f, text: {"achievements": X.achievement_count(f)},
               {"achievements": D.achievement_count("f")}, _src)
    text_query("x8_certification_count" + _suffix, lambda f, text: {"certifications": X.certification_count(f)},
               {"certifications": D.certification_count("f")}, _src)
    text_query("x9_education_level" + _suffix, lambda f, text: {"level": X.education_level(f)},
               {"level": D.education_level("f")}, _src)
    text_query("x10_previous_job" + _suffix, lambda f, text: {"previous_job": X.has_previous_job(f, text)},
               {"previous_job": D.has_previous_job("f", "text")}, _src)
    text_query("p1_resume_likeness" + _suffix, _likeness, {
        "score": D.likeness("f"), "is_resume": D.flag(f"({D.likeness('f')}) >= 45")}, _src)

text_query("x11_promotion_keywords", lambda f, text: {"keywords": X.promotion_keywords(f)},
           {"keywords": D.promotion_keywords("f")}, "profiles")
text_query("x12_contact_signals", lambda f, text: {
    n: X.contact_signals(f)[n].cast("int") for n in ("email", "phone", "url")}, {
    "email": D.flag(D.has("f", L.EMAIL)),
    "phone": D.flag("(" + " OR ".join(D.has("f", p) for p in L.PHONES) + ")"),
    "url": D.flag(D.any_in("f", L.PROFILE_URLS))})
text_query("x13_section_signals", lambda f, text: {
    **{n: X.section_signals(f)[n].cast("int") for n in ("education", "experience", "skills")},
    "negatives": X.negative_hits(f)}, {
    "education": D.flag(D.any_in("f", L.EDUCATION_HEADINGS)),
    "experience": D.flag(D.any_in("f", L.EXPERIENCE_HEADINGS)),
    "skills": D.flag(D.any_in("f", L.SKILL_HEADINGS)),
    "negatives": D.total([D.flag(f"contains(f, {D.q(k)})") for k in L.NEGATIVE_KEYWORDS])}, "profiles")
text_query("x14_required_years", lambda f, text: {"required": X.required_years(f)},
           {"required": D.required_years("f")}, "postings")
text_query("x15_claimed_years", lambda f, text: {"claimed": X.claimed_years(f)},
           {"claimed": D.claimed_years("f")}, "profiles")


@query("x18_parse_unit_score", """SELECT event_id, TRY_CAST(regexp_extract(reply, '(0\\.\\d+|1\\.0|0)', 1) AS DOUBLE) AS score
FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no idea' WHEN event_id % 4 = 1 THEN 'Score: 1.0'
 ELSE concat('about ', CAST(event_id % 3 AS INT), '.', user_id, ' I think') END AS reply FROM events)""")
def unit_scores(spark, d):
    reply = F.expr("case when event_id % 4 = 0 then 'no idea' when event_id % 4 = 1 then 'Score: 1.0' "
                   "else concat('about ', cast(event_id % 3 as int), '.', user_id, ' I think') end")
    return I.table(spark, d, "events").select("event_id", X.parse_unit_score(reply).alias("score"))


_REPLY = ("case event_type when 'error' then concat('{{\"consensus\": ', {q}) "
          "when 'view' then concat('{{\"consensus\": \"Agree\", \"n\": ', user_id, '}}') "
          "else concat('{{\"consensus\": \"', case when user_id % 2 = 0 then 'Agree' else 'Disagree' end, "
          "'\", \"reasoning\": \"case ', event_id, '\"}}') end").format(q="user_id")


@query("x19_parse_review", f"""SELECT event_id, CASE WHEN json_valid(r) THEN r ->> '$.consensus' END AS consensus,
  CASE WHEN json_valid(r) THEN r ->> '$.reasoning' END AS reasoning
FROM (SELECT event_id, {_REPLY} AS r FROM events)
WHERE json_valid(r) AND r ->> '$.consensus' IS NOT NULL AND r ->> '$.reasoning' IS NOT NULL""")
def reviews(spark, d):
    parsed = I.table(spark, d, "events").select("event_id", X.parse_review(F.expr(_REPLY)).alias("r"))
    return parsed.filter("r is not null").select("event_id", "r.consensus", "r.reasoning")


# ------------------------------------------------------------ dictionaries
SKILLS_CTE = (f"n AS (SELECT *, lower({D.normalize_aliases('f', ci=False)}) AS norm FROM f), "
              f"k AS (SELECT *, {D.term_hits('norm', L.default_skills())} AS skills FROM n)")


@query("x1_skill_extraction", f"{PROFILES}, {SKILLS_CTE} SELECT doc_id, array_to_string(skills, '|') AS skills, "
       "len(skills) AS n FROM k")
def skills(spark, d):
    found = profiles(spark, d).select("doc_id", N.extract_skills(folded(), SKILLS).alias("s"))
    return found.select("doc_id", F.array_join("s", "|").alias("skills"), F.size("s").alias("n"))


def _phrases(spark, d):
    """Dictionary from the benchmark: its words of five letters or more and its
    two-word phrases; it grows with that table."""
    items = I.table(spark, d, "benchmark").select(X.fold(F.col("text")).alias("t"))
    words = F.regexp_extract_all("t", F.lit(r"\b([a-z]{5,})\b"))
    pairs = F.regexp_extract_all("t", F.lit(r"\b([a-z]{4,} [a-z]{4,})\b"))
    return items.select(F.explode(F.concat(words, pairs)).alias("term")).distinct().select(
        F.lit("phrase").alias("kind"), "term")


@query("x1_term_matching", rf"""{DOCS},
p AS (SELECT DISTINCT unnest(list_concat({D.found('t', r'\b[a-z]{5,}\b')}, {D.found('t', r'\b[a-z]{4,} [a-z]{4,}\b')})) AS term
  FROM (SELECT {D.fold('text')} AS t FROM benchmark)),
w AS (SELECT doc_id, list_zip(range(1, len(r) + 1), r) AS z FROM
  (SELECT doc_id, {D.found('f', r'[a-z0-9_]+|[^a-z0-9_]+')} AS r FROM f)),
t AS (SELECT doc_id, x[1] AS pos, x[2] AS tok FROM (SELECT doc_id, unnest(z) AS x FROM w)),
one AS (SELECT doc_id, tok AS term FROM t),
two AS (SELECT a.doc_id, a.tok || ' ' || c.tok AS term FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND b.tok = ' '
  JOIN t c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2)
SELECT term, count(DISTINCT doc_id) AS n_docs, CAST(sum(doc_id) AS BIGINT) AS doc_sum FROM
  (SELECT DISTINCT doc_id, term FROM (SELECT * FROM one UNION ALL SELECT * FROM two) SEMI JOIN p USING (term)) GROUP BY term""")
def term_matching(spark, d):
    dim = M.term_dimension(_phrases(spark, d))
    return M.match_terms(docs(spark, d), dim).groupBy("term").agg(
        F.count("*").alias("n_docs"), F.sum("doc_id").alias("doc_sum"))


def _dictionary_sql() -> str:
    """The built-in terms with their tokens, as rows."""
    kinds = {"skill": L.default_skills(), "education": L.EDUCATION_TERMS,
             "job_title": sorted({r for rs in L.JOB_CATEGORIES.values() for r in rs})}
    rows = [f"({D.q(kind)}, {D.q(t)}, [{', '.join(map(D.q, re.findall(r'[a-z0-9_]+|[^a-z0-9_ ]', t.lower())))}])"
            for kind, terms in kinds.items() for t in terms]
    return ", ".join(rows)


# all hits of a text in their order of preference, taken one by one unless a word is taken
LONGEST_CTES = rf"""lw AS (SELECT doc_id, {D.found('f', r'[a-z0-9_]+|[^a-z0-9_[:space:]]')} AS r FROM f),
lt AS (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS pos FROM lw),
ld AS (SELECT * FROM (VALUES {_dictionary_sql()}) AS v(kind, term, toks)),
lh AS (SELECT doc_id, pos - 1 AS pos, kind, term, len(toks) AS n FROM lt JOIN ld ON r[pos] = toks[1]
  AND r[pos:pos + len(toks) - 1] = toks),
lg AS (SELECT doc_id, list({{'pos': pos, 'n': n, 'kind': kind, 'term': term}} ORDER BY n DESC, pos, kind, term) AS hs FROM lh GROUP BY doc_id),
lk AS (SELECT doc_id, list_reduce(list_transform(hs, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept,
  lambda q: x[1].pos < q.pos + q.n AND q.pos < x[1].pos + x[1].n)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM lg),
longest AS (SELECT doc_id, h.kind AS kind, h.term AS term, h.pos AS pos, h.n AS n_tokens FROM (SELECT doc_id, unnest(kept) AS h FROM lk))"""


@query("x2_longest_matching", f"{PROFILES}, {LONGEST_CTES} SELECT * FROM longest")
def longest(spark, d):
    dim = M.term_dimension(M.builtin_terms(spark).filter("kind <> 'generic'"))
    return M.match_terms_longest(profiles(spark, d), dim)


def _kind_query(name, kind, terms):
    tests = ", ".join(
        f"CASE WHEN {D.has('f', N.term_pattern(t))} THEN {D.q(t)} END" for t in terms)

    @query(name, f"{PROFILES} SELECT * FROM (SELECT doc_id, unnest([{tests}]) AS term FROM f) WHERE term IS NOT NULL")
    def run(spark, d):
        dim = M.term_dimension(M.builtin_terms(spark).filter(F.col("kind") == kind))
        return M.match_terms(profiles(spark, d), dim).select("doc_id", "term")


_kind_query("x3_education_terms", "education", L.EDUCATION_TERMS)
_kind_query("x4_job_titles", "job_title", sorted({r for rs in L.JOB_CATEGORIES.values() for r in rs}))


@query("x5_nearest_seed", """WITH s AS (SELECT label AS seed_id, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY label),
p AS (SELECT e.vec_id, s.seed_id, least(1e0, greatest(0e0, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(s.vec AS DOUBLE[])))) AS sim
  FROM embeddings e CROSS JOIN s),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, seed_id) AS r FROM p)
SELECT vec_id, CASE WHEN sim > 0 THEN seed_id END AS best_seed, round(sim, 6) AS best_sim, CAST(sim > 0.82 AS INT) AS admitted FROM b WHERE r = 1""")
def nearest(spark, d):
    table = I.table(spark, d, "embeddings")
    seeds = table.groupBy(F.col("label").alias("seed_id")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    vecs = table.select("vec_id", F.col("embedding").alias("vec"))
    return M.nearest_seed(vecs, seeds).select(
        "vec_id", F.when(F.col("best_sim") > 0, F.col("best_seed")).alias("best_seed"),
        F.round("best_sim", 6).alias("best_sim"), F.col("admitted").cast("int").alias("admitted"))


_AIM = f"(CASE WHEN {D.strip('t')} <> '' THEN t ELSE f END)"


@query("x16_relevant_categories", f"{POSTINGS} SELECT job_id, {D.joined(D.relevant_categories(_AIM))} AS categories FROM f")
def relevant(spark, d):
    title, text = F.col("title"), F.col("description")
    aim = X.fold(F.when(X.strip(title) != "", title).otherwise(text))
    return I.postings(spark, d).select(
        "job_id", F.array_join(M.relevant_categories(aim), "|").alias("categories"))


_role_tests = ", ".join(
    f"CASE WHEN contains(f, {D.q(r.lower())}) THEN {{'category': {D.q(c)}, 'role': {D.q(r)}}} END"
    for c, rs in L.JOB_CATEGORIES.items() for r in rs)


@query("x17_role_mentions", f"{PROFILES}, u AS (SELECT doc_id, unnest([{_role_tests}]) AS x FROM f) "
       "SELECT doc_id, x.category AS category, x.role AS role FROM u WHERE x IS NOT NULL")
def roles(spark, d):
    return M.role_mentions(profiles(spark, d))


_NO_EDUCATION = " OR ".join(D.has("f", N.term_pattern(t)) for t in L.EDUCATION_TERMS)
_SEEDS = ", ".join(f"({i}, {D.q(p)}, {D.strings(p.lower().split())})" for i, p in enumerate(L.SEED_PHRASES))


@query("x5_admitted_terms", f"""{PROFILES},
c AS MATERIALIZED (SELECT doc_id, {D.content_words('f')} AS words, {_NO_EDUCATION} AS known FROM f),
w AS (SELECT doc_id, unnest(words) AS w FROM c), n1 AS MATERIALIZED (SELECT w, count(*) AS n FROM w GROUP BY w),
pr AS MATERIALIZED (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM c)),
held AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, count(*) AS n FROM pr GROUP BY a, b HAVING count(*) >= 5) t JOIN n1 x ON x.w = a JOIN n1 y ON y.w = b
  WHERE t.n * (SELECT sum(n) FROM n1) >= 3e0 * x.n * y.n),
found AS MATERIALIZED (SELECT pr.* FROM pr JOIN held USING (a, b)),
cand AS MATERIALIZED (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, w AS phrase FROM w UNION ALL SELECT doc_id, a || ' ' || b FROM found
  UNION ALL SELECT x.doc_id, x.a || ' ' || x.b || ' ' || y.b FROM found x JOIN found y ON y.doc_id = x.doc_id AND y.i = x.i + 1)
  WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE known)),
u AS MATERIALIZED (SELECT DISTINCT phrase, string_split(phrase, ' ') AS words FROM cand WHERE length(phrase) BETWEEN 3 AND 25 AND phrase NOT IN ({", ".join(D.q(t.lower()) for t in L.EDUCATION_TERMS)})),
seeds(seed_id, phrase, words) AS (VALUES {_SEEDS}),
{D.hashed_ctes('c', 'doc_id', 'words', 'h')}, {D.hashed_ctes('u', 'phrase', 'words', 'hp', 'h')}, {D.hashed_ctes('seeds', 'phrase', 'words', 'hs', 'h')},
near AS (SELECT hp.phrase FROM hp JOIN hs USING (b) GROUP BY hp.phrase, hs.phrase HAVING sum(hp.x * hs.x) > 82e-2)
SELECT doc_id, list_aggregate(list_transform(string_split(phrase, ' '), lambda t: upper(t[1]) || t[2:]), 'string_agg', ' ') AS term
FROM cand WHERE phrase IN (SELECT phrase FROM near)""")
def admitted(spark, d):
    """Texts without a known degree: phrases mined from all texts, admitted when near a seed."""
    texts = write_once(profiles(spark, d).select(       # read by several passes
        "doc_id", "folded", X.content_words(folded()).alias("words")))
    dim = M.term_dimension(M.builtin_terms(spark).filter("kind = 'education'"))
    model = training.fit_encoder(texts.select("words"), "words")
    return M.admit_terms(texts, dim, lambda df: training.embed(df, "words", model=model)[0])
