"""Fragments of the checking SQL."""

from __future__ import annotations

from dossier import lexicon as L
from dossier.functions.terms import alternation, edges, escape


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def fold(col: str) -> str:
    foreign = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{M}\p{C}]"
    return (f"regexp_replace(regexp_replace(lower(coalesce({col}, '')), {q(foreign)}, '_', 'g'), "
            rf"'[\p{{Z}}\x{{85}}]', ' ', 'g')")


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip(col: str) -> str:
    return f"trim({col}, {BLANKS})"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def found(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {q(pattern)}, {group})"


def count(col: str, pattern: str) -> str:
    return f"len({found(col, pattern)})"


def first(col: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({col}, {q(pattern)}, {group})"


def flag(cond: str) -> str:
    return f"CAST({cond} AS INT)"


def total(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def any_in(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def joined(items: str, sep: str = "|") -> str:
    return f"array_to_string({items}, {q(sep)})"


def round_exact(expr: str, digits: int) -> str:
    s = f"1e{digits}"
    w = f"2e{digits}"
    low = f"floor(v * {s})"
    hi = "(v * 1.34217729e8 - (v * 1.34217729e8 - v))"
    excess = f"(({hi} * {w} - ({low} * 2e0 + 1e0)) + (v - {hi}) * {w})"
    up = f"({excess} > 0 OR ({excess} = 0 AND {low} % 2e0 <> 0))"
    return (f"list_transform([CAST({expr} AS DOUBLE)], lambda v: CASE WHEN abs(v * {s} - {low} - 5e-1) "
            f"< 1e-6 THEN ({low} + CASE WHEN {up} THEN 1e0 ELSE 0e0 END) / {s} "
            f"ELSE round(v, {digits}) END)[1]")


def share(part: str, whole: str) -> str:
    return (f"CASE WHEN coalesce({whole}, 0) = 0 THEN 0e0 "
            f"ELSE CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) END")


# ------------------------------------------------------------ operators

def word_count(f: str) -> str:
    return count(f, r"\S+")


def content_words(f: str) -> str:
    return (f"list_filter({found(f, r'\b[a-z]{3,}\b')}, "
            f"lambda w: NOT list_contains({strings(L.CONTENT_STOPWORDS)}, w))")


def tech_tokens(f: str) -> str:
    return (f"list_filter(list_distinct({found(f, r'\b[a-z][a-z0-9+#.]+\b')}), "
            f"lambda w: NOT list_contains({strings(L.TECH_STOPWORDS)}, w))")


def words_per_line(f: str) -> str:
    lines = count(f, r"[^\n]*\S[^\n]*")
    return f"CASE WHEN {lines} = 0 THEN NULL ELSE CAST({word_count(f)} AS DOUBLE) / {lines} END"


def fragments(f: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({f}, {q(r'[.!?\n•\t-]')}), "
            f"lambda p: {strip('p')}), lambda p: p <> '')")


def term_hits(f: str, terms) -> str:
    """Sorted distinct names of the terms present, one test per term."""
    tests = []
    for name in terms:
        low = name.lower()
        left, right = edges(low)
        tests.append(f"CASE WHEN {has(f, left + escape(low) + right)} THEN {q(name)} END")
    return (f"list_sort(list_distinct(list_filter([{', '.join(tests)}], "
            f"lambda x: x IS NOT NULL)))")


def canonical(key: str) -> str:
    table = "MAP {" + ", ".join(f"{q(a)}: {q(c)}" for a, c in L.ALIASES.items()) + "}"
    return f"{table}[{key}]"


def normalize_aliases(col: str, ci: bool = True) -> str:
    """One pass: the parts between alias hits, with the canonical names put back."""
    pattern = ("(?i)" if ci else "") + "(?:" + alternation(L.ALIASES) + ")"
    names = (f"list_transform({found(col, pattern)}, lambda h: {canonical('lower(h)')})")
    parts = f"string_split_regex({col}, {q(pattern)})"
    return (f"CASE WHEN NOT {has(col, pattern)} THEN {col} ELSE array_to_string(list_transform("
            f"list_zip({parts}, {names}), lambda z: z[1] || coalesce(z[2], '')), '') END")


def achievement_count(f: str) -> str:
    patterns = [*L.ACHIEVEMENT_FIGURES, *[v + r"\b" for v in L.ACHIEVEMENT_VERBS]]
    return f"least({total([count(f, p) for p in patterns])}, 50)"


def certification_count(f: str) -> str:
    return f"least({total([flag(has(f, p)) for p in L.CERTIFICATION_PATTERNS])}, 30)"


def education_level(f: str) -> str:
    rungs = " ".join(f"WHEN {has(f, p)} THEN {n}" for n, p in L.EDUCATION_LEVELS)
    return f"CASE {rungs} ELSE {L.EDUCATION_DEFAULT} END"


def has_previous_job(f: str, text: str) -> str:
    spans = found(text, "(?i)" + L.YEAR_ANYWHERE + r"\s*[-–—]\s*(?:present|current|"
                  + L.YEAR_ANYWHERE + ")")
    phrases = " OR ".join(has(f, p) for p in L.PREVIOUS_JOB_PHRASES)
    titles = total([flag(has(f, p)) for p in L.PREVIOUS_JOB_TITLES])
    return flag(f"({phrases}) OR len(list_distinct({spans})) >= 2 OR {titles} >= 2 "
                f"OR {count(f, L.COMPANY_SUFFIXES)} >= 2")


def promotion_keywords(f: str) -> str:
    return total([flag(f"contains({f}, {q(k)})") for k in L.PROMOTION_KEYWORDS])


def likeness(f: str) -> str:
    def points(cond, n):
        return f"CASE WHEN {cond} THEN {n} ELSE 0 END"

    phones = "(" + " OR ".join(has(f, p) for p in L.PHONES) + ")"
    negatives = total([flag(f"contains({f}, {q(k)})") for k in L.NEGATIVE_KEYWORDS])
    score = total([
        points(has(f, L.EMAIL), 25), points(phones, 20), points(any_in(f, L.PROFILE_URLS), 15),
        points(any_in(f, L.EDUCATION_HEADINGS), 10), points(any_in(f, L.EXPERIENCE_HEADINGS), 10),
        points(any_in(f, L.SKILL_HEADINGS), 10), f"({negatives} * -30)",
        points(f"coalesce({words_per_line(f)}, 0) > 25", -25)])
    return f"CASE WHEN length({strip(f)}) < 50 THEN 0 ELSE {score} END"


def required_years(f: str) -> str:
    tries = []
    for p in L.REQUIRED_YEARS:
        n = f"TRY_CAST({first(f, p)} AS DOUBLE)"
        tries.append(f"CASE WHEN {n} BETWEEN 1 AND 50 THEN {n} END")
    return f"coalesce({', '.join(tries)}, 0e0)"


def claimed_years(f: str) -> str:
    return f"TRY_CAST({first(f, L.CLAIMED_YEARS)} AS DOUBLE)"


def education_context(f: str) -> str:
    parts = f"string_split_regex({f}, {q(L.EDUCATION_HEADING_SPLIT)})"

    def around(p):
        start = f"(length(string_split_regex({f}, {q(p)})[1]) + 1)"
        n = f"length(regexp_extract({f}, {q(p)}))"
        begin = f"greatest(1, {start} - {L.EDUCATION_HINT_REACH})"
        return (f"CASE WHEN {has(f, p)} THEN substr({f}, {begin}, {start} + {n} + "
                f"{L.EDUCATION_HINT_REACH} - {begin}) END")

    hints = ", ".join(around(p) for p in L.EDUCATION_HINTS)
    return f"CASE WHEN len({parts}) > 1 THEN {parts}[2] ELSE coalesce({hints}, {f}) END"


def raw_spans(f: str, as_of: int, pattern: str) -> str:
    return (f"list_transform(list_zip({found(f, pattern, 1)}, {found(f, pattern, 2)}), lambda z: "
            f"{{'s': CAST(z[1] AS INT), 'e': coalesce(TRY_CAST(z[2] AS INT), {as_of})}})")


def spans(f: str, as_of: int, rule: str = "experience") -> str:
    if rule == "experience":
        keep = f"x.s < x.e AND x.e <= {as_of + 5} AND x.s BETWEEN 1950 AND {as_of}"
        pattern = L.SPAN_EXPERIENCE
    else:
        keep = f"x.s <= x.e AND x.s BETWEEN 1950 AND {as_of}"
        pattern = L.SPAN_OVERLAP
    return f"list_sort(list_filter({raw_spans(f, as_of, pattern)}, lambda x: {keep}))"


def merged_length(spans_expr: str) -> str:
    """Number of years covered: every year start that lies in some span."""
    return (f"len(list_filter(range(1950, 2100), lambda y: len(list_filter({spans_expr}, "
            f"lambda x: x.s <= y AND y < x.e)) > 0))")


def years_experience(spans_expr: str, claimed: str) -> str:
    merged = f"CAST({merged_length(spans_expr)} AS DOUBLE)"
    years = (f"CASE WHEN {claimed} IS NULL THEN {merged} WHEN {merged} > 0 "
             f"THEN ({merged} + {claimed}) / 2 ELSE {claimed} END")
    return round_exact(f"least({years}, 5e1)", 1)


def overlap_pairs(spans_expr: str) -> str:
    return (f"CAST(coalesce(list_sum(list_transform({spans_expr}, lambda a, i: len(list_filter("
            f"{spans_expr}, lambda b, j: j < i AND a.s < b.e)))), 0) AS BIGINT)")


def mentioned_years(f: str) -> str:
    return (f"list_sort(list_transform(list_distinct({found(f, L.YEAR_ANYWHERE)}), "
            f"lambda y: CAST(y AS INT)))")


def graduation_year(f: str, as_of: int) -> str:
    def words(col):
        return (f"list_reverse_sort(list_filter(list_transform(list_distinct("
                f"{found(col, L.YEAR_WORD)}), lambda y: CAST(y AS INT)), "
                f"lambda y: y BETWEEN 1950 AND {as_of}))")

    near = words(f"({education_context(f)})")
    years = f"CASE WHEN len({near}) > 0 THEN {near} ELSE {words(f)} END"
    recent = f"list_filter({years}, lambda y: y >= 1990)[1:3]"
    past = f"list_filter({recent}, lambda y: {as_of} - y BETWEEN 1 AND 50)"
    return f"coalesce({past}[1], {recent}[1], {as_of - 4})"


def generic_phrase_score(f: str) -> str:
    hits = f"len({term_hits(f, L.GENERIC_PHRASES)})"
    words = word_count(f)
    score = round_exact(f"least({hits} / greatest({words} * 1e-2, 1e0), 1e0)", 4)
    return f"CASE WHEN {words} = 0 THEN 0e0 ELSE {score} END"


def relevant_categories(f: str) -> str:
    tokens = {name: sorted({t for r in roles for t in r.lower().split()})
              for name, roles in L.JOB_CATEGORIES.items()}
    words = found(f, r"\S+")
    return "list_filter([" + ", ".join(
        f"CASE WHEN len(list_intersect({words}, {strings(t)})) > 0 THEN {q(n)} END"
        for n, t in tokens.items()) + "], lambda x: x IS NOT NULL)"


def mentioned_categories(f: str) -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN {any_in(f, [r.lower() for r in roles])} THEN {q(n)} END"
        for n, roles in L.JOB_CATEGORIES.items()) + "], lambda x: x IS NOT NULL)"


def experience_relevance(years: str, required: str, relevant: str, mentioned: str) -> str:
    ratio = (f"CASE WHEN {required} > 0 THEN least({years} / {required}, 1e0) "
             f"WHEN {years} >= 5 THEN least(7e-1 + {years} * 3e-2, 1e0) "
             f"WHEN {years} >= 1 THEN least(4e-1 + {years} * 1e-1, 8.5e-1) "
             f"WHEN {years} > 0 THEN 3.5e-1 ELSE 2e-1 END")
    factor = (f"CASE WHEN len({relevant}) = 0 THEN 5e-1 ELSE "
              f"CAST(len(list_intersect({relevant}, {mentioned})) AS DOUBLE) / len({relevant}) END")
    return round_exact(f"least(({ratio}) * ({factor}), 1e0)", 4)


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return round_exact(share(both, f"(len({a}) + len({b}) - {both})"), 4)


def token_recall(resume: str, target: str) -> str:
    return round_exact(share(f"len(list_intersect({target}, {resume}))", f"len({target})"), 4)


def cosine(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0e0 ELSE least(1e0, greatest(0e0, "
            f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])))) END")


def semantic(cos: str, recall: str, words: str) -> str:
    w = f"least(3e-1 + {words} * 4e-2, 8.5e-1)"
    blend = round_exact(f"least({w} * {cos} + (1e0 - {w}) * {recall}, 1e0)", 4)
    return (f"CASE WHEN {words} = 0 THEN 0e0 WHEN {words} >= 15 THEN {round_exact(cos, 4)} "
            f"ELSE {blend} END")


def stuffing_ctes(source: str, out: str = "stuffed") -> str:
    """CTEs from (words, target) columns to keyword_stuffing_score."""
    most = ("coalesce(list_max(list_transform(list_distinct(hits), lambda u: "
            "len(list_filter(hits, lambda w: w = u)))), 0)")
    penalty = "CASE WHEN most > 10 THEN least(3e-1, most * 2e-2) ELSE 0e0 END"
    score = round_exact(
        f"least(CAST(len(hits) AS DOUBLE) / len(words) * 2e0 + {penalty}, 1e0)", 4)
    return f"""
{out}_a AS (SELECT *, list_filter(words, lambda w: list_contains(target, w)) AS hits FROM {source}),
{out}_b AS (SELECT *, {most} AS most FROM {out}_a),
{out} AS (SELECT *, CASE WHEN len(words) = 0 OR len(target) = 0 THEN 0e0 ELSE {score} END
  AS keyword_stuffing_score FROM {out}_b)"""


def evidence(f: str) -> str:
    verbs = r"\b(?:" + "|".join(L.EVIDENCE_VERBS) + r")\b"
    return f"array_to_string(list_filter({fragments(f)}, lambda p: {has('p', verbs)}), chr(10))"


def alignment(evidence_col: str, skills: str, terms) -> str:
    return round_exact(share(
        f"len(list_intersect({skills}, {term_hits(evidence_col, terms)}))", f"len({skills})"), 4)


def density(n: str, years: str, words: str) -> str:
    return round_exact(
        f"least(CASE WHEN {years} > 0 THEN {n} / {years} WHEN {words} > 0 "
        f"THEN {n} / greatest(1e0, {words} / 1.5e2) ELSE 0e0 END, 2e1)", 4)


def severity(match, generic, stuff) -> str:
    return (f"CASE WHEN {generic} >= 6e-1 OR {match} < 2e-1 THEN 2 WHEN {generic} >= 4e-1 OR "
            f"{stuff} >= 6e-1 OR {match} < 4e-1 THEN 1 ELSE 0 END")


def probs_ctes(source: str, out: str = "judged") -> str:
    """CTEs from (match, generic, stuffing, density) columns to the verdict."""
    r4 = lambda e: round_exact(e, 4)
    return f"""
{out}_a AS (SELECT *, {severity('match', 'generic', 'stuffing')} AS cls,
  least(9.5e-1, 6e-1 + match * 3.5e-1 + density * 1e-2) AS c FROM {source}),
{out}_b AS (SELECT *, CASE cls WHEN 2 THEN 5e-2 WHEN 1 THEN 1.5e-1 ELSE c END AS p0,
  CASE cls WHEN 2 THEN 1e-1 WHEN 1 THEN 7e-1 ELSE (1e0 - c) * 6e-1 END AS p1,
  CASE cls WHEN 2 THEN 8.5e-1 WHEN 1 THEN 1.5e-1 ELSE (1e0 - c) * 4e-1 END AS p2 FROM {out}_a),
{out} AS (SELECT *, CASE WHEN p0 >= 8e-1 THEN 'Authentic' WHEN p0 >= 5e-1 THEN 'Suspicious'
  ELSE 'Potentially Fake' END AS label,
  {r4('CASE WHEN p0 >= 8e-1 THEN p0 WHEN p0 >= 5e-1 THEN greatest(p1, p0) WHEN p2 > p0 THEN p2 ELSE 1e0 - p0 END')}
  AS conf, {r4('p0')} AS r0, {r4('p1')} AS r1, {r4('p2')} AS r2 FROM {out}_b)"""


def hashed_ctes(source: str, key: str, words: str, out: str, fitted: str | None = None,
                size: int = 256) -> str:
    """``out`` (key, b, x): unit vectors of hashed words; frequencies from ``source``, or from
    the ones that made ``fitted``."""
    own = "" if fitted else f"""{out}_idf AS (SELECT b, ln(((SELECT count(*) FROM {source}) + 1e0) / (count(*) + 1e0)) AS w,
  (SELECT count(*) FROM {source}) AS n FROM {out}_tf GROUP BY b), """
    idf = f"{fitted or out}_idf"
    return f"""{out}_tf AS (SELECT {key}, ('0x' || substr(md5(t), 1, 7))::BIGINT % {size} AS b, count(*) AS tf
  FROM (SELECT {key}, unnest({words}) AS t FROM {source}) GROUP BY ALL), {own}
{out}_raw AS (SELECT {key}, b, tf * coalesce(w, ln((SELECT max(n) FROM {idf}) + 1e0)) AS y FROM {out}_tf LEFT JOIN {idf} USING (b)),
{out}_norm AS (SELECT {key}, sqrt(sum(y * y)) AS norm FROM {out}_raw GROUP BY {key}),
{out} AS MATERIALIZED (SELECT {key}, b, CASE WHEN norm > 0 THEN y / norm ELSE 0e0 END AS x FROM {out}_raw JOIN {out}_norm USING ({key}))"""
