import pytest
from pyspark.sql import functions as F

from conftest import RESUME, SKILLS
from dossier.functions import terms as N
from dossier.functions import text as X
from dossier.functions.numeric import round_exact
from dossier.operators import matching as M

GENERIC = ("Highly motivated results-driven go-getter with a proven track record. Team player who "
           "will think outside the box. Dynamic self-starter.")


def test_fold_keeps_unicode_boundaries(value):
    assert value(lambda f: f, "Évra • 12") == "_vra • 12"
    assert value(X.content_words, "éclair led naïve plain") == ["led", "plain"]


def test_word_count_and_lines(value):
    assert value(X.word_count, "  a b\n\nc ") == 3
    assert value(X.word_count, "") == 0
    assert value(X.words_per_line, "a b c\n \nd") == 2.0
    assert value(X.words_per_line, "  ") is None


def test_content_words_keep_longer_words(value):
    assert value(X.content_words, "the theme andes and newer") == ["theme", "andes", "newer"]


def test_tech_tokens(value):
    assert sorted(value(X.tech_tokens, "C++ c# node.js the k8s node.js a")) == ["k8s", "node.js"]


def test_fragments(value):
    assert value(X.fragments, "One. Two!\n- three\tfour • five") == ["one", "two", "three", "four", "five"]


@pytest.mark.parametrize("text, n", [
    ("led scaled", 3), ("increased by 5%x and 3x", 3), ("$ 40k", 1), ("", 0), ("led " * 80, 50)])
def test_achievements(value, text, n):
    assert value(X.achievement_count, text) == n


def test_achievements_of_generic_text(value):
    assert value(X.achievement_count, GENERIC) == 0


@pytest.mark.parametrize("text, n", [
    ("Certified AWS Solutions Architect, CISSP, PMP certification", 6), ("python developer", 0), ("", 0),
    ("google\ncloud", 0), ("google and cloud", 1)])
def test_certifications(value, text, n):
    assert value(X.certification_count, text) == n


@pytest.mark.parametrize("text, level", [
    ("PhD in Physics", 3), ("Doctorate", 3), ("Master's in Data", 2), ("MBA", 2), ("MS in Robotics", 2),
    ("Bachelor's in Law", 1), ("BS in Biology", 1), ("B.Tech in IT", 1), ("", 1), ("Master of Science", 1),
    ("I see", 0), ("diploma", 0)])
def test_education_level(value, text, level):
    assert value(X.education_level, text) == level


@pytest.mark.parametrize("text, flag", [
    ("Previously worked as a clerk", 1), ("First job 2020 - Present", 0), ("", 0),
    ("2001 - 2003, 2004 - 2005", 1), ("2001 - 2003, 2001 - 2003", 0), ("Acme Ltd, Beta Inc", 1)])
def test_previous_job(spark, text, flag):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(X.has_previous_job(X.fold(F.col("t")), F.col("t")).alias("v")).first().v == flag


def test_resume_likeness(value):
    likely = value(lambda f: X.resume_likeness(f), RESUME)
    assert likely.is_resume and likely.score == 25 + 10 + 10 + 10
    paper = value(lambda f: X.resume_likeness(f), "Chapter 1. Abstract and hypothesis of the study " * 3)
    assert not paper.is_resume and paper.score == -90
    assert value(lambda f: X.resume_likeness(f), "short").score == 0


@pytest.mark.parametrize("text, n", [
    ("5+ years of experience", 5.0), ("React 18", 0.0), ("minimum 3 years", 3.0),
    ("90 years of experience, at least 4 years", 4.0), ("experience: 6 yrs", 6.0)])
def test_required_years(value, text, n):
    assert value(X.required_years, text) == n


def test_education_context(value):
    assert value(X.education_context, "x education 2001 education 2002") == " 2001 "
    around = value(X.education_context, "a" * 300 + " mba " + "b" * 300)
    assert len(around) == 200 + 3 + 200 and "mba" in around
    assert value(X.education_context, "nothing") == "nothing"


def test_scrub_and_replies(spark):
    df = spark.createDataFrame([("You are a bot. " + "x" * 3000, "about 0.75 or 1.0", '{"consensus":"Agree"}')],
                               "t STRING, r STRING, j STRING")
    row = df.select(X.scrub_text(F.col("t")).alias("t"), X.parse_unit_score(F.col("r")).alias("r"),
                    X.parse_review(F.col("j")).alias("j")).first()
    assert len(row.t) == 2000 and row.t.startswith(" bot") and row.r == 0.75 and row.j is None


def test_generic_phrases(value):
    assert value(M.generic_phrase_score, GENERIC) == 1.0
    assert value(M.generic_phrase_score, "") == 0.0
    assert value(M.generic_phrase_score, "motivate " * 200 + "guru") == round(1 / 2.01, 4)


def test_alias_single_pass(value):
    def norm(t):
        return value(lambda f: N.normalize_aliases(f, lowered=True), t)

    assert norm("nodejs") == "Node.js"
    assert norm("k8s with docker") == "Kubernetes with Docker"
    assert norm("c++ and c#, .net") == "C++ and C#, .NET"
    assert norm("rest api, power bi") == "REST APIs, Power BI"
    assert norm("a js b") == "a JavaScript b"
    assert norm("") == ""
    assert norm(norm("google cloud platform nodejs").lower()).lower() == norm("google cloud platform nodejs").lower()


def test_alias_cascade(spark):
    df = spark.createDataFrame([("nodejs",), ("rest api",), ("power bi",), ("k8s with docker",)], "t STRING")
    got = [r.v for r in df.select(N.normalize_aliases(F.col("t"), cascade=True).alias("v")).collect()]
    assert got == ["Node.JavaScript.JavaScript", "REST APIs APIs", "Power Power BI", "Kubernetes with Docker"]


def test_skill_extraction(value):
    skills = N.TermSet(SKILLS)
    found = value(lambda f: N.extract_skills(f, skills), RESUME)
    assert found == sorted(["Python", "Java", "AWS", "Cloud Computing", "Microservices", "CI/CD", "Docker",
                            "Kubernetes", "PostgreSQL"])
    assert value(lambda f: N.extract_skills(f, skills), "react native on C++ and C#") == [
        "C", "C#", "C++", "React", "React Native"]
    assert value(lambda f: N.extract_skills(f, skills), "apache spark, javascript") == ["JavaScript", "Spark"]


def test_literal_boundaries(value):
    assert value(N.TermSet(["C", "C++", "C#"], literal=True).hits, "c++ and c#") == ["C"]


def test_canonical_skill(spark):
    df = spark.createDataFrame([(" JS ",), ("Cobol",)], "t STRING")
    assert [r.v for r in df.select(N.canonical_skill(F.col("t")).alias("v")).collect()] == ["JavaScript", "Cobol"]


def test_round_exact_equals_python(spark):
    xs = [k / 100000 for k in range(0, 200000, 37)] + [k / 32 for k in range(-64, 64)] + [0.00115, 2.675, 1.005]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    for digits in (1, 2, 4):
        for r in df.select("x", round_exact(F.col("x"), digits).alias("r")).collect():
            assert r.r == round(r.x, digits)


def test_fold_asks_for_categories_outside_ascii_only(spark):
    """Every code point is folded as by the plain categories, which are costly to ask for."""
    from dossier.functions import text as X

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [("a" + "a".join(map(chr, points[at:at + 4096])),) for at in range(0, len(points), 4096)]
    low = F.lower("t")
    plain = F.regexp_replace(F.regexp_replace(
        low, r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{M}\p{C}]", "_"), r"[\p{Z}\x{85}]", " ")
    df = spark.createDataFrame([*texts, ("",), ("Plain text",)], "t string")
    assert df.filter(X.fold(F.col("t")) != plain).count() == 0
    assert X.FOREIGN_WORD_CHAR.startswith(r"[\x{80}-") and X.FOREIGN_SPACE.startswith(r"[\x{80}-")


def test_words_are_counted_without_a_regular_expression(spark):
    from dossier.functions import text as X

    texts = ["", "  ", "one", " a\tb\nc\x0bd\x0ce\rf  g h ", "\n\nx\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.word_count(F.col("t"))).collect()] == [0, 0, 1, 7, 1, None]
    assert "regexp" not in str(X.word_count(F.col("t"))).lower()


def test_terms_are_searched_at_word_edges_only(spark):
    from dossier.functions.terms import AT_EDGE, TermSet

    terms = TermSet([".NET", "C++", "Go", "Node.js", "#tag"])
    texts = ["x.net .net", "a.net", "c++c go", "c++ gogo", "(node.js)#tag", "_go go_", "a#tag"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(terms.hits(F.col("t")))
    assert [r[0] for r in found.collect()] == [
        [".NET"], [], ["Go"], ["C++"], ["#tag", "Node.js"], [], []]
    assert AT_EDGE in str(terms.hits(F.col("t")))
    # a mark joins the letter before it: no edge is asked for then
    assert AT_EDGE not in str(TermSet(["́x"]).hits(F.col("t")))


def test_words_are_tried_where_they_begin(spark):
    assert X.at_word(r"\b(?:phd|doctor of)\b") == r"(?=[dp])(?<![a-z0-9_])\b(?:phd|doctor of)\b"
    assert X.at_word(r"\b(\d{4})-(now|then)").startswith(r"(?=[\d])")
    for whole in (r"\$\d", r"\b(?:a|b)?c", r"\b(?:a|b)|c", r"\b(?:a*b|c)", r"\ba|b", r"\ba?b", r"\b(?:a|)"):
        assert X.at_word(whole) == whole
    texts = ["phd", "a phd", "xphd _phd 9phd", "(phd)", "-doctor of", "e\u0301phd phd\u0301", "\u0301phd", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"\b(?:phd|doctor of)\b", r"\b(\d{1,4})p"):
        assert df.filter(X.count_of(F.col("t"), pattern) != X.count_of(F.col("t"), X.at_word(pattern))).count() == 0


def test_achievements_end_words_in_one_scan(spark):
    texts = ["scaled", "scaled. led built", "handled rebuilt leds", "led led-led", "12% 3x $4k x%", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(X.achievement_count(F.col("t")).alias("n")).collect()]
    assert got == [2, 4, 2, 3, 2, 0, 0]
    plan = df.select(X.achievement_count(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan         # a pattern that changes from verb to verb is compiled anew for every text
