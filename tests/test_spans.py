import random

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RESUME
from dossier.functions import spans as S
from dossier.functions import text as X
from dossier.operators import spantables as ST


@pytest.mark.parametrize("text, years", [
    ("I have 5 years of experience.", 5.0), ("Worked from 2018 to 2020.", 2.0),
    ("Worked 2018-2020 and 2019-2021.", 3.0), ("No dates", 0.0),
    ("2018–2022 and 2020–2024", 6.0), ("2020 – Present", 6.0), (RESUME, 8.5),
    ("99 years experience", 50.0)])
def test_years_experience(value, text, years):
    assert value(lambda f: S.text_years_experience(f, AS_OF), text) == years


@pytest.mark.parametrize("text, year", [
    ("Bachelor of Science, 2015", 2015), ("born 1990, graduated 2012, PhD 2018", 2018),
    ("No date", 2022), (RESUME, 2018), ("education 1985", 2022), ("degree 2026 and 2020", 2020),
    ("degree 2026", 2026)])
def test_graduation_year(value, text, year):
    assert value(lambda f: S.graduation_year(f, AS_OF), text) == year


def test_graduation_gap(spark):
    df = spark.createDataFrame([(5.0, 2018), (15.0, 2018), (5.0, 0)], "y DOUBLE, g INT")
    got = [r.v for r in df.select(S.graduation_gap(F.col("y"), F.col("g"), AS_OF).alias("v")).collect()]
    assert got == [3.0, -7.0, 0.0]


def test_overlap_and_gaps(value):
    def pairs(t):
        return value(lambda f: S.overlap_pairs(S.extract_spans(f, AS_OF, "overlap")), t)

    assert pairs("2010 - 2014, 2012 - 2016, 2013 - present") == 3
    assert pairs("2010 - 2012, 2012 - 2014") == 0
    assert pairs("2010 - 2012") == 0
    gaps = value(lambda f: S.year_gaps(S.mentioned_years(f)), "2010 - 2012, 2018 - 2020")
    assert (gaps.gap_count, gaps.total_gap_years) == (1, 6)
    assert value(lambda f: S.year_gaps(S.mentioned_years(f), compat=True), "2010, 2018").total_gap_years == 0
    assert value(lambda f: S.year_gaps(S.mentioned_years(f)), "none").gap_count == 0


def test_promotion_speed(value):
    def speed(t, compat=False):
        return value(lambda f: S.promotion_speed(f, S.mentioned_years(f), compat), t)

    assert speed("senior lead 2010 2012") == 1.0
    assert speed("senior lead 2010 2012", compat=True) == 0.0
    assert speed("senior 1999 2012", compat=True) == 0.5
    assert speed("") == 0.0


def _merged(spans):
    covered = set()
    for s, e in spans:
        covered |= set(range(s, e))
    return len(covered)


def _overlaps(spans):
    spans = sorted(spans)
    return sum(b[0] < a[1] for i, a in enumerate(spans) for b in spans[i + 1:])


def test_tables_agree_with_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for doc in range(40):
        n = 400 if doc == 0 else rnd.randint(1, 9)  # one key holds most rows
        for _ in range(n):
            s = rnd.randint(1990, 2010)
            rows.append((doc, s, s + rnd.choice([0, 0, 1, 2, 5])))
    by_doc = {}
    for doc, s, e in rows:
        by_doc.setdefault(doc, []).append((s, e))
    df = spark.createDataFrame(rows, "doc_id INT, s INT, e INT")
    assert {r.doc_id: r.overlaps for r in ST.overlap_pairs(df).collect()} == {
        k: _overlaps(v) for k, v in by_doc.items()}
    assert {r.doc_id: r.years for r in ST.merged_years(df).collect()} == {
        k: float(_merged(v)) for k, v in by_doc.items()}
    arrays = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("sp"))
    for r in arrays.select("doc_id", S.overlap_pairs(F.col("sp")).alias("o"),
                           S.merged_length(F.col("sp")).alias("m")).collect():
        assert (r.o, r.m) == (_overlaps(by_doc[r.doc_id]), _merged(by_doc[r.doc_id]))


def test_claims_average(spark):
    spans = spark.createDataFrame([(1, 2010, 2014)], "doc_id INT, s INT, e INT")
    claims = spark.createDataFrame([(1, 8.0), (2, 3.0)], "doc_id INT, claimed DOUBLE")
    got = {r.doc_id: r.years for r in ST.merged_years(spans, claims).collect()}
    assert got == {1: 6.0, 2: 3.0}


def test_written_dates(spark):
    cases = {
        "Jan 2019 – Mar 2021": 26, "January 2019 to march 2021": 26, "01/2019 - 03/2021": 26, "2019 - 2021": 24,
        "Sept. 2018 — present": 88, "since Dec, 2020 until now": 61, "Mar 2021 - Jan 2019": None, "May 1930 - 1940": None,
        "Jan 2010 - Jan 2012; Jun 2011 - Jul 2012; 03/2015 - 04/2015": 31, "june 2019": None, "13/2019 - 2020": 12}
    df = spark.createDataFrame(list(cases.items()), "t STRING, months INT").withColumn("f", X.fold(F.col("t")))
    for r in df.select("t", "months", S.merged_length(S.written_spans(F.col("f"), 2026)).alias("got"),
                       S.written_years_experience(F.col("f"), 2026).alias("years")).collect():
        assert r.got == (r.months or 0), r.t
        assert r.years == round((r.months or 0) / 12, 1)
