"""Year spans inside one text: array expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import lexicon as L
from dossier.functions.numeric import let, round_exact
from dossier.functions.text import (
    at_word, claimed_years, count_of, education_context, promotion_keywords)

SPANS = "array<struct<s:int,e:int>>"


def plausible_year(y: Column, as_of_year: int, first: int = 1950) -> Column:
    return y.between(first, as_of_year)


def raw_spans(folded: Column, as_of_year: int, rule: str = "experience") -> Column:
    """Every (start, end) written in the text; present/current/now -> as_of_year."""
    pattern = L.SPAN_EXPERIENCE if rule == "experience" else L.SPAN_OVERLAP
    # a span opens with four digits, and closes with four digits or a word
    found = F.regexp_extract_all(folded, F.lit(at_word(pattern)), F.lit(0))
    return F.transform(found, lambda x: F.struct(
        F.substring(x, 1, 4).cast("int").alias("s"),
        F.coalesce(F.substring(x, -4, 4).try_cast("int"), F.lit(as_of_year)).alias("e")))


def extract_spans(folded: Column, as_of_year: int, rule: str = "experience") -> Column:
    """Valid spans in (start, end) order.

    rule 'experience': start < end <= as_of+5, 1950 <= start <= as_of.
    rule 'overlap': dash separators only, start <= end, 1950 <= start <= as_of.
    """
    def valid(x: Column) -> Column:
        ok = plausible_year(x.s, as_of_year)
        if rule == "experience":
            return ok & (x.s < x.e) & (x.e <= as_of_year + 5)
        return ok & (x.s <= x.e)

    return F.array_sort(F.filter(raw_spans(folded, as_of_year, rule), valid))


def merged_length(spans: Column) -> Column:
    """Years covered by the union of sorted spans; touching spans merge."""
    start = F.struct(F.lit(0).alias("years"), F.lit(-1).alias("until"))
    return F.aggregate(
        spans, start,
        lambda acc, x: F.struct(
            (acc.years + F.greatest(F.lit(0), x.e - F.greatest(x.s, acc.until))
             ).alias("years"),
            F.greatest(acc.until, x.e).alias("until")),
        lambda acc: acc.years)


def years_experience(spans: Column, claimed: Column) -> Column:
    """Merged years; averaged with an explicit claim, or the claim alone; cap 50."""
    both = F.struct(merged_length(spans).cast("double").alias("m"), claimed.alias("c"))
    years = let(both, lambda x: F.when(x.c.isNull(), x.m).when(
        x.m > 0, (x.m + x.c) / 2).otherwise(x.c))
    return round_exact(F.least(years, F.lit(50.0)), 1)


def text_years_experience(folded: Column, as_of_year: int) -> Column:
    return years_experience(extract_spans(folded, as_of_year), claimed_years(folded))


def overlap_pairs(spans: Column) -> Column:
    """Number of pairs i < j of sorted spans with start_j < end_i."""
    return F.when(F.size(spans) < 2, F.lit(0)).otherwise(F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(spans))), F.lit(0),
        lambda acc, j: acc + F.size(F.filter(
            F.slice(spans, 1, j - 1),
            lambda x: x.e > F.element_at(spans, j).s))))


def mentioned_years(folded: Column) -> Column:
    """Sorted distinct years 19xx/20xx written anywhere."""
    found = F.regexp_extract_all(folded, F.lit(f"({L.YEAR_ANYWHERE})"))
    return F.array_sort(F.transform(F.array_distinct(found), lambda y: y.cast("int")))


def year_gaps(years: Column, compat: bool = False) -> Column:
    """Struct(gap_count, total_gap_years) of steps over 2 between sorted years.

    ``compat`` keeps the historic result, in which only the century digits were
    looked at and no gap was ever found.
    """
    if compat:
        return F.struct(F.lit(0).alias("gap_count"), F.lit(0).alias("total_gap_years"))
    steps = F.zip_with(
        F.slice(years, 2, F.greatest(F.lit(0), F.size(years) - 1)),
        F.slice(years, 1, F.greatest(F.lit(0), F.size(years) - 1)),
        lambda later, earlier: later - earlier)
    gaps = F.filter(steps, lambda d: d > 2)
    return F.struct(
        F.size(gaps).alias("gap_count"),
        F.aggregate(gaps, F.lit(0), lambda acc, d: acc + d).alias("total_gap_years"))


def promotion_speed(folded: Column, years: Column, compat: bool = False) -> Column:
    """Promotion keywords per distinct year; 0 unless more than one year.

    ``compat`` counts distinct centuries in place of distinct years.
    """
    n = F.size(F.array_distinct(F.transform(
        years, lambda y: F.floor(y / 100)))) if compat else F.size(years)
    return F.when(n > 1, round_exact(promotion_keywords(folded) / n, 4)).otherwise(
        F.lit(0.0))


def year_words(folded: Column, as_of_year: int) -> Column:
    """Distinct plausible stand-alone years, newest first."""
    found = F.regexp_extract_all(folded, F.lit(at_word(L.YEAR_WORD)), F.lit(0))
    years = F.transform(F.array_distinct(found), lambda y: y.cast("int"))
    return F.sort_array(
        F.filter(years, lambda y: plausible_year(y, as_of_year)), asc=False)


def graduation_year(folded: Column, as_of_year: int) -> Column:
    """Likely graduation year.

    Years of the education context, else of the whole text; from 1990 on; of the
    three most recent the first that is 1 to 50 years back, else the most recent;
    as_of - 4 when there is none.
    """
    def pick(recent: Column) -> Column:
        past = F.filter(recent, lambda y: (F.lit(as_of_year) - y).between(1, 50))
        return F.coalesce(F.get(past, F.lit(0)), F.get(recent, F.lit(0)),
                          F.lit(as_of_year - 4))

    # the context may only hold years when the text does
    near = let(education_context(folded), lambda part: year_words(part, as_of_year))
    years = let(near, lambda ys: F.when(F.size(ys) > 0, ys).otherwise(
        year_words(folded, as_of_year)))
    recent = F.slice(F.filter(years, lambda y: y >= 1990), 1, 3)
    return F.when(folded.rlike(L.YEAR_ANYWHERE), let(recent, pick)).otherwise(
        F.lit(as_of_year - 4))


def graduation_gap(years: Column, graduation: Column, as_of_year: int) -> Column:
    return F.when(graduation <= 0, F.lit(0.0)).otherwise(
        round_exact((F.lit(as_of_year) - graduation) - years, 2))


def span_count(folded: Column) -> Column:
    return count_of(folded, L.SPAN_OVERLAP)


def written_spans(folded: Column, as_of_year: int) -> Column:
    """Spans between written dates ('Jan 2019 - March 2021', '03/2018 to present'), in months.

    A month is counted from year 0; a year without a month, and present, current or now (the
    year ``as_of_year``), stand for its January.  Valid spans, sorted: the start's year from
    1950 to ``as_of_year``, start before end.
    """
    part = lambda k: F.regexp_extract_all(folded, F.lit(L.WRITTEN_SPAN), F.lit(k))
    months = F.array(*[F.lit(m) for m in L.MONTHS])

    def month(name: Column, number: Column, year: Column) -> Column:
        within = F.when(name != "", F.array_position(months, name).cast("int")).when(
            number != "", number.try_cast("int")).otherwise(F.lit(1))
        return F.coalesce(year.try_cast("int"), F.lit(as_of_year)) * 12 + within - 1

    found = F.array(*[part(k) for k in range(1, 7)])
    return F.array_sort(F.filter(
        let(found, lambda parts: F.transform(
            F.arrays_zip(*[F.get(parts, F.lit(k)).alias(f"g{k}") for k in range(6)]),
            lambda g: F.struct(month(g.g0, g.g1, g.g2).alias("s"), month(g.g3, g.g4, g.g5).alias("e")))),
        lambda x: plausible_year(F.floor(x.s / 12), as_of_year) & (x.s < x.e)))


def written_years_experience(folded: Column, as_of_year: int) -> Column:
    """Years covered by the union of written spans, to one digit, cap 50."""
    months = merged_length(written_spans(folded, as_of_year))
    return round_exact(F.least(months / F.lit(12.0), F.lit(50.0)), 1)
