"""Document-target pairing and pair scores.

Each side is reduced to compact columns first (``document_facts``, ``target_facts``);
only those meet in the join, never the full texts of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import lexicon as L
from dossier.functions import sets, spans
from dossier.functions import text as X
from dossier.functions.numeric import cap, let, round_exact, share
from dossier.functions.terms import TermSet, normalize_aliases
from dossier.functions.vectors import cosine
from dossier.operators import matching

MIN_WORDS_FOR_PURE_VECTOR = 15


def pair(docs: DataFrame, jobs: DataFrame, on="job_id") -> DataFrame:
    """Every document of a batch with that batch's target.

    An equi-join on the batch key.  No hint: a small target table is broadcast by
    the optimizer on its measured size, a large one is shuffled and a hot batch is
    split by the adaptive skew join.
    """
    return docs.join(jobs, on)


def word_counts(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: array of (w, c), one entry per distinct word of a row."""
    s, at = f"_{out}_sorted", f"_{out}_starts"
    sorted_df = df.withColumn(s, sets.ordered(F.col(words)))
    starts = sorted_df.withColumn(at, F.filter(
        F.transform(s, lambda w, i: F.when(
            (i == 0) | (w != F.get(F.col(s), i - 1)), i)),
        lambda i: i.isNotNull()))
    counted = starts.withColumn(out, F.transform(at, lambda p, j: F.struct(
        F.get(F.col(s), p).alias("w"),
        (F.coalesce(F.get(F.col(at), j + 1), F.size(s)) - p).alias("c"))))
    return counted.drop(s, at)


def keyword_stuffing(counts: Column, n_words: Column, target_words: Column) -> Column:
    """Share of target words in the document, doubled, plus a repetition penalty
    (2% a repeat, at most 30%) once a single word occurs more than ten times."""
    zero = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("most"))
    seen = F.aggregate(
        F.filter(counts, lambda x: F.array_contains(target_words, x.w)), zero,
        lambda acc, x: F.struct((acc.hits + x.c).alias("hits"),
                                F.greatest(acc.most, x.c).alias("most")),
        lambda acc: F.struct(
            acc.hits.alias("hits"),
            F.when(acc.most > 10, cap(acc.most * F.lit(0.02), 0.3)
                   ).otherwise(F.lit(0.0)).alias("penalty")))
    score = let(seen, lambda x: cap(share(x.hits, n_words) * F.lit(2.0) + x.penalty, 1.0))
    return F.when((n_words == 0) | (F.size(target_words) == 0), F.lit(0.0)).otherwise(
        round_exact(score, 4))


def semantic_similarity(cos: Column, recall: Column, target_words: Column,
                        target_blank: Column) -> Column:
    """Vector similarity; blended with token recall when the target is short."""
    weight = cap(F.lit(0.3) + target_words * F.lit(0.04), 0.85)
    blended = weight * cos + (F.lit(1.0) - weight) * recall
    return F.when(target_blank, F.lit(0.0)).when(
        target_words >= MIN_WORDS_FOR_PURE_VECTOR, round_exact(cos, 4)).otherwise(
        round_exact(cap(blended, 1.0), 4))


def experience_ratio(years: Column, required: Column) -> Column:
    return (F.when(required > 0, cap(F.try_divide(years, required), 1.0))
            .when(years >= 5, cap(F.lit(0.7) + years * F.lit(0.03), 1.0))
            .when(years >= 1, cap(F.lit(0.4) + years * F.lit(0.1), 0.85))
            .when(years > 0, F.lit(0.35)).otherwise(F.lit(0.2)))


def experience_relevance(years: Column, required: Column, relevant: Column,
                         mentioned: Column) -> Column:
    """Years ratio times the share of relevant role categories mentioned."""
    factor = F.when(F.size(relevant) == 0, F.lit(0.5)).otherwise(
        share(F.size(F.array_intersect(relevant, mentioned)), F.size(relevant)))
    return round_exact(cap(experience_ratio(years, required) * factor, 1.0), 4)


def final_match(semantic: Column, skill: Column, experience: Column) -> Column:
    return round_exact(F.lit(0.6) * semantic + F.lit(0.25) * skill
                       + F.lit(0.15) * experience, 4)


def evidence_text(folded: Column) -> Column:
    """Fragments that hold an action verb, one per line."""
    verbs = X.at_word(r"\b(?:" + "|".join(L.EVIDENCE_VERBS) + r")\b")
    return F.array_join(F.filter(X.fragments(folded), lambda p: p.rlike(verbs)), "\n")


def skill_alignment(folded: Column, skills: Column, terms: TermSet) -> Column:
    """Share of the skills that occur next to an action verb."""
    supported = F.array_intersect(skills, terms.hits(evidence_text(folded)))
    return round_exact(share(F.size(supported), F.size(skills)), 4)


def skill_density(n_skills: Column, years: Column, words: Column) -> Column:
    """Skills per year, or per 150 words when no years are known; cap 20."""
    per_year = F.try_divide(n_skills.cast("double"), years)
    per_words = n_skills / F.greatest(F.lit(1.0), words / F.lit(150))
    return round_exact(cap(
        F.when(years > 0, per_year).when(words > 0, per_words).otherwise(F.lit(0.0)), 20.0), 4)


def document_facts(docs: DataFrame, skills: TermSet, as_of_year: int,
                   compat: bool = False, phrases=None, categories=None) -> DataFrame:
    """Everything a document contributes to a pair.  Row-local: no shuffle.

    ``docs`` has a ``text`` column, which is dropped; other columns are kept.  ``phrases`` (stock
    phrases) and ``categories`` (category -> roles) replace the built-in lists.
    """
    keep = [c for c in docs.columns if c != "text"]
    folded = F.col("folded")
    # stage 1: one scan of the text per fact
    base = docs.select(*keep, X.fold(F.col("text")).alias("folded")).withColumn(
        "_norm", F.lower(normalize_aliases(folded, lowered=True)))
    facts = base.select(
        *keep, "folded",
        X.word_count(folded).alias("words"),
        X.content_words(folded).alias("_content"),
        X.tech_tokens(F.col("_norm")).alias("tokens"),
        skills.hits(F.col("_norm")).alias("skills"),
        spans.extract_spans(folded, as_of_year).alias("_spans"),
        spans.extract_spans(folded, as_of_year, "overlap").alias("_overlap"),
        spans.mentioned_years(folded).alias("_years"),
        X.claimed_years(folded).alias("_claimed"),
        spans.graduation_year(folded, as_of_year).alias("graduation_year"),
        X.achievement_count(folded).alias("achievement_count"),
        X.certification_count(folded).alias("num_certifications"),
        X.education_level(folded).alias("education_level_encoded"),
        matching.mentioned_categories(folded, categories).alias("mentioned"))
    # stage 2: facts derived from facts
    facts = facts.select(
        "*",
        spans.years_experience(F.col("_spans"), F.col("_claimed")).alias("years_experience"),
        spans.overlap_pairs(F.col("_overlap")).alias("overlapping_jobs"),
        matching.generic_phrase_score(folded, phrases, F.col("words")).alias("generic_phrase_score"),
        X.resume_likeness(folded, words=F.col("words")).alias("likeness"),
        spans.year_gaps(F.col("_years"), compat).total_gap_years.alias("gap_years"),
        spans.promotion_speed(folded, F.col("_years"), compat).alias("promotion_speed"),
        skill_alignment(folded, F.col("skills"), skills).alias("skill_experience_alignment"),
        F.size("_content").alias("n_content"), F.size("skills").alias("num_skills"))
    facts = facts.select(
        "*",
        spans.graduation_gap(F.col("years_experience"), F.col("graduation_year"),
                             as_of_year).alias("experience_graduation_gap"),
        skill_density(F.col("num_skills"), F.col("years_experience"),
                      F.col("words")).alias("skill_density"))
    return word_counts(facts, "_content", "word_counts").drop(
        "folded", "_content", "_spans", "_overlap", "_years", "_claimed")


def target_facts(jobs: DataFrame, skills: TermSet, categories=None) -> DataFrame:
    """Everything a target contributes to a pair.

    ``jobs`` has ``title`` and ``description``, which are dropped; the rest is kept.
    """
    keep = [c for c in jobs.columns if c not in ("title", "description")]
    title, desc = F.col("_title"), F.col("_desc")
    target = F.when(X.strip(title) != "", title).otherwise(desc)
    staged = jobs.select(
        *keep, X.fold(F.col("title")).alias("_title"),
        X.fold(F.col("description")).alias("_desc"))
    staged = staged.withColumn("_norm", F.lower(normalize_aliases(desc, lowered=True))).withColumn(
        "_target", target)
    return staged.select(
        *keep,
        F.array_distinct(X.content_words(desc)).alias("target_words"),
        X.tech_tokens(F.col("_norm")).alias("target_tokens"),
        X.word_count(F.col("_norm")).alias("target_length"),
        skills.hits(F.col("_norm")).alias("target_skills"),
        X.required_years(F.col("_target")).alias("required_years"),
        matching.relevant_categories(F.col("_target"), categories).alias("relevant"))


def pair_scores(pairs: DataFrame, compat: bool = False, cos: Column | None = None) -> DataFrame:
    """Adds the pair-level features to joined facts.

    ``cos`` is the pair's cosine; without it, ``pairs`` also has ``doc_vec`` and ``target_vec``
    (null when unknown).
    """
    c = F.col
    cos = cosine(c("doc_vec"), c("target_vec")) if cos is None else cos
    scored = pairs.withColumn("_cos", cos).select(
        "*",
        sets.jaccard(c("skills"), c("target_skills")).alias("skill_overlap_score"),
        F.when(c("_cos").isNotNull(), semantic_similarity(
            c("_cos"), sets.token_recall(c("tokens"), c("target_tokens")),
            c("target_length"), c("target_length") == 0)).alias("semantic_similarity"),
        experience_relevance(c("years_experience"), c("required_years"), c("relevant"),
                             c("mentioned")).alias("experience_relevance_score"),
        keyword_stuffing(c("word_counts"), c("n_content"),
                         c("target_words")).alias("keyword_stuffing_score")).drop("_cos")
    return scored.withColumn("final_match_score", final_match(
        c("semantic_similarity"), c("skill_overlap_score"), c("experience_relevance_score")))
