"""Rule-based classification, its explanation, and later overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import lexicon as L
from dossier.functions.numeric import cap, round_exact


def _severity(match: Column, generic: Column, stuffing: Column) -> Column:
    return (F.when((generic >= 0.60) | (match < 0.20), F.lit(2))
            .when((generic >= 0.40) | (stuffing >= 0.60) | (match < 0.40), F.lit(1))
            .otherwise(F.lit(0)))


def heuristic_probs(match: Column, generic: Column, stuffing: Column,
                    density: Column) -> Column:
    """Struct(cls, p0, p1, p2) from four features."""
    cls = _severity(match, generic, stuffing)
    c = cap(F.lit(0.60) + match * F.lit(0.35) + density * F.lit(0.01), 0.95)

    def by(two: float, one: float, zero: Column) -> Column:
        return F.when(cls == 2, F.lit(two)).when(cls == 1, F.lit(one)).otherwise(zero)

    return F.struct(
        cls.alias("cls"), by(0.05, 0.15, c).alias("p0"),
        by(0.10, 0.70, (F.lit(1.0) - c) * F.lit(0.6)).alias("p1"),
        by(0.85, 0.15, (F.lit(1.0) - c) * F.lit(0.4)).alias("p2"))


def verdict(p0: Column, p1: Column, p2: Column) -> Column:
    """Struct(classification, confidence) from the probability of 'Authentic'."""
    label = (F.when(p0 >= 0.80, F.lit(L.AUTHENTIC)).when(p0 >= 0.50, F.lit(L.SUSPICIOUS))
             .otherwise(F.lit(L.FAKE)))
    confidence = (F.when(p0 >= 0.80, p0).when(p0 >= 0.50, F.greatest(p1, p0))
                  .otherwise(F.when(p2 > p0, p2).otherwise(F.lit(1.0) - p0)))
    return F.struct(label.alias("classification"),
                    round_exact(confidence, 4).alias("confidence"))


def heuristic_contributions(label: Column, match: Column, generic: Column,
                            stuffing: Column, density: Column) -> Column:
    """Array of (feature, value, contribution) toward the label, in model order."""
    severity = _severity(match, generic, stuffing)
    s = F.when(severity == 2, F.lit(1.0)).when(severity == 1, F.lit(0.5)).otherwise(F.lit(0.0))

    def item(name: str, value: Column, authentic: Column, fake: Column) -> Column:
        part = (F.when(label == L.AUTHENTIC, authentic).when(label == L.FAKE, fake)
                .otherwise(F.lit(0.0)))
        return F.struct(F.lit(name).alias("feature"), value.alias("value"),
                        part.alias("contribution"))

    return F.array(
        item("final_match_score", match, match * (F.lit(1.0) - s), -match * s),
        item("skill_density", density, density * F.lit(0.01), -density * F.lit(0.01)),
        item("generic_phrase_score", generic, -generic * s, generic * s),
        item("keyword_stuffing_score", stuffing, -stuffing * s, stuffing * s))


def top_contributions(contributions: Column, k: int = 3) -> Column:
    """The k largest by absolute contribution; those up to 0.0001 dropped.

    Equal contributions keep the later feature first.
    """
    ranked = F.sort_array(F.transform(contributions, lambda x, i: F.struct(
        F.abs(x.contribution).alias("size"), i.alias("i"), x.feature.alias("feature"),
        x.value.alias("value"), x.contribution.alias("contribution"))), asc=False)
    kept = F.filter(F.slice(ranked, 1, k), lambda x: x.size > 0.0001)
    return F.transform(kept, lambda x: F.struct(
        x.feature.alias("feature"), round_exact(x.value, 4).alias("value"),
        round_exact(x.contribution, 4).alias("contribution")))


def classify(df: DataFrame, is_resume: Column | None = None) -> DataFrame:
    """Adds classification, confidence, prob_0..2 and top_features.

    Rows that fail ``is_resume`` are labelled 'Not a Resume' with confidence 1.0,
    zero probabilities and no explanation.
    """
    c = F.col
    four = [F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in (
        "final_match_score", "generic_phrase_score", "keyword_stuffing_score", "skill_density")]
    out = df.withColumn("_p", heuristic_probs(*four))
    out = out.withColumn("_v", verdict(c("_p.p0"), c("_p.p1"), c("_p.p2")))
    out = out.withColumn("_top", top_contributions(
        heuristic_contributions(c("_v.classification"), *four)))
    gate = F.lit(True) if is_resume is None else F.coalesce(is_resume, F.lit(False))
    none = F.filter("_top", lambda x: F.lit(False))
    return out.select(
        *df.columns,
        F.when(gate, c("_v.classification")).otherwise(L.NOT_A_RESUME).alias("classification"),
        F.when(gate, c("_v.confidence")).otherwise(F.lit(1.0)).alias("confidence"),
        *[F.when(gate, round_exact(c(f"_p.p{i}"), 4)).otherwise(F.lit(0.0)).alias(f"prob_{i}")
          for i in range(3)],
        F.when(gate, c("_top")).otherwise(none).alias("top_features"))


def needs_review(label: Column) -> Column:
    return label.isin(L.SUSPICIOUS, L.FAKE)


def apply_reviews(df: DataFrame, reviews: DataFrame, keys=("doc_id", "job_id")) -> DataFrame:
    """A 'Disagree' review of a flagged row turns its label into 'Suspicious'.

    ``reviews`` holds (keys, consensus, reasoning).  Of several reviews of one key a
    'Disagree' prevails, whatever else was answered.
    """
    other = F.coalesce(F.col("consensus") != "Disagree", F.lit(True)).alias("other")
    one = reviews.groupBy(*keys).agg(
        F.min(F.struct(other, "consensus", "reasoning")).alias("review"))
    flagged = needs_review(F.col("classification"))
    joined = df.join(one, list(keys), "left")
    return joined.withColumn("review", F.when(flagged, F.col("review"))).withColumn(
        "classification",
        F.when(F.col("review.consensus") == "Disagree", F.lit(L.SUSPICIOUS))
        .otherwise(F.col("classification")))


def first_answer(reviews: DataFrame, keys=("doc_id",), value: str = "score",
                 priority: str = "priority") -> DataFrame:
    """The non-null answer of the provider with the lowest priority number."""
    return reviews.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(F.struct(priority, value)).alias("_first")).select(
        *keys, F.col(f"_first.{value}").alias(value))


def plausibility(df: DataFrame, answers: DataFrame | None, keys=("doc_id",)) -> DataFrame:
    """Adds ai_plausibility_score: the first answer, 0.5 without one."""
    if answers is None:
        return df.withColumn("ai_plausibility_score", F.lit(0.5))
    joined = df.join(answers.select(*keys, F.col("score").alias("_score")), list(keys), "left")
    return joined.withColumn(
        "ai_plausibility_score", F.coalesce("_score", F.lit(0.5))).drop("_score")
