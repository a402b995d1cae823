"""Sets held as arrays without duplicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.numeric import round_exact, share


def ordered(items: Column) -> Column:
    """``array_sort`` (nulls last) by the built-in order; the comparison of ``array_sort`` is an
    expression, which costs many times that on long arrays."""
    known = F.array_compact(items)
    return F.concat(F.sort_array(known), F.array_repeat(F.lit(None), F.size(items) - F.size(known)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 0.0 when either side is empty."""
    return round_exact(share(
        F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), 4)


def skill_gap(resume: Column, target: Column) -> Column:
    """Struct of matched, missing and extra names, sorted, with their counts."""
    matched = F.array_sort(F.array_intersect(resume, target))
    missing = F.array_sort(F.array_except(target, resume))
    extra = F.array_sort(F.array_except(resume, target))
    return F.struct(
        matched.alias("matched"), missing.alias("missing"), extra.alias("extra"),
        F.size(matched).alias("match_count"), F.size(missing).alias("missing_count"),
        F.size(extra).alias("extra_count"))


def token_recall(resume: Column, target: Column) -> Column:
    """Share of the target's tokens that the resume holds."""
    return round_exact(share(
        F.size(F.array_intersect(target, resume)), F.size(target)), 4)
