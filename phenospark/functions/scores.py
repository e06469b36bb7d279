"""Scores, gates and calls, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LOGIT_EPS, MASH_K, NO_CALL_HIGH, NO_CALL_LOW, OOD_REASON


def mash_distance(j: Column, k: int = MASH_K) -> Column:
    return F.when(j <= 0, 1.0).when(j >= 1, 0.0).otherwise(-F.log(2 * j / (1 + j)) / k)


def mash_jaccard(distance: float, k: int = MASH_K) -> float:
    """The Jaccard similarity above which the Mash distance is below ``distance``."""
    from math import exp

    return exp(-k * distance) / (2 - exp(-k * distance))


def logit(p: Column, eps: float = LOGIT_EPS) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def target_gate(targets: Column, vocabulary: Column, present: Column) -> Column:
    """present only if all targets are; a target outside the vocabulary was never looked for: unknown."""
    return (
        F.when(targets.isNull() | (F.size(targets) == 0), "unknown")
        .when(F.size(F.array_except(targets, vocabulary)) > 0, "unknown")
        .when(F.size(F.array_except(targets, present)) == 0, "present")
        .otherwise("absent")
    )


def raw_call(gate: Column, p: Column) -> Column:
    return F.when(gate == "absent", "not_applicable").when(p >= 0.5, "likely_to_fail").otherwise("likely_to_work")


def calibrated_call(call: Column, p: Column, fitted: Column, ood: Column) -> Column:
    """A missing target stands; then uncalibrated, out of distribution and the band (ends included) give no call."""
    return F.when(call == "not_applicable", call).when(~fitted | ood | p.between(NO_CALL_LOW, NO_CALL_HIGH), "no_call").when(p >= 0.5, "likely_to_fail").otherwise("likely_to_work")


def no_call_reason(call: Column, p: Column, fitted: Column, ood: Column, failure: Column) -> Column:
    band = F.format_string(f"Calibrated probability %.2f falls in the ambiguous band ({NO_CALL_LOW:.2f}-{NO_CALL_HIGH:.2f}).", p)
    return (
        F.when(call == "not_applicable", F.lit(None).cast("string"))
        .when(~fitted, F.concat(F.lit("Confidence could not be calibrated for this drug ("), failure, F.lit(").")))
        .when(ood, OOD_REASON)
        .when(p.between(NO_CALL_LOW, NO_CALL_HIGH), band)
    )


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits, as its exact binary value says: ties, and only they, go to the even digit.

    The product x * 10**digits is known with its error (a product of two halves each), which tells on which side of a tie
    the exact product lies where the rounded one is a tie."""
    s = float(10**digits)
    p = x * F.lit(s)

    def halves(v):
        c = v * F.lit(134217729.0)  # 2**27 + 1
        high = c - (c - v)
        return high, v - high

    (xh, xl), (sh, sl) = halves(x), halves(F.lit(s))
    error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    k = F.rint(p)
    tie = F.when((p - k == 0.5) & (error > 0), 1.0).when((p - k == -0.5) & (error < 0), -1.0).otherwise(0.0)
    return (k + tie) / F.lit(s)


def display_confidence(p: Column) -> Column:
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))


def state_confidence(call: Column, p: Column) -> Column:
    """Confidence in the reported state, to three digits; not clamped, which only shown percents are."""
    return rounded(F.when(call == "likely_to_work", 1 - p).otherwise(p), 3)


def sort_key(call: Column) -> Column:
    """Order of report rows: what works, what fails, what has no call."""
    return F.when(call == "likely_to_work", 0).when(call == "likely_to_fail", 1).otherwise(2)


def certainty_label(percent: Column) -> Column:
    return F.when(percent >= 99, ">99%").when(percent <= 1, "<1%").otherwise(F.format_string("%.1f%%", percent))
