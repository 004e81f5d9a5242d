"""Scalar column functions: clamps, ratios, time arithmetic, and the curves that ratings are made of.

Curves are given by their anchor points, so that a curve is data and one function draws it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Anchors = list[tuple[float, float]]


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def safe_ratio(num: Column, den: Column, default: float | None = None) -> Column:
    ratio = F.try_divide(num.cast("double"), den.cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def banded(x: Column, bands: list[tuple[float, float]], otherwise: float) -> Column:
    """Value of the first band whose lower bound x reaches; bands run from the highest bound down."""
    return reduce(lambda c, b: c.when(x >= b[0], F.lit(b[1])), bands[1:], F.when(x >= bands[0][0], F.lit(bands[0][1]))).otherwise(F.lit(otherwise))


def polyline(x: Column, anchors: Anchors) -> Column:
    """Straight lines between anchor points, flat outside them."""
    out = F.lit(float(anchors[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).when(x < anchors[0][0], F.lit(float(anchors[0][1]))).otherwise(out)


# Rounding

def round_half_up(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def round_toward_plus(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


# Time: four lengths of a month, each with a name of its own

def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def years_between(later: Column, earlier: Column) -> Column:
    return days_between(later, earlier) / 365.25


def months_mean(later: Column, earlier: Column) -> Column:
    return days_between(later, earlier) / 30.4375


def months_rounded(later: Column, earlier: Column) -> Column:
    return days_between(later, earlier) / 30.44


def months_twelfth(later: Column, earlier: Column) -> Column:
    return days_between(later, earlier) / (365.25 / 12)


def months_ago(as_of: Column, months: int) -> Column:
    """Calendar months."""
    return F.add_months(as_of, -months)


def age_years(as_of: Column, born: Column) -> Column:
    """Completed years."""
    return F.floor(F.months_between(as_of, born) / 12).cast("int")


# The rating curves

DECAY: Anchors = [(1, 1.0), (3, 0.3), (5, 0.1)]
TITLE_DECAY: Anchors = [(0, 80), (3, 50), (8, 25)]
FORMER_TITLE_DECAY: Anchors = [(1, 70), (3, 25)]
SCORE: Anchors = [(0, 0), (25, 25), (45, 60), (60, 80), (75, 93), (88, 100)]
SEVERITY = [(25, 0.30), (22, 0.45), (14, 0.60), (8, 0.75), (3, 0.90)]
OPPONENT_BONUS = [(18, 20), (10, 12), (5, 5)]
SCORE_BANDS = [(75, "elite"), (55, "strong"), (35, "solid")]
CONFIDENCE = [(0.18, "high"), (0.08, "medium")]


def decay(years: Column) -> Column:
    return polyline(years, DECAY)


def score_curve(raw: Column) -> Column:
    return F.round(polyline(raw, SCORE))


def loss_severity(tier: Column) -> Column:
    return banded(tier, SEVERITY, 1.0)


def opponent_bonus(mean_tier: Column) -> Column:
    return banded(mean_tier, OPPONENT_BONUS, 0)


def age_factor(age: Column) -> Column:
    steps = F.when(age < 26, 0.0).when(age <= 30, 0.05).when(age <= 32, 0.02).when(age <= 34, 0.0).when(age <= 36, -0.04).when(age <= 38, -0.08).otherwise(-0.12)
    return F.when(age.isNull(), F.lit(0.0)).otherwise(steps)


def credibility(n: Column) -> Column:
    return F.least(F.lit(1.0), 0.85 + 0.15 * F.least(F.lit(1.0), n / 12))


def career_credibility(n: Column) -> Column:
    return F.least(F.lit(1.0), 0.62 + 0.38 * n / 14)


def layoff_penalty(months: Column) -> Column:
    return clamp((months - 12) * 0.5, 0, 15)


def win_quality(finish: Column, margin: Column) -> Column:
    """A finish counts most; a decision by its margin on the cards; without cards as it is."""
    return F.when(finish, F.lit(1.15)).when(margin.isNotNull(), 0.90 + 0.10 * clamp(margin, 0, 2)).otherwise(F.lit(1.0))


def rank_points(rank: Column) -> Column:
    return F.when(rank <= 5, 22).when(rank <= 10, 14).when(rank <= 15, 8).otherwise(0)


def elapsed_seconds(round_no: Column, seconds: Column, scheduled: Column) -> Column:
    """Seconds fought; without a round all that was scheduled."""
    return F.coalesce((round_no - 1) * 300 + F.coalesce(seconds, F.lit(300)), scheduled * 300)


def shrink(rate: Column, n: Column, prior: float, weight: float) -> Column:
    return (rate * n + prior * weight) / (n + weight)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def temperature(p: Column, t: float) -> Column:
    return sigmoid(logit(p) / t)


def beta_calibrated(p: Column, a: float, b: float, c: float) -> Column:
    q = clamp(p, 1e-6, 1 - 1e-6)
    return sigmoid(a * F.log(q) - b * F.log(1 - q) + c)


def corrected(p: Column, scale: float, shifts: list[tuple[Column, float]]) -> Column:
    """A calibrated probability with a linear correction of its logit; a missing feature shifts nothing."""
    z = scale * logit(p)
    for x, w in shifts:
        z = z + F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) * w
    return sigmoid(z)


def confidence_band(p: Column) -> Column:
    return banded(F.abs(p - 0.5), CONFIDENCE, "low")


def recency_weight(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


#: What a late and an early finish, a decision and any other win are worth at most, and the least that a win is.
EARLY, LATE, DECISION, LEAST_WIN, ROUNDS_COUNT, JUDGES_COUNT = 0.95, 0.85, 0.35, 0.55, 0.65, 0.35


def graded(method: Column, elapsed: Column, round_margin: Column, judge_margin: Column) -> Column:
    """How clearly the winner won, before the least that any win is worth: margins are those of the winner, from -1 to 1."""
    finish = EARLY - (EARLY - LATE) * clamp(elapsed, 0.0, 1.0)
    cards = 0.5 + DECISION * (ROUNDS_COUNT * round_margin + JUDGES_COUNT * judge_margin)
    return F.when(method.isin("ko", "submission"), finish).when(method == "decision", cards).otherwise(LEAST_WIN)
