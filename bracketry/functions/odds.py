"""Prices and probabilities: conversion, margins, boards, settlement and the market maker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp

#: Prices that are offered.
LOWEST, HIGHEST = 1.02, 25.0


def american_to_decimal(v: Column) -> Column:
    return F.when(v >= 100, F.round(1 + v / 100, 3)).when(v <= -100, F.round(1 + 100 / F.abs(v), 3))


def devig(a: Column, b: Column) -> Column:
    """Probability of the first side; null unless both prices are above 1."""
    return F.when((a > 1) & (b > 1), (1 / a) / (1 / a + 1 / b))


def devig_many(prices: Column, lo: float = 1.0, hi: float = 1.6) -> Column:
    """Probabilities of all outcomes; null where a price is missing or the book is incoherent."""
    total = F.aggregate(prices, F.lit(0.0), lambda s, p: s + 1 / p)
    return F.when(F.forall(prices, lambda p: p > 1) & total.between(lo, hi), F.transform(prices, lambda p: 1 / p / total))


def edge_guard(model: Column, market: Column, width: float = 0.15) -> Column:
    """The model's probability, held near the market's where there is one."""
    held = F.when(market.isNull(), model).otherwise(F.least(market + width, F.greatest(market - width, model)))
    return clamp(held, 1e-6, 1 - 1e-6)


def price(share: Column, margin: float) -> Column:
    return clamp(F.round(1 / (share * (1 + margin)), 2), LOWEST, HIGHEST)


def margin_prices(probs: Column, margin: float) -> Column:
    """Prices of an array of probabilities: normalised, loaded with the margin, rounded, kept within the band."""
    total = F.aggregate(probs, F.lit(0.0), lambda s, p: s + p)
    return F.transform(probs, lambda p: F.when(total > 0, price(F.greatest(p / total, F.lit(1e-9)), margin)).otherwise(F.lit(HIGHEST)))


def reconcile(cells: Column, side: Column) -> Column:
    """Cells of one side scaled to that side's probability; thirds where they have no mass."""
    total = F.aggregate(cells, F.lit(0.0), lambda s, p: s + p)
    return F.transform(cells, lambda p: F.when(total > 0, p / total * side).otherwise(side / F.size(cells)))


def forecast(diff: Column, scale: float) -> Column:
    return 1 / (1 + F.exp(-diff / scale))


def grade(code: Column, winner_a: Column, finish: Column, settled: Column) -> Column:
    """won, lost or void for a selection: a, b, finish, distance. Undecided contests void the side bets."""
    side = lambda won: F.when(winner_a.isNull(), "void").when(won, "won").otherwise("lost")
    whole = lambda won: F.when(won, "won").otherwise("lost")
    graded = F.when(code == "a", side(winner_a)).when(code == "b", side(~winner_a)).when(code == "finish", whole(finish)).when(code == "distance", whole(~finish))
    return F.when(settled, graded).otherwise(F.lit("open"))


def lmsr_cost(shares: Column, b: float) -> Column:
    """b times the log of the summed exponentials, shifted by the largest so that none overflows."""
    top = F.array_max(shares)
    return top + b * F.log(F.aggregate(shares, F.lit(0.0), lambda s, q: s + F.exp((q - top) / b)))


def lmsr_prices(shares: Column, b: float) -> Column:
    top = F.array_max(shares)
    total = F.aggregate(shares, F.lit(0.0), lambda s, q: s + F.exp((q - top) / b))
    return F.transform(shares, lambda q: F.exp((q - top) / b) / total)


def lmsr_shares_for(price_now: Column, spend: Column, b: float) -> Column:
    """Shares of one outcome that a sum buys: the cost equation solved for the shares."""
    return b * F.log((F.exp(spend / b) - (1 - price_now)) / price_now)


def lmsr_seed(prob: Column, b: float) -> Column:
    """Shares that give a price against outcomes at the same base."""
    return b * F.log(prob)
