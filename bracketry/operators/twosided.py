"""Contests with two sides as one row for each side.

A condition on either side of a contest becomes an equi-join on the entity: the contest is unpivoted once, by explode, and never
joined with OR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(contests: DataFrame, a: str = "a_id", b: str = "b_id", winner: str = "winner_id") -> DataFrame:
    """Each contest twice: entity, opponent, side and result (W, L, or D without a winner), with all other columns."""
    both = F.array(
        F.struct(F.lit("a").alias("side"), F.col(a).alias("entity"), F.col(b).alias("opponent")),
        F.struct(F.lit("b").alias("side"), F.col(b).alias("entity"), F.col(a).alias("opponent")),
    )
    rest = [c for c in contests.columns if c not in (a, b)]
    out = contests.select(*rest, F.inline(both))
    return out.withColumn("result", F.when(F.col(winner).isNull(), "D").when(F.col(winner) == F.col("entity"), "W").otherwise("L"))


def pair_key(a: Column, b: Column) -> Column:
    """The same for either order."""
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def swapped(df: DataFrame, suffixes: tuple[str, str] = ("_a", "_b"), complements: tuple[str, ...] = ()) -> DataFrame:
    """Every column of one side exchanged with the other's; probabilities of the first side become their complements."""
    x, y = suffixes
    names = set(df.columns)

    def of(c: str) -> Column:
        if c in complements:
            return (1 - F.col(c)).alias(c)
        other = c[: -len(x)] + y if c.endswith(x) else c[: -len(y)] + x if c.endswith(y) else c
        return F.col(other if other in names else c).alias(c)

    return df.select(*[of(c) for c in df.columns])


def symmetrised(df: DataFrame, key: str, complements: tuple[str, ...] = ()) -> DataFrame:
    """Half of the rows, by a hash of the key, with their sides exchanged, so that no side is favoured."""
    flip = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(1)), 16, 10).cast("int") % 2 == 1
    return df.where(~flip).unionByName(swapped(df.where(flip), complements=complements))


def differences(df: DataFrame, stems: list[str]) -> list[Column]:
    return [(F.col(f"{s}_a") - F.col(f"{s}_b")).alias(f"diff_{s}") for s in stems]
