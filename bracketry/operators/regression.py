"""Regressions of several factors: Poisson and logistic by reweighted least squares, least squares with signs, all by group.

Each round is one aggregation: a group's score and its small matrix of products are summed where the rows are, and a system of
as many equations as there are features is solved in a task. Coefficients stay in a table, a row a group; nothing but the
question whether any group is unfinished comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .graph import stored

#: Newton's decrement for the size of the loss that ends a fit, the most rounds, and the log of the ratio between the ends of a
#: feature's range beyond which the data are taken for separable.
TOLERANCE, ROUNDS, SEPARABLE = 1e-12, 100, 20.0
GOING, DONE, SEPARATED, UNFINISHED = "going", "ok", "separated", "unfinished"


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column | None:
    out = None
    for c in by:
        same = left[c].eqNullSafe(right[f"_{c}"])
        out = same if out is None else out & same
    return out


def _beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join by group, where null is a group too; right has one row a group."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({c: f"_{c}" for c in by})
    return left.join(other, _same(left, other, by), how).drop(*[f"_{c}" for c in by])


def design(df: DataFrame, target: str, features: list[str], by: list[str], weight: str | None, offset: str | None, pool: bool) -> DataFrame:
    """Rows (by, _y, _o, _w, _x0...) without nulls and with a weight above 0.

    pool adds up rows of equal features and offset, which says the same to either family in fewer rows: for factors of few values.
    """
    real = lambda c: F.col(c).cast("double")
    x = [real(f).alias(f"_x{i}") for i, f in enumerate(features)]
    rows = df.select(*by, real(target).alias("_y"), (real(offset) if offset else F.lit(0.0)).alias("_o"), (real(weight) if weight else F.lit(1.0)).alias("_w"), *x)
    rows = rows.dropna(subset=[c for c in rows.columns if c not in by]).where("_w > 0")
    if pool:
        at = [*by, "_o", *[f"_x{i}" for i in range(len(features))]]
        rows = rows.groupBy(*at).agg(F.sum("_w").alias("_w"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_y"))
    return rows


def _terms(n: int, intercept: bool) -> list[Column]:
    return [*[F.lit(1.0)] * intercept, *[F.col(f"_x{i}") for i in range(n)]]


def mean_of(family: str, eta: Column) -> Column:
    if family == "poisson":
        return F.exp(F.least(eta, F.lit(700.0)))
    if family == "logit":
        return F.when(eta >= 0, 1 / (1 + F.exp(-eta))).otherwise(1 - 1 / (1 + F.exp(eta)))
    raise ValueError("family is poisson or logit")


def _moments(family: str, x: list[Column]) -> Column:
    """array of the log-likelihood, the score and the upper triangle of the information at _eta."""
    w, y, eta, mu = (F.col(c) for c in ("_w", "_y", "_eta", "_mu"))
    free = mu if family == "poisson" else F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    v = w * (mu if family == "poisson" else mu * (1 - mu))
    products = [F.sum(v * a * b) for i, a in enumerate(x) for b in x[i:]]
    return F.array(F.sum(w * (y * eta - free)), *[F.sum(w * (y - mu) * a) for a in x], *products)


def _advance(schema: StructType, intercept: bool):
    """One step of every group that has new moments."""
    kind = to_arrow_schema(schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                m = r.pop("m")
                if r["status"] == GOING and m is not None:
                    _newton(r, m, intercept)
            yield pa.RecordBatch.from_pylist(rows, kind)

    return step


def _newton(r: dict, m: list[float], intercept: bool) -> None:
    at = np.array(r["trial"])
    k = len(at)
    fined = np.full(k, r["penalty"])
    fined[: int(intercept)] = 0.0
    gain = m[0] - 0.5 * float(fined @ at**2)
    r["rounds"] += 1
    if math.isfinite(gain) and (r["best"] is None or gain >= -r["loss"] - 1e-9 * abs(r["loss"])):
        score = np.array(m[1 : k + 1]) - fined * at
        info = np.zeros((k, k))
        info[np.triu_indices(k)] = m[k + 1 :]
        info = info + np.triu(info, 1).T + np.diag(fined)
        step = np.linalg.lstsq(info, score, rcond=1e-12)[0]
        r["best"], r["loss"], r["step"] = at.tolist(), -gain, step.tolist()
        if r["penalty"] == 0 and (np.abs(at) * np.array(r["ranges"]) > SEPARABLE).any():
            r["status"] = SEPARATED
        elif abs(float(score @ step)) <= TOLERANCE * (1 + abs(gain)):
            r["status"], at = DONE, at + step
            r["best"] = at.tolist()
        r["trial"] = (at + step).tolist()
    else:
        # too far: half the step from the best place
        half = np.array(r["step"]) / 2
        r["step"], r["trial"] = half.tolist(), (np.array(r["best"]) + half).tolist()
        if np.abs(half).max() < 1e-14:
            r["status"] = DONE
    if r["status"] == GOING and r["rounds"] >= ROUNDS:
        r["status"] = UNFINISHED


def fit_glm(df: DataFrame, family: str, target: str, features: list[str], by: list[str] | None = None, weight: str | None = None, offset: str | None = None, penalty: float | str = 0.0, intercept: bool = True, pool: bool = False) -> DataFrame:
    """(by, status, rounds, loss, terms, coefs): for each group the most likely coefficients of a poisson or logit regression.

    loss is the weighted negative log-likelihood (less what depends on the target alone) with half the penalty times the squared
    coefficients, the intercept's left out; penalty may be a column of by. status is "ok", or "separated" where without a
    penalty no maximum exists (one outcome alone, or features that part the outcomes), with null coefficients, or "unfinished".
    Rows with a null or without a weight are left out; groups without rows are not there; a null in by is a group. Features that
    depend on each other share their coefficients in the shortest way.
    """
    by = list(by or [])
    rows = stored(design(df, target, features, by, weight, offset, pool))
    n = len(features)
    start = F.sum(F.col("_w") * F.exp(F.least("_o", F.lit(700.0)))) if family == "poisson" else F.sum("_w") - F.sum(F.col("_w") * F.col("_y"))
    own = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.col("_w") * F.col("_y")).alias("_s"), start.alias("_b"), F.array(*[F.lit(0.0)] * intercept, *[F.max(f"_x{i}") - F.min(f"_x{i}") for i in range(n)]).alias("ranges"))
    level = F.log(F.try_divide("_s", "_b")) if intercept else F.lit(0.0)
    one_outcome = F.lit(intercept) & ((F.col("_s") <= 0) | (F.col("_b") <= 0))
    zeros = lambda m: F.array(*[F.lit(0.0)] * m).cast("array<double>")
    fine = F.col(penalty).cast("double") if isinstance(penalty, str) else F.lit(float(penalty))
    none = F.lit(None).cast("array<double>")
    state = own.where("_n > 0").select(
        *by,
        F.when(one_outcome, SEPARATED).otherwise(GOING).alias("status"),
        F.lit(0).alias("rounds"),
        F.lit(None).cast("double").alias("loss"),
        fine.alias("penalty"),
        "ranges",
        none.alias("best"),
        none.alias("step"),
        F.concat(F.array(F.coalesce(level, F.lit(0.0))), zeros(n)).alias("trial") if intercept else zeros(n).alias("trial"),
    )
    schema = state.schema
    state = stored(state)
    x = _terms(n, intercept)
    eta = F.col("_o")
    for i, c in enumerate(x):
        eta = eta + F.get("trial", F.lit(i)) * c
    while not state.where(F.col("status") == GOING).isEmpty():
        here = _beside(rows, state.where(F.col("status") == GOING).select(*by, "trial"), by)
        here = here.withColumn("_eta", eta).withColumn("_mu", mean_of(family, F.col("_eta")))
        moments = here.groupBy(*by).agg(_moments(family, x).alias("m"))
        state = stored(_beside(state, moments, by, "left").mapInArrow(_advance(schema, intercept), schema))
    names = F.array(*[F.lit("intercept")] * intercept, *[F.lit(f) for f in features])
    coefs = F.when(F.col("status") != SEPARATED, F.col("best"))
    return state.select(*by, "status", "rounds", "loss", names.alias("terms"), coefs.alias("coefs"))


def coefficients(fit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, status, term, value): a row a coefficient."""
    pairs = F.arrays_zip("terms", F.coalesce("coefs", F.transform("terms", lambda _: F.lit(None).cast("double"))).alias("values"))
    return fit.select(*(by or []), "status", F.inline(pairs)).toDF(*(by or []), "status", "term", "value")


def with_mean(df: DataFrame, fit: DataFrame, family: str, features: list[str], by: list[str] | None = None, offset: str | None = None, intercept: bool = True, name: str = "mean") -> DataFrame:
    """df with the mean that its group's coefficients give; null where there are none."""
    eta = F.col(offset).cast("double") if offset else F.lit(0.0)
    for i, c in enumerate([*[F.lit(1.0)] * intercept, *[F.col(f).cast("double") for f in features]]):
        eta = eta + F.get("coefs", F.lit(i)) * c
    own = fit.select(*(by or []), "coefs")
    return _beside(df, own, list(by or []), "left").withColumn(name, mean_of(family, eta)).drop("coefs")


def _signed(gram: np.ndarray, right: np.ndarray, signs: list[int]) -> np.ndarray:
    """The least of b'Gb/2 - r'b with b_j at least 0, at most 0 or free: projected steps along the gradient, made faster by momentum."""
    free = np.array(signs)
    project = lambda b: np.where((free > 0) & (b < 0) | (free < 0) & (b > 0), 0.0, b)
    top = float(np.linalg.eigvalsh(gram)[-1]) or 1.0
    now = ahead = np.zeros(len(right))
    t = 1.0
    for _ in range(200_000):
        new = project(ahead - (gram @ ahead - right) / top)
        if float((ahead - new) @ (new - now)) > 0:
            ahead, t = now, 1.0  # momentum led uphill
            new = project(ahead - (gram @ ahead - right) / top)
        if np.abs(new - now).max() <= 1e-15 * (1 + np.abs(new).max()):
            return new
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, now, t = new + (t - 1) / u * (new - now), new, u
    return now


def fit_ridge(df: DataFrame, target: str, features: list[str], by: list[str] | None = None, penalty: float = 0.0, signs: dict[str, int] | None = None, weight: str | None = None) -> DataFrame:
    """(by, n, r2, terms, coefs, shares): ridge on standardised features and the centred target, with signs some may be held to.

    signs has 1 for a coefficient of at least 0 and -1 for one of at most 0. Coefficients are those of the features as they
    came, after an intercept; shares are their parts of the summed sizes. A feature of one value gets 0. One aggregation, and a
    system of as many equations as features in a task.
    """
    by, k = list(by or []), len(features)
    held = [(signs or {}).get(f, 0) for f in features]
    rows = design(df, target, features, by, weight, None, False)
    w, cols = F.col("_w"), [*[F.col(f"_x{i}") for i in range(k)], F.col("_y")]
    # products of differences from the group's mean, so that no digits are lost to a large mean
    means = rows.groupBy(*by).agg(F.array(*[F.sum(w * c) / F.sum(w) for c in cols]).alias("_mean"))
    near = _beside(rows, means, by)
    off = [c - F.get("_mean", F.lit(i)) for i, c in enumerate(cols)]
    sums = near.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("_total"), F.first("_mean").alias("_mean"), F.array(*[F.sum(w * a * b) for i, a in enumerate(off) for b in off[i:]]).alias("_m"))
    reals = ArrayType(DoubleType())
    schema = StructType([f for f in sums.schema.fields if f.name in [*by, "n"]]).add("r2", "double").add("coefs", reals).add("shares", reals)
    kind = to_arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.to_pylist()
            for r in out:
                full = np.zeros((k + 1, k + 1))
                full[np.triu_indices(k + 1)] = r.pop("_m")
                full = full + np.triu(full, 1).T
                mean, total = np.array(r.pop("_mean")), r.pop("_total")
                sd = np.sqrt(np.diag(full)[:k] / total)
                flat = sd <= 1e-12 * (1 + np.abs(mean[:k]))
                sd[flat] = 1.0
                gram = full[:k, :k] / np.outer(sd, sd)
                right = np.where(flat, 0.0, full[:k, k] / sd)
                gram[flat, :] = gram[:, flat] = 0.0
                fined = gram + penalty * np.eye(k)
                std = _signed(fined, right, held) if any(held) else np.linalg.lstsq(fined, right, rcond=1e-12)[0]
                spread = full[k, k]
                r["r2"] = float(1 - (spread - 2 * right @ std + std @ gram @ std) / spread) if spread > 0 else None
                coef = std / sd
                size = np.abs(coef).sum()
                r["coefs"] = [float(mean[k] - coef @ mean[:k]), *coef.tolist()]
                r["shares"] = (np.abs(coef) / size).tolist() if size > 0 else [0.0] * k
            yield pa.RecordBatch.from_pylist(out, kind)

    terms = F.array(F.lit("intercept"), *[F.lit(f) for f in features])
    return sums.where("n > 0").mapInArrow(solve, schema).select(*by, "n", "r2", terms.alias("terms"), "coefs", "shares")
