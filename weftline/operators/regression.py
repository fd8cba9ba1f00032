"""Cost models: linear regression without intercept over a few predictors.

Sums of products are one aggregation over the rows; only they come to the driver, so that the
fit takes any number of rows. The robust fit draws minimal subsets from a bounded sample; its
scale, the loss of each hypothesis and each reweighting step are aggregations over all rows.
"""

from __future__ import annotations

import itertools
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import drawing


def products(rows: DataFrame, x: list[str], y: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'WX, X'Wy and the number of rows with a positive weight, from one pass."""
    w = F.lit(1.0) if weight is None else weight
    names = [*x, y]
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(names) if j >= i]
    got = rows.agg(F.sum((w > 0).cast("long")).alias("n"), *sums).first()
    k = len(x)
    a, b = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = got[f"s{i}_{j}"] or 0.0
        b[i] = got[f"s{i}_{k}"] or 0.0
    return a, b, got.n or 0


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution by elimination; an unknown whose column has nothing left to pivot on gets 0."""
    n = len(b)
    m = np.column_stack([a, b]).astype(float)
    for c in range(n):
        r = c + int(np.argmax(np.abs(m[c:, c])))
        if abs(m[r, c]) < 1e-15:
            m[c:, c] = 0
            continue
        m[[c, r]] = m[[r, c]]
        m[c + 1 :] -= np.outer(m[c + 1 :, c] / m[c, c], m[c])
    out = np.zeros(n)
    for c in range(n - 1, -1, -1):
        if abs(m[c, c]) >= 1e-15:
            out[c] = (m[c, n] - m[c, c + 1 : n] @ out[c + 1 :]) / m[c, c]
    return out


def prediction(x: list[str], c) -> Column:
    return sum((F.col(n) * float(v) for n, v in zip(x, c)), F.lit(0.0))


def r_squared(rows: DataFrame, x: list[str], y: str, c) -> float:
    """1 - SSE / sum of y squared, as the model has no intercept; 1 if all y are 0, 0 without rows."""
    got = rows.agg(F.sum(F.pow(F.col(y) - prediction(x, c), F.lit(2))).alias("e"), F.sum(F.col(y) * F.col(y)).alias("t"), F.count("*").alias("n")).first()
    if not got.n:
        return 0.0
    return 1 - got.e / got.t if got.t else 1.0


def ordinary(rows: DataFrame, x: list[str], y: str) -> dict | None:
    """coefficients and r_squared of least squares; None with fewer rows than predictors and one."""
    a, b, n = products(rows, x, y)
    if n < len(x) + 1:
        return None
    c = solve(a, b)
    return {"coefficients": c.tolist(), "r_squared": r_squared(rows, x, y, c)}


# The 0.99 quantile of the chi distribution with one degree of freedom, Euler's constant, the seed of the draws.
K = 2.5758293035489004
EULER = 0.5772156649015329
SEED = 0x6D61677361632B2B
MASK = (1 << 64) - 1
PART_ROWS = 1000


def e1(x: np.ndarray) -> np.ndarray:
    """The exponential integral: its power series up to 1, beyond that its asymptotic series up to the smallest term."""
    x = np.asarray(x, float)
    small, term, total = np.minimum(x, 1.0), np.ones_like(x), np.zeros_like(x)
    for k in range(1, 61):
        term = term * -small / k
        before, total = total, total + term / k
        if (total == before).all():  # terms only get smaller
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        near = -np.log(small) - EULER - total
    large, term, total, live = np.maximum(x, 1.0), np.ones_like(x), np.ones_like(x), np.ones(x.shape, bool)
    last = np.full(x.shape, np.inf)
    for k in range(1, 61):
        term = term * -k / large
        live &= np.abs(term) <= last
        if not live.any():
            break
        total, last = np.where(live, total + term, total), np.abs(term)
    return np.where(x <= 0, np.inf, np.where(x <= 1, near, np.exp(-large) * total / large))


def losses_and_weights(r: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """For absolute residuals: the loss, and the weight, each summed over all noise scales up to sigma."""
    near, unit = r < K * sigma, 1 / math.sqrt(2 * math.pi) / sigma
    x = r * r / (2 * sigma * sigma)
    tail = e1(np.float64(K * K / 2))
    over = lambda v: np.maximum(e1(np.minimum(v, K * K / 2 * (1 + 1e-9))) - tail, 0)  # beyond that nothing is near
    loss = (sigma * sigma * (1 - np.exp(-x)) + r * r / 2 * over(np.maximum(x, 1e-12))) * unit
    weight = over(np.maximum(r * r, 1e-12) / (2 * sigma * sigma)) * unit
    return np.where(near, loss, sigma * sigma * unit * (1 - math.exp(-K * K / 2))), np.where(near & (r > 0), weight, 0.0)


def shifted(state: int) -> int:
    """The next state of a 64-bit xorshift generator."""
    state ^= state << 13 & MASK
    state ^= state >> 7
    return state ^ (state << 17 & MASK)


def subsets(n: int, k: int, draws: int) -> tuple[list, bool]:
    """Row numbers of minimal subsets, and whether they are all there are: seeded draws without repetition if there are more than `draws`."""
    if math.comb(n, k) <= draws:
        return list(itertools.combinations(range(n), k)), True
    state, out = (SEED ^ (n * 0x9E3779B97F4A7C15 & MASK)) or 0xDEADBEEFCAFEF00D, []
    for _ in range(draws):
        moved, picked = {}, []
        for i in range(k):
            j = i
            if n - i > 1:
                state = shifted(state)
                j = i + state % (n - i)
            picked.append(moved.get(j, j))
            moved[j] = moved.get(i, i)
        out.append(picked)
    return out, False


def enough(inliers: int, n: int, k: int, confidence: float) -> float:
    """Draws after which a subset of inliers has come with that confidence; infinite where the share of inliers says nothing."""
    share = inliers / n
    if not 0 < share < 1:
        return math.inf
    missed = math.log1p(-(share**k)) if share**k < 1 else -math.inf
    return math.ceil(math.log(1 - confidence) / missed) if missed < 0 else math.inf


def robust(rows: DataFrame, x: list[str], y: str, sample_rows: int = 2000, draws: int = 2000, least: int = 50, steps: int = 2, confidence: float = 0.99) -> dict | None:
    """coefficients, r_squared over the inliers, inlier_threshold, score, inliers, sigma; None with too few rows.

    MAGSAC++: a residual counts by its likelihood summed over all noise scales up to a largest one, so
    that no inlier threshold has to be given. The largest scale is the 0.9 order statistic of the
    residuals of least squares over all rows. Hypotheses are exact fits of minimal subsets: all of
    them if there are few, else seeded draws from sample_rows rows (a documented bound), until enough were
    drawn. Each is refined by reweighting, and the score of each is over all rows.
    """
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in [*x, y]]).persist()
    try:
        return _robust(rows, x, y, sample_rows, draws, least, steps, confidence)
    finally:
        rows.unpersist()


def _robust(rows: DataFrame, x: list[str], y: str, sample_rows: int, draws: int, least: int, steps: int, confidence: float) -> dict | None:
    k = len(x)
    pa_, pb, n = products(rows, x, y)
    if n < k + 1:
        return None
    start = solve(pa_, pb)
    sigma = max(1e-6, nth(rows.select(F.abs(F.col(y) - prediction(x, start)).alias("v")), math.floor(0.9 * (n - 1) + 0.5)))
    fits, every = [start], True
    flat = rows.agg(*[F.max(F.abs(F.col(c))).alias(f"m{i}") for i, c in enumerate(x)]).first()
    if min(flat) >= 1e-15:
        drawn = np.array([list(r) for r in rows.orderBy(F.xxhash64(*x, y), *x, y).limit(sample_rows).collect()], float)
        picked, every = subsets(len(drawn), k, draws)
        fits += [solve(drawn[list(s), :k], drawn[list(s), k]) for s in picked]
    else:
        steps = 0  # a predictor without values: least squares as it is
    dealt = rows.repartition(-(-n // PART_ROWS))  # a part costs a row for each fit, however few rows it has
    now = np.array(fits)
    best, sums = now.copy(), _summed(dealt, now, sigma)
    score, inliers = 1 / np.maximum(sums[:, 0], 1e-300) * (sums[:, 0] > 0), sums[:, 1].copy()
    live = np.ones(len(now), bool)
    for _ in range(steps):
        live &= sums[:, 2] >= k
        now = np.array([solve(s[3 : 3 + k * k].reshape(k, k), s[3 + k * k :]) if ok else c for s, c, ok in zip(sums, now, live)])
        sums = _summed(dealt, now, sigma)
        better = live & (sums[:, 0] > 0) & (1 / np.maximum(sums[:, 0], 1e-300) > score)
        best[better], score[better], inliers[better] = now[better], 1 / sums[better, 0], sums[better, 1]
    top, limit = 0, len(fits) - 1
    for i in range(1, len(fits)):
        if i > limit:
            break
        if score[i] > score[top]:
            top = i
        if not every and i >= least:
            limit = min(limit, enough(int(inliers[top]), n, k, confidence))
    c = best[top]
    close = rows.filter(F.abs(F.col(y) - prediction(x, c)) <= K * sigma)
    return {"coefficients": c.tolist(), "r_squared": r_squared(close, x, y, c), "inlier_threshold": K * sigma, "score": float(score[top]), "inliers": int(inliers[top]), "sigma": sigma}


def nth(values: DataFrame, i: int, bins: int = 1024) -> float:
    """The value of v at i in order, from 0: counts by bins between the least and the largest, then within the bin that holds it."""
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    while lo < hi and math.isfinite(hi - lo):
        at = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1))
        for r in values.filter(F.col("v").between(lo, hi)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("at").collect():
            if i < r.n:
                lo, hi = r.lo, r.hi
                break
            i -= r.n
    return lo


def _summed(rows: DataFrame, fits: np.ndarray, sigma: float) -> np.ndarray:
    """A row for each fit: loss, inliers, rows with a weight, X'WX, X'Wy, summed over all rows; bounded by the number of fits."""
    k = fits.shape[1]
    names = [f"v{j}" for j in range(3 + k * k + k)]
    part = rows.mapInArrow(partial(_part_sums, fits=fits, sigma=sigma), "i int, " + ", ".join(f"{v} double" for v in names))
    got = part.groupBy("i").agg(*[F.sum(v).alias(v) for v in names]).orderBy("i").collect()
    return np.array([r[1:] for r in got], float)


def _part_sums(batches, fits: np.ndarray, sigma: float, block: int = 256):
    """What a part adds to _summed; columns: the predictors, then the response."""
    k = fits.shape[1]
    out = np.zeros((len(fits), 3 + k * k + k))
    for batch in batches:
        m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        x, y = m[:, :k], m[:, k]
        squares = np.column_stack([(x[:, :, None] * x[:, None, :]).reshape(len(m), -1), x * y[:, None]])
        for lo in range(0, len(fits), block):
            r = np.abs(y[:, None] - x @ fits[lo : lo + block].T)
            loss, weight = losses_and_weights(r, sigma)
            out[lo : lo + block, 0] += loss.sum(axis=0)
            out[lo : lo + block, 1] += (r < K * sigma).sum(axis=0)
            out[lo : lo + block, 2] += (weight > 0).sum(axis=0)
            out[lo : lo + block, 3:] += weight.T @ squares
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits)), pa.int32())] + [pa.array(c) for c in out.T], ["i"] + [f"v{j}" for j in range(out.shape[1])])


def fitting_rows(predictors: DataFrame, libraries_only: bool) -> DataFrame:
    """The targets that a model is fitted on: those with wall time, of libraries only if asked. predictors: target_id, wall_ns and others."""
    out = predictors.filter("wall_ns > 0")
    return out.filter(F.endswith("target_id", F.lit("/lib"))) if libraries_only else out


def target_costs(predictors: DataFrame, x: list[str], model: list[float] | None) -> DataFrame:
    """target_id, cost_ms: what the model predicts; without one the wall time, and the attributed time (first of x) of targets that have none. Milliseconds."""
    if model is not None:
        return predictors.select("target_id", prediction(x, model).alias("cost_ms"))
    return predictors.select("target_id", F.when(F.col("wall_ms") > 0, F.col("wall_ms")).otherwise(F.col(x[0])).alias("cost_ms"))


def validation(rows: DataFrame, threshold: float) -> DataFrame:
    """abs_error, target_id, line: the lines of the validation table; the worst prediction comes first when sorted by abs_error. rows: target_id, wall_ms, predicted; only those with wall time count."""
    text = lambda c: F.lpad(c, 9, " ")
    delta = F.col("predicted") - F.col("wall_ms")
    name = F.rpad(drawing.shortened(F.col("target_id"), 35), 35, " ")
    mark = F.when(F.abs(delta) > threshold, F.lit("  *")).otherwise(F.lit("   "))
    line = F.concat_ws(" ", name, *[text(drawing.long_duration(c)) for c in (F.col("wall_ms"), F.col("predicted"), delta)], mark)
    return rows.filter("wall_ms > 0").select(F.abs(delta).alias("abs_error"), "target_id", line.alias("line"))


def ranked(rows: DataFrame, actual: Column, predicted: Column, threshold: float) -> DataFrame:
    """rows with predicted, abs_error and outlier (abs_error over the threshold)."""
    return rows.withColumn("predicted", predicted).withColumn("abs_error", F.abs(actual - F.col("predicted"))).withColumn("outlier", F.col("abs_error") > threshold)
