"""Window rates by model choice: zero-truncated Poisson mixtures and the zero-truncated negative binomial.

A window comes as its distinct counts and how often each occurs.  Windows are fitted in batches: one padded matrix of values and
multiplicities, a row a window, on which expectation maximisation and Newton steps work for all windows at once; a window that has converged is left alone.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagforge.session import ship

KEY = ["sample", "genome_id", "enzyme", "contig_id", "chunk"]
#: Windows of one batch, and cells that its largest matrix has at most unless one window has more.
BATCH, CELLS = 1024, 1 << 21
# Most parts, positives that a part needs, rounds and tolerance of the maximisation, least weight, bounds of the negative binomial.
PARTS, POSITIVES_PER_PART = 3, 10
ROUNDS, TOLERANCE, TINY = 200, 1e-7, 1e-12
MU_BOUNDS, ALPHA_BOUNDS = (1e-6, 1e6), (1e-8, 1e3)
#: How many times less mass on positive counts than was seen discredits a negative binomial.
MISMATCH = 10.0


def truncated_rate(mean):
    """Poisson rates of zero-truncated means; 0 for a mean of 1 or less."""
    m = np.atleast_1d(np.asarray(mean, float))
    some = m > 1
    x = np.where(m > 2, m, 2 * (m - 1))[some]
    goal = m[some]
    for _ in range(50):
        e, q = np.exp(-x), -np.expm1(-x)
        x = np.maximum(x - (x / q - goal) / ((q - x * e) / (q * q)), TINY)
    out = np.zeros(m.shape)
    out[some] = x
    return out if np.ndim(mean) else float(out[0])


class Histograms:
    """Distinct positive counts of windows, ascending, padded with value 1 and multiplicity 0."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.v, self.n = values, counts
        self.total, self.sum = counts.sum(1), (values * counts).sum(1)
        self.log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(values.max(initial=1)) + 1)))))[values.astype(np.int64)]

    @classmethod
    def of(cls, values: list, counts: list) -> Histograms:
        width = max([len(v) for v in values], default=0)
        v, n = np.ones((len(values), width)), np.zeros((len(values), width))
        for i, (a, b) in enumerate(zip(values, counts, strict=True)):
            v[i, : len(a)], n[i, : len(a)] = a, b
        return cls(v, n)

    def __getitem__(self, rows) -> Histograms:
        return Histograms(self.v[rows], self.n[rows])

    def quantiles(self, shares: np.ndarray) -> np.ndarray:
        """Linearly interpolated quantiles of every window, a column a share."""
        upto = self.n.cumsum(1)
        place = (self.total - 1)[:, None] * shares
        low = np.floor(place)
        at = lambda rank: np.take_along_axis(self.v, (upto[:, None, :] > rank[:, :, None]).argmax(2), 1)
        first = at(low)
        return first + (place - low) * (at(np.minimum(low + 1, (self.total - 1)[:, None])) - first)


def _log_parts(h: Histograms, weights: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Log of weight times truncated Poisson probability: windows by parts by values."""
    r = np.maximum(rates, 1e-300)[:, :, None]
    with np.errstate(divide="ignore"):
        logs = h.v[:, None, :] * np.log(r) - r - h.log_factorial[:, None, :] - np.log(-np.expm1(-r))
    at_one = np.where(h.v == 1, 0.0, -np.inf)[:, None, :]
    return np.log(np.maximum(weights, TINY))[:, :, None] + np.where(rates[:, :, None] < 1e-8, at_one, logs)


def _shares(h: Histograms, weights, rates):
    """Log-likelihood of each window, and the part of each value that each component answers for."""
    logs = _log_parts(h, weights, rates)
    top = logs.max(1, keepdims=True)
    norm = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
    return (h.n * norm[:, 0]).sum(1), np.exp(logs - norm) * h.n[:, None, :]


def fit_mixtures(h: Histograms, parts: int):
    """(weights, rates, masses, log-likelihood, bic) of mixtures of so many parts, a row a window, from spread quantiles."""
    if parts == 1:
        rates = truncated_rate(h.sum / h.total)[:, None]
        weights = np.ones((len(rates), 1))
        like = _shares(h, weights, rates)[0]
        return weights, rates, h.total[:, None].copy(), like, np.log(h.total) - 2 * like
    rates = np.sort(truncated_rate(np.maximum(h.quantiles(np.linspace(0.15, 0.85, parts)), 1 + 1e-6)), axis=1)
    weights, last = np.full(rates.shape, 1.0 / parts), np.full(len(rates), -np.inf)
    going = np.arange(len(rates))
    for _ in range(ROUNDS):
        some = h[going]
        like, share = _shares(some, weights[going], rates[going])
        more = ~(np.isfinite(last[going]) & (np.abs(like - last[going]) < TOLERANCE * np.maximum(1.0, np.abs(last[going]))))
        going, like, share, some = going[more], like[more], share[more], some[more]
        if not len(going):
            break
        last[going] = like
        mass = share.sum(2)
        w = np.maximum(mass / some.total[:, None], TINY)
        weights[going] = w / w.sum(1, keepdims=True)
        mean = (share * some.v[:, None, :]).sum(2) / np.maximum(mass, 1e-300)
        rates[going] = np.where(mass > TINY, truncated_rate(mean), rates[going])
    like, share = _shares(h, weights, rates)
    return weights, rates, share.sum(2), like, (2 * parts - 1) * np.log(h.total) - 2 * like


class _Tails:
    """Sums over counts k of sums over i < k, as sums over i of the number of counts above i."""

    def __init__(self, h: Histograms):
        self.i = np.arange(max(int((h.v * (h.n > 0)).max(initial=0)), 1), dtype=float)
        above = np.zeros((len(h.v), len(self.i) + 1))
        row, at = np.nonzero(h.n)
        np.add.at(above, (row, h.v[row, at].astype(int) - 1), h.n[row, at])
        self.above = above[:, ::-1].cumsum(1)[:, ::-1][:, :-1]
        self.constant = (h.n * h.log_factorial).sum(1)


def _ztnb(h: Histograms, tails: _Tails, at: np.ndarray):
    """Log-likelihood, gradient and Hessian of the truncated negative binomial by log mean and log dispersion, a row a window."""
    mu, alpha = np.exp(at[:, 0]), np.exp(at[:, 1])
    t = alpha * mu
    line, odds = np.log1p(t), t / (1 + t)
    z = -line / alpha
    seen = np.maximum(-np.expm1(z), 1e-300)
    steps = alpha[:, None] * tails.i
    like = (tails.above * np.log1p(steps)).sum(1) - tails.constant + h.sum * (at[:, 0] - line) + h.total * (z - np.log(seen))
    zm, za = -mu / (1 + t), (line - odds) / alpha
    zmm, zma, zaa = -mu / (1 + t) ** 2, mu * t / (1 + t) ** 2, odds**2 / alpha - za
    bend = np.exp(z) / seen**2
    gradient = np.stack([h.sum / (1 + t) + h.total * zm / seen, (tails.above * (steps / (1 + steps))).sum(1) - h.sum * odds + h.total * za / seen], 1)
    drop = h.sum * t / (1 + t) ** 2
    hmm, hma = -drop + h.total * (bend * zm * zm + zmm / seen), -drop + h.total * (bend * zm * za + zma / seen)
    haa = (tails.above * (steps / (1 + steps) ** 2)).sum(1) - drop + h.total * (bend * za * za + zaa / seen)
    return like, gradient, np.stack([np.stack([hmm, hma], 1), np.stack([hma, haa], 1)], 1)


def fit_ztnbs(h: Histograms, rounds: int = 200):
    """(mu, alpha, log-likelihood), a row a window, by damped Newton steps in log space within the bounds.

    A coordinate at a bound that its gradient pushes against stands still; a step that doesn't raise the likelihood is tried again with more damping.
    """
    mean = h.sum / h.total
    var = np.where(h.total > 1, (h.n * (h.v - mean[:, None]) ** 2).sum(1) / np.maximum(h.total - 1, 1), mean)
    low, high = np.log([MU_BOUNDS[0], ALPHA_BOUNDS[0]]), np.log([MU_BOUNDS[1], ALPHA_BOUNDS[1]])
    at = np.stack([np.log(np.maximum(mean, 1e-3)), np.log(np.clip((var - mean) / np.maximum(mean * mean, TINY), 1e-3, 10.0))], 1)
    tails, damping = _Tails(h), np.full(len(at), 1e-3)
    like, gradient, hessian = _ztnb(h, tails, at)
    going = np.ones(len(at), bool)
    for _ in range(rounds):
        held = ((at <= low) & (gradient < 0)) | ((at >= high) & (gradient > 0))
        free = np.where(held, 0.0, gradient)
        going &= (np.abs(free) > 1e-9 * (1 + np.abs(like))[:, None]).any(1) & (damping < 1e12)
        if not going.any():
            break
        curve = -hessian * ~held[:, :, None] * ~held[:, None, :]
        middle, spread = (curve[:, 0, 0] + curve[:, 1, 1]) / 2, np.hypot((curve[:, 0, 0] - curve[:, 1, 1]) / 2, curve[:, 0, 1])
        shift = np.maximum(0.0, spread - middle) + damping * (np.abs(middle) + spread + 1e-12)
        a, b, c = curve[:, 0, 0] + shift, curve[:, 0, 1], curve[:, 1, 1] + shift
        det = a * c - b * b
        step = np.stack([(c * free[:, 0] - b * free[:, 1]) / det, (a * free[:, 1] - b * free[:, 0]) / det], 1)
        new = np.clip(at + np.clip(step, -3, 3) * going[:, None], low, high)
        got = _ztnb(h, tails, new)
        better = going & (got[0] > like)
        at[better], like[better], gradient[better], hessian[better] = new[better], got[0][better], got[1][better], got[2][better]
        damping = np.where(better, np.maximum(damping / 10, 1e-12), np.where(going, damping * 10, damping))
    return np.exp(at[:, 0]), np.exp(at[:, 1]), like


def _seen(mu, alpha):
    return -np.expm1(-np.log1p(alpha * mu) / alpha)


def choose_all(h: Histograms, anchors: np.ndarray, model: str = "auto") -> dict[str, np.ndarray]:
    """Each window's rate, its standard error by the delta method, model, BIC and number of parts; NaN for none.

    Mixtures have up to three parts (one per ten positives and no more than distinct values); their rate is that of the heaviest part, with the mass
    it is responsible for as sample size.  The negative binomial takes part from ten positives on and wins by BIC, but not when it
    puts ten times less mass on positive counts than were seen: then the mixture stands, or, where it was asked for alone, no rate.
    """
    m = len(anchors)
    out = {"rate": np.full(m, np.nan), "se": np.full(m, np.nan), "model": np.full(m, "empty", object), "bic": np.full(m, np.inf), "n_components": np.zeros(m, int)}
    some = np.flatnonzero(h.total > 0)
    mass = np.zeros(m)
    if model in ("auto", "ztp"):
        most = np.maximum(1, np.minimum(np.minimum(PARTS, h.total // POSITIVES_PER_PART), (h.n > 0).sum(1)))
        for parts in range(1, PARTS + 1):
            rows = some[most[some] >= parts]
            if not len(rows):
                continue
            weights, rates, masses, _, bic = fit_mixtures(h[rows], parts)
            better = bic < out["bic"][rows]
            rows, top = rows[better], weights[better].argmax(1)[:, None]
            out["bic"][rows], out["n_components"][rows], out["model"][rows] = bic[better], parts, "ztp"
            out["rate"][rows], mass[rows] = np.take_along_axis(rates[better], top, 1)[:, 0], np.take_along_axis(masses[better], top, 1)[:, 0]
        x = out["rate"]
        with np.errstate(all="ignore"):
            q = -np.expm1(-x)
            mean = x / q
            se = np.sqrt(np.maximum(mean * (1 + x - mean), TINY) / mass) / np.maximum((q - x * np.exp(-x)) / (q * q), TINY)
        fine = (x > 1e-8) & (mass > 0)
        out["se"], out["rate"] = np.where(fine, se, np.nan), np.where(fine, x, np.nan)
    rows = some if model == "ztnb" else some[h.total[some] >= POSITIVES_PER_PART] if model == "auto" else some[:0]
    if len(rows):
        mu, alpha, like = fit_ztnbs(h[rows])
        n = h.total[rows]
        bic = 2 * np.log(n) - 2 * like
        seen = _seen(mu, alpha)
        possible = seen * MISMATCH >= n / anchors[rows]
        mean_of = lambda x: x / _seen(x, alpha)
        step = np.maximum(mu * 1e-5, 1e-8)
        slope = (mean_of(mu + step) - mean_of(np.maximum(mu - step, TINY))) / (2 * step)
        var = np.maximum(mu * (1 + mu * (1 + alpha)) / seen - mean_of(mu) ** 2, TINY)
        wins = bic < out["bic"][rows]
        taken = wins & possible
        at = rows[taken]
        out["rate"][at], out["se"][at] = mu[taken], (np.sqrt(var / n) / np.maximum(np.abs(slope), TINY))[taken]
        named = rows[wins & (possible | (out["model"][rows] == "empty"))]
        out["model"][named], out["n_components"][named], out["bic"][named] = "ztnb", 1, bic[wins & (possible | (out["model"][rows] == "empty"))]
    out["bic"] = np.where(np.isfinite(out["bic"]), out["bic"], np.nan)
    return out


def choose(count: np.ndarray, model: str = "auto") -> dict:
    """:func:`choose_all` of one window of counts."""
    values, counts = np.unique(count[count >= 1].astype(float), return_counts=True)
    got = choose_all(Histograms.of([values], [counts]), np.array([len(count)]), model)
    plain = {k: None if isinstance(v[0], float) and np.isnan(v[0]) else v[0] for k, v in got.items()}
    return {"n_anchors": len(count), "n_positive": int(counts.sum())} | plain


def _fitted(model: str, batches):
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, BATCH)
            widest = max((max(v, default=1) for v in part.column("values").to_pylist()), default=1)
            part = part.slice(0, max(1, CELLS // int(widest)))
            start += part.num_rows
            h = Histograms.of(part.column("values").to_pylist(), part.column("counts").to_pylist())
            got = choose_all(h, part.column("n_anchors").to_numpy(), model)
            floats = {k: pa.array(got[k], pa.float64(), from_pandas=True) for k in ("rate", "se", "bic")}
            columns = [*[part.column(k) for k in (*KEY, "n_anchors")], pa.array(h.total.astype(np.int64)), floats["rate"], floats["se"], pa.array(got["model"], pa.string()), floats["bic"], pa.array(got["n_components"], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "n_anchors", "n_positive", "rate", "se", "model", "bic", "n_components"])


def model_rates(windowed: DataFrame, model: str = "auto") -> DataFrame:
    """One row per enzyme window with the chosen model's rate.

    Counts are summed to (value, multiplicity) pairs of each window by Spark, and windows dealt to tasks by their key.
    """
    ship(windowed.sparkSession)
    pairs = windowed.select(*KEY, F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("v")).groupBy(*KEY, "v").agg(F.count("*").alias("n"))
    held = F.array_sort(F.collect_list(F.when(F.col("v") >= 1, F.struct("v", "n"))))
    one = pairs.groupBy(*KEY).agg(F.sum("n").alias("n_anchors"), held.alias("h")).select(*KEY, "n_anchors", F.col("h.v").alias("values"), F.col("h.n").alias("counts"))
    kinds = {f.name: f.dataType.simpleString() for f in one.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in (*KEY, "n_anchors"))
    return one.mapInArrow(partial(_fitted, model), head + ", n_positive bigint, rate double, se double, model string, bic double, n_components int")
