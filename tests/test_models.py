from __future__ import annotations

import math

import numpy as np
import pytest

from tagforge.functions.stats import chi2_sf, normal_sf, t_two_sided
from tagforge.operators import fit, fusion, report, windows
from tagforge.operators.gcbias import fit_curves, lowess, offsets
from tagforge.operators.mixture import Histograms, _Tails, _ztnb, choose, choose_all, fit_mixtures, fit_ztnbs, truncated_rate
from tagforge.operators.simulate import anchors, binned, counts, estimate, route_a, route_b
from tagforge.operators.vfit import fit_sorted, fit_v, fit_windows


def test_tails_against_tables():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)


def test_truncated_rate_inverts_the_mean():
    for lam in (0.05, 0.7, 3.0, 40.0):
        assert truncated_rate(lam / -math.expm1(-lam)) == pytest.approx(lam, rel=1e-6)
    assert truncated_rate(1.0) == 0.0


def histograms(*samples):
    pairs = [np.unique(s[s > 0].astype(float), return_counts=True) for s in samples]
    return Histograms.of([p[0] for p in pairs], [p[1] for p in pairs])


def one_by_one(counts, parts):
    """Expectation maximisation of a single sample, value by value."""
    counts = np.sort(counts[counts > 0].astype(float))
    rates = sorted(truncated_rate(max(s, 1 + 1e-6)) for s in np.quantile(counts, np.linspace(0.15, 0.85, parts)))
    weights, last = [1 / parts] * parts, -math.inf

    def shares():
        like, out = 0.0, []
        for k in counts:
            p = [w * ((k == 1) if r < 1e-8 else math.exp(k * math.log(r) - r - math.lgamma(k + 1)) / -math.expm1(-r)) for w, r in zip(weights, rates, strict=True)]
            like += math.log(sum(p))
            out.append([x / sum(p) for x in p])
        return like, np.array(out)

    for _ in range(200):
        like, share = shares()
        if math.isfinite(last) and abs(like - last) < 1e-7 * max(1, abs(last)):
            break
        last, mass = like, share.sum(0)
        weights = np.maximum(mass / len(counts), 1e-12) / np.maximum(mass / len(counts), 1e-12).sum()
        rates = [truncated_rate(float((s * counts).sum() / m)) if m > 1e-12 else r for s, m, r in zip(share.T, mass, rates, strict=True)]
    return weights, rates, shares()[0]


def test_batches_equal_single_samples():
    rng = np.random.default_rng(8)
    samples = [rng.poisson(m, n) for m, n in ((0.5, 60), (3, 80), (20, 50), (6, 35))] + [np.concatenate([rng.poisson(2, 40), rng.poisson(15, 40)]), np.ones(30, int)]
    for parts in (2, 3):
        weights, rates, masses, like, bic = fit_mixtures(histograms(*samples), parts)
        for i, s in enumerate(samples):
            w, r, top = one_by_one(s, parts)
            assert like[i] == pytest.approx(top, rel=1e-9, abs=1e-9) and masses[i].sum() == pytest.approx((s > 0).sum())
            assert weights[i] == pytest.approx(list(w), abs=1e-6) and rates[i] == pytest.approx(list(r), abs=1e-5)
            assert bic[i] == pytest.approx((2 * parts - 1) * math.log((s > 0).sum()) - 2 * top, abs=1e-6)
    together = choose_all(histograms(*samples), np.array([len(s) for s in samples]))
    for i, s in enumerate(samples):
        alone = choose(s)
        assert alone["model"] == together["model"][i] and (alone["rate"] is None and np.isnan(together["rate"][i]) or alone["rate"] == pytest.approx(together["rate"][i], rel=1e-9))


def test_negative_binomial_derivatives_and_optimum():
    rng = np.random.default_rng(9)
    samples = [rng.negative_binomial(2, 2 / (2 + m), 400) for m in (0.8, 3.0, 12.0)] + [rng.poisson(4.0, 500), np.array([1] * 300 + [2])]
    h = histograms(*samples)
    tails = _Tails(h)
    at = np.log([[1.5, 0.3], [2.0, 1.0], [9.0, 0.6], [4.0, 1e-4], [0.5, 2.0]])
    like, gradient, hessian = _ztnb(h, tails, at)
    for k in range(2):
        step = np.zeros(2)
        step[k] = 1e-5
        up, down = _ztnb(h, tails, at + step), _ztnb(h, tails, at - step)
        np.testing.assert_allclose(gradient[:, k], (up[0] - down[0]) / 2e-5, rtol=1e-5, atol=1e-4)
        np.testing.assert_allclose(hessian[:, k], (up[1] - down[1]) / 2e-5, rtol=1e-4, atol=1e-3)
    mu, alpha, best = fit_ztnbs(h)
    assert ((mu >= 1e-6 * 0.999) & (mu <= 1e6) & (alpha >= 1e-8 * 0.999) & (alpha <= 1e3 * 1.001)).all()
    for i in range(4):  # no better point on a fine grid around, nor on a coarse one of all that is allowed
        near = [(a, b) for a in np.log(mu[i]) + np.linspace(-0.05, 0.05, 21) for b in np.log(alpha[i]) + np.linspace(-0.05, 0.05, 21)]
        far = [(a, b) for a in np.linspace(-3, 5, 33) for b in np.linspace(-18, 6, 49)]
        for a, b in near + far:
            one = np.array([[a, min(max(b, math.log(1e-8)), math.log(1e3))]])
            assert _ztnb(h[i : i + 1], _Tails(h[i : i + 1]), one)[0][0] <= best[i] + 1e-6


def test_planted_rates_are_recovered():
    rng = np.random.default_rng(3)
    c = rng.poisson(4.0, 4000)
    assert choose(c, "ztp")["rate"] == pytest.approx(4.0, rel=0.1)
    mixed = np.concatenate([rng.poisson(2, 3000), rng.poisson(12, 3000)])
    assert sorted(fit_mixtures(histograms(mixed), 2)[1][0]) == pytest.approx([2, 12], rel=0.1)
    nb = rng.negative_binomial(2, 2 / (2 + 6.0), 6000)
    mu, alpha, _ = fit_ztnbs(histograms(nb))
    assert mu[0] == pytest.approx(6.0, rel=0.1) and alpha[0] == pytest.approx(0.5, rel=0.25)
    assert choose(np.zeros(5, int))["rate"] is None


def test_lowess_follows_a_line():
    x = np.linspace(0.3, 0.7, 60)
    assert np.allclose(lowess(x, 2 * x - 1, np.ones(60)), 2 * x - 1, atol=1e-6)


def test_gc_curve_is_robust_against_single_anchors(spark):
    rng = np.random.default_rng(2)
    gc = np.repeat(np.arange(20) / 40 + 0.25, 30)
    count = rng.poisson(20 * 2 ** (gc - 0.5))
    count[gc == gc[300]] = np.where(np.arange(30) < 8, 4000, count[gc == gc[300]])
    y, n = np.log2(count + 0.5), len(gc)
    trust, fit = np.ones(n), np.zeros(n)
    for _ in range(3):  # anchor by anchor
        for i in range(n):
            d = np.abs(gc - gc[i])
            w = trust * np.clip(1 - (d / np.sort(d)[int(0.4 * n) - 1]) ** 3, 0, None) ** 3
            fit[i] = np.polyval(np.polyfit(gc, y, 1, w=np.sqrt(w)), gc[i])
        r = np.abs(y - fit)
        trust = np.clip(1 - (r / (6 * np.median(r))) ** 2, 0, None) ** 2
    r2 = 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    shrink = min(max((r2 - 3 / n) / r2, 0), 1) if r2 > 0 else 0
    rows = [(1, float(g), int(c), True) for g, c in zip(gc, count, strict=True)]
    got = fit_curves(spark.createDataFrame(rows, "enzyme int, gc double, count bigint, usable boolean")).collect()
    want = {float(g): shrink * (f - fit.mean()) for g, f in zip(gc, fit, strict=True)}
    assert len(got) == 20 and all(r.r2 == pytest.approx(r2) and r.log2_offset == pytest.approx(want[r.gc], abs=1e-6) for r in got)
    x, c = gc[::30], np.unique(np.stack([gc, y]), axis=1, return_counts=True)
    line = dict(zip(c[0][0], lowess(c[0][0], c[0][1], c[1].astype(float)), strict=True))
    assert [line[g] for g in x] == pytest.approx(fit[::30].tolist(), abs=1e-6)


@pytest.mark.parametrize("truth", [0.5, 1.0, 2.0])
def test_v_fit_recovers_a_planted_gradient(truth):
    length, ori = 4_600_000.0, 3_923_883.0
    x = np.arange(180) * length / 180
    d = np.minimum((x - ori) % length, (ori - x) % length)
    y = 3 - truth * d / (length / 2) + np.random.default_rng(1).normal(0, 0.02, 180)
    fit = fit_v(x, y, np.full(180, 0.02), length)
    assert abs(fit["log2_ptr"] - truth) < 0.05
    assert min(abs(fit["ori"] - ori), length - abs(fit["ori"] - ori)) < 2 * length / 180
    assert fit_v(x, y, np.full(180, 0.02), length, ori=ori)["r2"] > 0.9


def profile(ori, length, n, make, seed=1, noise=0.02):
    x = np.arange(n) * length / n
    d = np.minimum((x - ori) % length, (ori - x) % length) / (length / 2)
    return x, make(d) + np.random.default_rng(seed).normal(0, noise, n)


def test_v_fit_finds_a_kink_and_refuses_one_that_rises():
    length, ori = 4_000_000.0, 1_000_000.0
    x, y = profile(ori, length, 200, lambda d: -3.5 * np.minimum(d, 0.4) - 0.4 * np.maximum(d - 0.4, 0))
    fit = fit_v(x, y, np.full(200, 0.02), length)
    assert fit["method"] == "v_shape_segmented" and fit["kink"] == 0.4 * length / 2 and fit["log2_ptr"] == pytest.approx(1.64, abs=0.03) and abs(fit["ori"] - ori) < length / 100
    x, y = profile(ori, length, 200, lambda d: -4.5 * np.minimum(d, 0.55) + 2.0 * np.maximum(d - 0.55, 0))
    searched, known = fit_v(x, y, np.full(200, 0.02), length), fit_v(x, y, np.full(200, 0.02), length, ori=ori)
    assert searched["kink"] != 0.55 * length / 2
    assert known["method"] == "v_shape_segmented" and known["log2_ptr"] == pytest.approx(1.575, abs=0.03)
    few = fit_v(x[::10], y[::10], np.full(20, 0.02), length, ori=ori)
    assert few["method"] == "v_shape" and not few["segmented"]


def test_searched_slopes_never_rise(monkeypatch):
    from tagforge.operators import vfit

    seen = []
    real = vfit.Lines

    class Seen(real):
        def __init__(self, *a):
            super().__init__(*a)
            seen.append(self)

    monkeypatch.setattr(vfit, "Lines", Seen)
    length = 4_000_000.0
    for seed in range(5):
        x, y = profile(5e5 * seed, length, 120, lambda d: -4 * np.minimum(d, 0.4) + seed * np.maximum(d - 0.4, 0), seed, 0.2)
        seen.clear()
        fit = fit_v(x, y, np.full(120, 0.2), length)
        chosen = [f.coef[i] for f in seen for i in range(len(f.coef)) if f.log2_ptr[i] == fit["log2_ptr"]]
        assert fit["ok"] and chosen and all((c[1:] <= 0).all() for c in chosen)


def test_a_search_holds_some_origins_at_a_time(monkeypatch):
    """Memory of a search doesn't grow as origins times windows, and its fit is that of all origins at once."""
    import tracemalloc

    from tagforge.operators import vfit

    length = 1_000_000.0
    x, y = profile(3e5, length, 20_000, lambda d: -3 * np.minimum(d, 0.4) - 0.5 * np.maximum(d - 0.4, 0), 8, 0.2)
    se = np.linspace(0.1, 0.3, 20_000)
    tracemalloc.start()
    some = fit_v(x, y, se, length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    monkeypatch.setattr(vfit, "CELLS", 1 << 40)
    whole = fit_v(x, y, se, length)
    assert some["segmented"] and {k: v for k, v in some.items() if not isinstance(v, float)} == {k: v for k, v in whole.items() if not isinstance(v, float)}
    assert all(v == pytest.approx(whole[k], rel=1e-9) for k, v in some.items() if isinstance(v, float))


def test_r2_is_unweighted_and_falls_below_zero():
    x, y = profile(0, 1000.0, 6, lambda d: 0 * d, 3, 1.0)
    fit = fit_v(x, y, np.array([1e-3, 1e-3, 5, 5, 5, 5.0]), 1000.0, ori=0.0)
    a = np.stack([np.ones(6), np.minimum(x, 1000 - x) / 500], 1)
    w = 1 / np.array([1e-3, 1e-3, 5, 5, 5, 5.0]) ** 2
    off = y - a @ np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))
    assert fit["r2"] == pytest.approx(1 - (off**2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6) and fit["r2"] < 0


def test_windows_without_a_usable_error_weigh_as_the_median():
    x, y = profile(0, 1000.0, 40, lambda d: -d, 4)
    se = np.full(40, 0.1)
    se[::5] = [np.nan, 0, -1, np.inf, np.nan, 0, np.nan, 0]
    assert fit_v(x, y, se, 1000.0, ori=0.0)["log2_ptr"] == pytest.approx(fit_v(x, y, np.full(40, 0.1), 1000.0, ori=0.0)["log2_ptr"], rel=1e-9)


def test_a_prior_draws_the_searched_origin():
    length = 1_000_000.0
    x, y = profile(0, length, 120, lambda d: 0 * d, 5, 1.0)
    free = fit_v(x, y, None, length, kinks=False)
    drawn = [fit_v(x, y, None, length, kinks=False, prior=(700_000.0, sd)) for sd in (2e3, 1e9, 0.0)]
    gap = lambda fit: min(abs(fit["ori"] - 700_000), length - abs(fit["ori"] - 700_000))
    assert drawn[1]["ori"] == free["ori"] == drawn[2]["ori"]
    assert gap(drawn[0]) <= gap(free) and (not drawn[0]["ok"] or gap(drawn[0]) < 300_000)


def test_baselines_are_chosen_in_every_genome(spark):
    from tagforge.operators.dynamics import delta, in_baseline

    rows = [("g", "a", "ctl", 1.0), ("g", "b", "x", 3.0), ("h", "ctl", "x", 2.0), ("h", "b", "x", 5.0), ("i", "b", "x", 7.0)]
    df = spark.createDataFrame([(g, s, k, v, 0.1) for g, s, k, v in rows], "genome_id string, sample string, group string, log2_ptr double, se double").withColumn("base_row", in_baseline("ctl"))
    from pyspark.sql import functions as F

    assert {(r.genome_id, r.sample): r.delta for r in delta(df, F.col("base_row")).collect()} == {("g", "b"): 2.0, ("h", "b"): 3.0}


def test_sorted_fit_and_simulation():
    y = np.linspace(0, 1, 100)
    assert fit_sorted(y)["log2_ptr"] == pytest.approx(100 / 99, rel=1e-6)
    p = anchors(2000, 2_000_000, True, 1)
    c = counts(p, 2e6, 6e5, 1.0, 12.0, 0.1, 5)
    assert estimate(p, c, 2e6, "v") == pytest.approx(1.0, abs=0.3)


def test_simulated_routes_hold_every_arm():
    assert [a[0] for a in route_b()] == ["single", "union_same_budget", "union_full_budget"] * 2 and {a[5] for a in route_b()} == {0.3, 0.6}
    assert route_b()[1][4] * 28_381 == pytest.approx(50 * 2_932)
    assert len(route_a()) == 15 and {a[1] for a in route_a()} == {2_932, 18_600, 28_381}
    p = anchors(20_000, 2_000_000, True, 1)
    rates = binned(p, counts(p, 2e6, 6e5, 0.0, 0.4, 0.0, 5))[:, 1]
    assert 2 ** rates.mean() == pytest.approx(0.4, rel=0.1)  # the mean positive count alone says 1.2


def test_enzymes_share_an_origin_unless_it_is_known(spark):
    length, rng = 2_000_000.0, np.random.default_rng(4)
    rows = []
    for enzyme in range(6):
        x = rng.uniform(0, length, 12)
        d = np.minimum((x - 6e5) % length, (6e5 - x) % length)
        rows += [("s", 1, enzyme, float(p), float(v), 0.3) for p, v in zip(x, enzyme - d / (length / 2) + rng.normal(0, 0.3, 12), strict=True)]
    rates = spark.createDataFrame(rows, "sample string, genome_id int, enzyme int, mid double, log2_rate double, log2_se double")
    shared = fit_windows(rates, length).collect()
    assert len({r.ori for r in shared}) == 1 and len(shared) == 6 and all(r.ok for r in shared)
    assert min((shared[0].ori - 6e5) % length, (6e5 - shared[0].ori) % length) < 1.5e5
    assert len({r.ori for r in fit_windows(rates, length, shared_ori=False).collect()}) > 1
    known = spark.createDataFrame([(1, length, 1, 5e5, 0.7)], "genome_id int, genome_len double, n_contigs int, ori double, ori_confidence double")
    assert {(r.ori, r.ori_confidence) for r in fit_windows(rates, known).collect()} == {(5e5, 0.7)}


def test_genomes_of_two_lengths_in_one_plan(spark):
    rng = np.random.default_rng(8)
    genomes = [(1, "one", 2_000_000.0, 1, 1.0), (2, "two", 4_000_000.0, 1, 0.5), (3, "three", 3_000_000.0, 2, 1.0)]
    rows = []
    for gid, _, length, _, truth in genomes:
        for enzyme in range(5):
            p = rng.integers(0, int(length), 1500)
            d = np.minimum((p - 0.3 * length) % length, (0.3 * length - p) % length)
            c = rng.poisson(12 * 2 ** (-truth * d / (length / 2)))
            rows += [("s", gid, 0, int(x), int(x), enzyme, int(k), 3, 100, True, 0.5) for x, k in zip(p, c, strict=True)]
    counts = spark.createDataFrame(rows, "sample string, genome_id int, contig_id int, position bigint, global_position bigint, enzyme int, count int, flags int, local_gc int, usable boolean, gc double")
    table = spark.createDataFrame([g[:4] for g in genomes], "genome_id int, genome string, genome_len double, n_contigs int")
    seen = spark.createDataFrame([("s", 1, 0.9), ("s", 2, 0.2)], "sample string, genome_id int, containment double")
    out = {r.genome: r for r in report.estimate(counts, table, containment=seen)[2].collect()}
    for gid, name, _, contigs, truth in genomes[:2]:
        assert out[name].log2_ptr == pytest.approx(truth, abs=0.1), gid
    assert out["three"].log2_ptr is None and "no estimate" in out["three"].qc_reason and out["three"].note == "no enzyme produced a usable estimate"
    assert out["one"].containment == 0.9 and "low containment" in out["two"].qc_reason and "low containment" not in out["one"].qc_reason


def agree(spark, values, errors, **options):
    rows = [("s", 1, i, float(v), float(e), 100, 0.9) for i, (v, e) in enumerate(zip(values, errors, strict=True))]
    est = spark.createDataFrame(rows, "sample string, genome_id int, enzyme int, est double, se double, n_anchors bigint, r2 double")
    return fusion.fuse(fusion.exclusions(est), **options).head()


def test_random_effects_only_where_q_rejects(spark):
    mild = agree(spark, [1.0, 1.1, 1.25, 0.95], [0.1] * 4)
    assert mild.q > 3 and mild.q_pvalue > 0.05 and mild.tau2 > 0 and mild.fusion_model == "fixed" and mild.log2_ptr == pytest.approx(mild.fixed)
    wild = agree(spark, [1.0, 2.0, 0.2, 1.5], [0.1] * 4)
    assert wild.q_pvalue < 0.05 and wild.fusion_model == "random" and wild.se > wild.fixed_se
    assert agree(spark, [1.0, 1.1, 1.25, 0.95], [0.1] * 4, model="always").fusion_model == "random" and agree(spark, [1.0, 2.0, 0.2, 1.5], [0.1] * 4, model="never").fusion_model == "fixed"
    one = agree(spark, [1.3], [0.2])
    assert (one.k, one.i2, one.q_pvalue, one.tau2, one.fusion_model, one.log2_ptr) == (1, None, None, 0.0, "fixed", pytest.approx(1.3))


def test_exclusion_by_anchors(spark):
    rows = [("s", 1, 0, 1.0, 0.1, 29), ("s", 1, 1, 1.0, 0.1, 30), ("s", 1, 2, None, 0.1, 90), ("s", 1, 3, 1.0, 0.0, 90)]
    est = spark.createDataFrame(rows, "sample string, genome_id int, enzyme int, est double, se double, n_anchors bigint")
    assert {r.enzyme: r.reason for r in fusion.exclusions(est).collect()} == {0: "only 29 anchors (< 30)", 1: None, 2: "no estimate", 3: "no usable standard error"}


def test_mixture_takes_the_dominant_part():
    rng = np.random.default_rng(6)
    got = choose(np.concatenate([rng.poisson(3, 70), rng.poisson(30, 30)]), "ztp")
    assert got["n_components"] >= 2 and got["rate"] == pytest.approx(3, abs=0.7)
    alone = rng.poisson(3, 70)
    assert got["se"] == pytest.approx(choose(alone, "ztp")["se"], rel=0.4)
    ridge = np.array([1] * 300 + [2])
    assert choose(np.concatenate([ridge, np.zeros(3, int)]), "ztnb")["rate"] is None


def test_curves_are_read_between_and_beyond_their_points(spark):
    curve = spark.createDataFrame([(1, 0.4, -1.0, 1.0, 0.5), (1, 0.6, 1.0, 1.0, 0.5)], "enzyme int, gc double, log2_offset double, shrinkage double, r2 double")
    counts = spark.createDataFrame([(1, 0.5), (1, 0.45), (1, 0.1), (1, 0.9), (1, None), (2, 0.5)], "enzyme int, gc double")
    got = {(r.enzyme, r.gc): r.gc_offset for r in offsets(counts, curve).collect()}
    assert got == pytest.approx({(1, 0.5): 0.0, (1, 0.45): -0.5, (1, 0.1): -1.0, (1, 0.9): 1.0, (1, None): 0.0, (2, 0.5): 0.0})
    thin = spark.createDataFrame([(1, 0.4 + i / 200, 3, True) for i in range(50)], "enzyme int, gc double, count bigint, usable boolean")
    assert fit_curves(thin).count() == 0


def test_prior_breaks_ties_towards_the_annotation(spark):
    grid = spark.createDataFrame([("s", 1, 0.0, -1.0, 1.0, 10), ("s", 1, 400.0, -1.0, 1.0, 10)], "sample string, genome_id int, ori double, slope double, sse double, n bigint")
    from pyspark.sql import functions as F

    near = fit.with_prior(grid, F.lit(390.0), F.lit(50.0), 1000)
    assert fit.best_origin(near, ["sample", "genome_id"]).head().ori == 400.0
    assert fit.best_origin(fit.with_prior(grid, F.lit(None).cast("double"), F.lit(None).cast("double"), 1000), ["sample", "genome_id"]).head().ori == 0.0


def test_sorted_fit_needs_enough_values():
    assert fit_sorted(np.arange(4.0))["note"] == "too few windows"
    up = fit_sorted(np.sort(np.random.default_rng(1).normal(0, 1, 60)))
    assert up["ok"] and up["r2"] > 0.8


def test_enzyme_windows_sort_stretches_not_contigs(spark, monkeypatch):
    """Places counted over stretches of 16 bases equal those of whole contigs, with nulls, ties and negative positions; no row is sorted by contig."""
    rng = np.random.default_rng(3)
    rows = [(s, g, e, c, None if rng.random() < 0.02 else int(rng.integers(-40, 900)), int(rng.integers(0, 9)), int(rng.integers(60, 64)), 3, bool(rng.random() < 0.9)) for s, g, e in (("a", 1, 0), (None, 1, 0), ("a", 2, None)) for c in (0, 1) for _ in range(int(rng.integers(500, 900)))]
    counts = spark.createDataFrame(rows, "sample string, genome_id int, enzyme int, contig_id int, position bigint, count int, local_gc int, flags int, usable boolean")
    monkeypatch.setattr(windows, "STRETCH", 4)
    df = windows.enzyme_windows(counts)
    want = []
    for group in {r[:3] for r in rows}:
        size = min(max(sum(r[:3] == group and r[8] for r in rows) // 25, 25), 100)
        for contig in (0, 1):
            own = sorted((r for r in rows if r[:3] == group and r[3] == contig and r[8]), key=lambda r: (r[4] is not None, r[4] or 0, r[5:8]))
            tail, last = len(own) % size, (len(own) - 1) // size
            want += [(*r, size, last - 1 if i // size == last > 0 and 0 < tail * 2 < size else i // size) for i, r in enumerate(own)]
    assert df.columns == [*counts.columns, "window_size", "chunk"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    sorts = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line and "Window" in line]
    assert sorts and all("windowspecdefinition(__in#" in line for line in sorts)


def test_enzyme_windows_deal_more_rows_over_more_tasks(spark, monkeypatch):
    """A task's share of the sort doesn't grow with the table: more rows are dealt over more partitions, with the same chunks."""
    from tagforge import session

    schema = "sample string, genome_id int, enzyme int, contig_id int, position bigint, count int, local_gc int, flags int, usable boolean"
    made = lambda n: windows.enzyme_windows(spark.createDataFrame([("s", 1, 0, 0, i, i % 9, 60, 3, i % 7 > 0) for i in range(n)], schema))
    monkeypatch.setattr(windows, "STRETCH", 2)
    want = sorted(map(tuple, made(1400).collect()))
    monkeypatch.setattr(session, "ROWS", 100)
    assert {n: made(n).rdd.getNumPartitions() for n in (140, 700, 1400)} == {140: 4, 700: 6, 1400: 12} and not made(0).collect()
    assert sorted(map(tuple, made(1400).collect())) == want and len(want) == 1200


def test_given_windows(spark):
    rows = [("s", 1, 0, e, i, i, 2, 0.5, True, None if i == 9 else i // 5) for e in (0, 1) for i in range(10)]
    counts = spark.createDataFrame(rows, "sample string, genome_id int, contig_id int, enzyme int, position bigint, global_position bigint, count int, gc double, usable boolean, window_id bigint")
    got = windows.given_windows(counts).groupBy("enzyme", "chunk").count().collect()
    assert {(r.enzyme, r.chunk): r["count"] for r in got} == {(0, 0): 5, (0, 1): 4, (1, 0): 5, (1, 1): 4}


def test_anchor_matrix_leaves_masked_anchors_out(spark):
    from tagforge.operators.dynamics import anchor_matrix

    rows = [("a", 1, 0, 5, 2, 3, True), ("b", 1, 0, 5, 2, 4, True), ("a", 1, 0, 9, 2, 7, False), ("a", 2, 1, 5, 0, 1, True)]
    counts = spark.createDataFrame(rows, "sample string, genome_id int, contig_id int, position bigint, enzyme int, count int, usable boolean")
    plain = lambda **k: {r.anchor: (r.a, r.b) for r in anchor_matrix(counts, ["a", "b"], **k).collect()}
    assert plain() == {"1:0:5:2": (3, 4), "2:1:5:0": (1, 0)}
    assert plain(usable_only=False, genome=1) == {"1:0:5:2": (3, 4), "1:0:9:2": (7, 0)}


def test_anchor_matrix_sums_after_the_shuffle_alone(spark):
    from tagforge.operators.dynamics import anchor_matrix

    rng = np.random.default_rng(4)
    rows = [(s, 1, 0, int(rng.integers(0, 40)), 2, None if rng.random() < 0.1 else int(rng.integers(0, 9)), True) for s in ("a", "b", "other", None) for _ in range(50)]
    counts = spark.createDataFrame(rows, "sample string, genome_id int, contig_id int, position bigint, enzyme int, count int, usable boolean")
    df = anchor_matrix(counts, ["a", "b"])
    want = {f"1:0:{p}:2": tuple(sum(r[5] or 0 for r in rows if r[3] == p and r[0] == s) for s in "ab") for p in {r[3] for r in rows}}
    assert {r.anchor: (r.a, r.b) for r in df.collect()} == want
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    below = plan.splitlines()[max(i for i, line in enumerate(plan.splitlines()) if "Exchange" in line) :]
    assert not any("Aggregate" in line for line in below)


def test_model_queries_run(spark, sf):
    import __spark_entry__ as entry

    for name in ("lowess_gc", "vfit_two_stage", "ransac", "q_pvalue", "delta_pvalues", "window_rate_models", "gc_corrected_rates"):
        assert entry.queries()[name](spark, sf).count() > 0, name


def test_short_numbers_read_as_percent_g(spark):
    from pyspark.sql import functions as F

    values = [0.0, 1.0, 0.05, 0.012, 0.0119999, 0.003, 3e-4, 9.96e-5, 9.94e-5, 1e-5, 1.2345e-12, 0.0999, 0.5, 4.44e-200]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3):
        got = [r.s for r in df.select(fusion.short(F.col("v"), digits).alias("s")).collect()]
        assert got == [f"{v:.{digits}g}" for v in values]


def test_svg_figures_one_file_a_group(spark, tmp_path):
    from xml.etree import ElementTree

    from tagforge.sources.staged import write_named

    both = [("a<b", 0), ("s/2", 0), ("s/2", 1)]
    rates = spark.createDataFrame([(s, g, e, 1000.0 * k, 2.0 - k / 10 + e, 0.1) for s, g in both for e in (0, 3) for k in range(10)] + [("s/2", 1, 0, 1.0, None, None)], "sample string, genome_id int, enzyme int, mid double, log2_rate double, log2_se double")
    fits = spark.createDataFrame([(s, g, e, 1.0 + e / 10, 0.1, e != 3) for s, g in both for e in (0, 3, 7)], "sample string, genome_id int, enzyme int, log2_ptr double, se double, ok boolean")
    out = spark.createDataFrame([(s, g, None if g else 500.0, 1.1, 0.9, 1.3, 0.25) for s, g in both], "sample string, genome_id int, ori double, `log2(PTR)` double, ci_low double, ci_high double, enzyme_consistency double")
    genomes = spark.createDataFrame([(0, "g & co", 10_000), (1, "h", 10_000)], "genome_id int, genome string, genome_len bigint")
    path = tmp_path / "svg"
    for _ in range(2):
        write_named(report.svg_figures(rates, fits, out, genomes), str(path), ".svg")
    names = sorted(f.name for f in path.iterdir())
    assert names == sorted(f"{s}__{g}.{k}.svg" for s, g in (("a%3Cb", "g %26 co"), ("s%2F2", "g %26 co"), ("s%2F2", "h")) for k in ("profile", "forest"))
    space = "{http://www.w3.org/2000/svg}"
    page = ElementTree.parse(path / names[-1].replace("profile", "forest")).getroot()
    assert len(page.findall(f"{space}circle")) == 2 and [x.text for x in page.findall(f"{space}text") if x.text in ("BcgI", "BaeI", "Bsp24I")] == ["BcgI", "Bsp24I"]
    profile = ElementTree.parse(path / "a%3Cb__g %26 co.profile.svg").getroot()
    assert profile.find(f"{space}title").text == "a<b / g & co" and len(profile.findall(f"{space}circle")) == 20
    ori = [x for x in profile.findall(f"{space}line") if x.get("class") == "ori"]
    assert len(ori) == 1 and float(ori[0].get("x1")) == pytest.approx(60 + 500 / 10_000 * 780, abs=0.06)
    first = min((c for c in profile.findall(f"{space}circle")), key=lambda c: float(c.get("cx")))
    assert float(first.get("cx")) == pytest.approx(60, abs=0.06)


def test_false_discovery_rates_by_brute_force(spark):
    from tagforge.operators.dynamics import benjamini_hochberg

    random = np.random.default_rng(3)
    p = [*(random.random(300) ** 6), *([0.04] * 50), 0.0, 0.0, 5e-324, 1e-200, 1.0, 1.0, None, None]
    got = benjamini_hochberg(spark.createDataFrame(list(enumerate(map(lambda x: None if x is None else float(x), p))), "i int, p double"), "p").toPandas().set_index("i")
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    low = 1.0
    for rank in range(len(known), 0, -1):
        x, i = known[rank - 1]
        low = min(low, x * len(known) / rank)
        assert got.q[i] == pytest.approx(low, rel=1e-12, abs=0)
    assert len(got) == len(p) and got.q[-2:].isna().all()
    assert benjamini_hochberg(spark.createDataFrame([], "p double"), "p").count() == 0
