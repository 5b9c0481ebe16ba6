"""Queries on iterative models, most of which SQL can't express, and on tail probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagforge.functions import stats as S
from tagforge.operators import dynamics as Y
from tagforge.operators import gcbias as G
from tagforge.operators import mixture as M
from tagforge.operators import report
from tagforge.operators import vfit as V
from tagforge.operators import windows as N
from tagforge.plans import statistics as Q
from tagforge.operators.fusion import FUSE_SQL
from tagforge.plans.registry import query
from tagforge.sources import fixtures as X
from tagforge.sources.tables import OUTPUT_COLUMNS


# -- tail probabilities in DuckDB, as finite or fast sums -----------------------


def erfc_sql(x: str) -> str:
    """erf is a sum of positive terms; beyond 6 the complement is below any rounding here."""
    x = f"least({x}, 6.0::DOUBLE)"
    return f"(1 - list_sum(list_transform(range(200), lambda i: exp((2 * i + 1) * ln(greatest({x}, 1e-300::DOUBLE)) - lgamma(i + 1.5::DOUBLE) - {x} * {x}))))"


def chi2_sql(q: str, df: str) -> str:
    """Upper tail for a whole number of degrees of freedom."""
    h = f"({q} / 2)"
    terms = lambda shift, n: f"coalesce(list_sum(list_transform(range({n}), lambda i: exp((i + {shift}) * ln(greatest({h}, 1e-300::DOUBLE)) - lgamma(i + {shift} + 1) - {h}))), 0)"
    return f"(CASE WHEN {df} % 2 = 0 THEN {terms('0.0::DOUBLE', f'{df} // 2')} ELSE {erfc_sql(f'sqrt({h})')} + {terms('0.5::DOUBLE', f'({df} - 1) // 2')} END)"


def t_sql(t: str, df: str) -> str:
    """Both tails for a whole number of degrees of freedom, from the angle whose tangent is |t| / sqrt(df)."""
    a = f"atan(abs({t}) / sqrt({df}))"
    terms = lambda up, down, n: f"coalesce(list_sum(list_transform(range({n}), lambda i: exp(lgamma(i + {up}) - lgamma(i + {down})) * cos({a}) ** (2 * i))), 0)"
    even = f"sin({a}) / sqrt(pi()) * {terms('0.5::DOUBLE', '1.0::DOUBLE', f'{df} // 2')}"
    odd = f"2 / pi() * ({a} + sin({a}) * cos({a}) * sqrt(pi()) / 2 * {terms('1.0::DOUBLE', '1.5::DOUBLE', f'({df} - 1) // 2')})"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


WINDOW = ", ".join(M.KEY)


def rate_sql(mean: str) -> str:
    """The Poisson rate of a zero-truncated mean, by Newton steps over a list whose first element is the start."""
    step = f"greatest(x - (x / (1 - exp(-x)) - ({mean})) / (((1 - exp(-x)) - x * exp(-x)) / ((1 - exp(-x)) * (1 - exp(-x)))), 1e-12)"
    return f"CASE WHEN ({mean}) <= 1 THEN 0 ELSE list_reduce(list_prepend(CASE WHEN ({mean}) > 2 THEN ({mean}) ELSE 2 * (({mean}) - 1) END, list_transform(range(30), lambda i: i::DOUBLE)), lambda x, i: {step}) END"


def _log_part(w: str, r: str) -> str:
    return f"ln(greatest({w}, 1e-12)) + CASE WHEN {r} < 1e-8 THEN CASE WHEN v = 1 THEN 0 ELSE -1e300 END ELSE v * ln(greatest({r}, 1e-12)) - {r} - lgamma(v + 1) - ln(greatest(1 - exp(-{r}), 1e-300)) END"


#: Expectation maximisation as a recursion over rounds; a row is a window with a number of parts, its values, weights and rates as lists.
EM_SQL = f"""hist AS MATERIALIZED (SELECT {WINDOW}, list(v ORDER BY v) FILTER (v >= 1) AS vs, list(m ORDER BY v) FILTER (v >= 1) AS ns, coalesce(sum(m) FILTER (v >= 1), 0)::BIGINT AS n, sum(m)::BIGINT AS n_anchors, sum(v * m) FILTER (v >= 1) AS total
  FROM (SELECT {WINDOW}, count::DOUBLE AS v, count(*)::DOUBLE AS m FROM ew GROUP BY ALL) GROUP BY ALL),
quant AS (SELECT {WINDOW}, quantile_cont(count::DOUBLE, [0.15, 0.85]) AS q2, quantile_cont(count::DOUBLE, [0.15, 0.5, 0.85]) AS q3 FROM ew WHERE count >= 1 GROUP BY ALL),
em AS (
  SELECT {WINDOW}, vs, ns, n, parts, list_transform(range(parts), lambda i: 1.0::DOUBLE / parts) AS ws, list_transform(CASE parts WHEN 2 THEN q2 ELSE q3 END, lambda q: {rate_sql("greatest(q, 1.000001)")}) AS rs, NULL::DOUBLE AS last, 0 AS turn, false AS done
  FROM hist JOIN quant USING ({WINDOW}), (SELECT unnest([2, 3]) AS parts) WHERE parts <= least(n // 10, len(vs))
  UNION ALL
  SELECT {WINDOW}, vs, ns, n, parts, CASE WHEN stop THEN ws ELSE list_transform(masses, lambda m: greatest(m / n, 1e-12) / list_sum(list_transform(masses, lambda k: greatest(k / n, 1e-12)))) END,
    CASE WHEN stop THEN rs ELSE list_transform(range(1, parts + 1), lambda j: CASE WHEN masses[j] <= 1e-12 THEN rs[j] ELSE {rate_sql("means[j]")} END) END, CASE WHEN stop THEN last ELSE like_now END, turn + 1, stop
  FROM (SELECT *, list_transform(range(1, parts + 1), lambda j: list_sum(list_transform(range(1, len(vs) + 1), lambda i: share[i][j] * vs[i])) / greatest(masses[j], 1e-300)) AS means, last IS NOT NULL AND abs(like_now - last) < 1e-7 * greatest(1, abs(last)) AS stop
    FROM (SELECT *, list_transform(range(1, parts + 1), lambda j: list_sum(list_transform(share, lambda s: s[j]))) AS masses
      FROM (SELECT *, list_sum(list_transform(range(1, len(vs) + 1), lambda i: ns[i] * norms[i])) AS like_now, list_transform(range(1, len(vs) + 1), lambda i: list_transform(logs[i], lambda x: exp(x - norms[i]) * ns[i])) AS share
        FROM (SELECT *, list_transform(logs, lambda g: list_max(g) + ln(list_sum(list_transform(g, lambda x: exp(x - list_max(g)))))) AS norms
          FROM (SELECT *, list_transform(vs, lambda v: list_transform(range(1, parts + 1), lambda j: {_log_part("ws[j]", "rs[j]")})) AS logs FROM em WHERE NOT done AND turn < 200)))))),
ended AS (SELECT *, list_transform(vs, lambda v: list_transform(range(1, parts + 1), lambda j: {_log_part("ws[j]", "rs[j]")})) AS logs FROM em QUALIFY row_number() OVER (PARTITION BY {WINDOW}, parts ORDER BY turn DESC) = 1),
finals AS (SELECT *, list_transform(logs, lambda g: list_max(g) + ln(list_sum(list_transform(g, lambda x: exp(x - list_max(g)))))) AS norms, list_position(ws, list_max(ws)) AS top FROM ended),
fits AS (
  SELECT {WINDOW}, parts, rs[top] AS x, list_sum(list_transform(range(1, len(vs) + 1), lambda i: exp(logs[i][top] - norms[i]) * ns[i])) AS mass, (2 * parts - 1) * ln(n) - 2 * list_sum(list_transform(range(1, len(vs) + 1), lambda i: ns[i] * norms[i])) AS bic FROM finals
  UNION ALL SELECT {WINDOW}, 1, x, n, ln(n) - 2 * list_sum(list_transform(range(1, len(vs) + 1), lambda i: ns[i] * CASE WHEN x < 1e-8 THEN CASE WHEN vs[i] = 1 THEN 0 ELSE -1e300 END ELSE vs[i] * ln(x) - x - lgamma(vs[i] + 1) - ln(1 - exp(-x)) END))
  FROM (SELECT *, {rate_sql("total / n")} AS x FROM hist WHERE n > 0)),
chosen AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY {WINDOW} ORDER BY bic, parts) = 1)"""


@query(
    f"""SELECT {WINDOW}, n_anchors, n AS n_positive, CASE WHEN x > 1e-8 THEN round(x, 5) END AS rate, CASE WHEN x > 1e-8 THEN round(sqrt(greatest(x / (1 - exp(-x)) * (1 + x - x / (1 - exp(-x))), 1e-12) / mass) / (((1 - exp(-x)) - x * exp(-x)) / (1 - exp(-x)) ** 2), 5) END AS se,
  CASE WHEN n > 0 THEN 'ztp' ELSE 'empty' END AS model, round(bic, 4) AS bic, coalesce(parts, 0) AS n_components FROM hist LEFT JOIN chosen USING ({WINDOW})""",
    (*Q.EW, EM_SQL),
    recursive=True,
)
def ztp_mixture(spark, d):
    m = M.model_rates(N.enzyme_windows(X.counts(spark, d)), "ztp")
    return m.select(*M.KEY, "n_anchors", "n_positive", F.round("rate", 5).alias("rate"), F.round("se", 5).alias("se"), "model", F.round("bic", 4).alias("bic"), "n_components")


@query()
def ztnb(spark, d):
    return M.model_rates(N.enzyme_windows(X.counts(spark, d)), "ztnb")


@query()
def window_rate_models(spark, d):
    return M.model_rates(N.enzyme_windows(X.counts(spark, d)), "auto")


def _lowess_round(k: int, source: str, last: bool) -> str:
    """The lines of one round from the moments of every place, and the trust that the residuals leave."""
    moments = f"""m{k} AS MATERIALIZED (SELECT enzyme, g, sum(n * trust) AS a, sum(n * trust * y) AS b, sum(n * y) / sum(n) AS plain FROM {source} GROUP BY ALL),
c{k} AS MATERIALIZED (SELECT enzyme, p, sum(w * a) AS sw, sum(w * a * g) / nullif(sum(w * a), 0) AS mx, sum(w * b) / nullif(sum(w * a), 0) AS my FROM near JOIN m{k} USING (enzyme, g) GROUP BY ALL),
l{k} AS MATERIALIZED (SELECT enzyme, p AS g, CASE WHEN any_value(sw) > 0 THEN any_value(my) + CASE WHEN sum(w * (g - mx) ** 2 * a) < 1e-12 THEN 0 ELSE sum(w * (g - mx) * b) / sum(w * (g - mx) ** 2 * a) * (p - any_value(mx)) END ELSE max(CASE WHEN g = p THEN plain END) END AS fit
  FROM near JOIN c{k} USING (enzyme, p) JOIN m{k} USING (enzyme, g) GROUP BY enzyme, p)"""
    if last:
        return moments
    return moments + f""",
r{k} AS MATERIALIZED (SELECT enzyme, g, y, n, abs(y - fit) AS r, sum(n) OVER (PARTITION BY enzyme ORDER BY abs(y - fit) ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY enzyme) AS total FROM {source} JOIN l{k} USING (enzyme, g)),
s{k} AS (SELECT enzyme, (min(r) FILTER (upto > (total - 1) // 2) + min(r) FILTER (upto > total // 2)) / 2 AS med FROM r{k} GROUP BY ALL),
q{k} AS MATERIALIZED (SELECT enzyme, g, y, n, greatest(0, 1 - (r / greatest(6 * med, 1e-12)) ** 2) ** 2 AS trust FROM r{k} JOIN s{k} USING (enzyme))"""


LOWESS_SQL = f"""known AS (SELECT enzyme, gc AS g, log2(count + 0.5) AS y, count(*)::BIGINT AS n FROM counts WHERE usable AND gc IS NOT NULL AND count IS NOT NULL GROUP BY ALL),
q AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS trust FROM known WHERE enzyme IN (SELECT enzyme FROM known GROUP BY enzyme HAVING sum(n) >= {G.MIN_ANCHORS} AND count(DISTINCT g) >= {G.MIN_DISTINCT})),
share AS (SELECT enzyme, g, sum(n) AS s FROM q GROUP BY ALL),
ordered AS MATERIALIZED (SELECT a.enzyme, a.g AS p, b.g, abs(b.g - a.g) AS d, sum(b.s) OVER (PARTITION BY a.enzyme, a.g ORDER BY abs(b.g - a.g), b.g ROWS UNBOUNDED PRECEDING) AS held, sum(b.s) OVER (PARTITION BY a.enzyme, a.g) AS total FROM share a JOIN share b USING (enzyme)),
reached AS (SELECT enzyme, p, coalesce(min(d) FILTER (held >= floor(0.4 * total + 1e-10)), max(d)) AS reach FROM ordered GROUP BY ALL),
near AS MATERIALIZED (SELECT enzyme, p, g, CASE WHEN reach > 0 THEN greatest(0, 1 - (d / greatest(reach, 1e-9)) ** 3) ** 3 WHEN d = 0 THEN 1 ELSE 0 END AS w FROM ordered JOIN reached USING (enzyme, p)),
{_lowess_round(0, "q", False)},
{_lowess_round(1, "q0", False)},
{_lowess_round(2, "q1", True)},
whole AS (SELECT enzyme, total, sum(n * fit) / total AS centre, sum(n * (y - fit) ** 2) AS sse, sum(n * (y - mean) ** 2) AS sst FROM (SELECT *, sum(n) OVER e AS total, sum(n * y) OVER e / sum(n) OVER e AS mean FROM q JOIN l2 USING (enzyme, g) WINDOW e AS (PARTITION BY enzyme)) GROUP BY enzyme, total),
shrunk AS (SELECT *, CASE WHEN r2 > 0 THEN least(1, greatest(0, (r2 - least(total, 3.0::DOUBLE) / total) / r2)) ELSE 0 END AS shrinkage FROM (SELECT *, CASE WHEN sst > 0 THEN 1 - sse / sst ELSE 0 END AS r2 FROM whole)),
curve AS (SELECT enzyme, g AS gc, shrinkage * (fit - centre) AS log2_offset, shrinkage, r2 FROM l2 JOIN shrunk USING (enzyme))"""


@query("SELECT enzyme, gc, round(log2_offset, 6) AS log2_offset, round(shrinkage, 6) AS shrinkage, round(r2, 6) AS r2 FROM curve", (*Q.COUNTS, LOWESS_SQL))
def lowess_gc(spark, d):
    return G.fit_curves(X.counts(spark, d)).select("enzyme", "gc", *Q.r6("log2_offset", "shrinkage", "r2"))


@query(
    f"""SELECT {WINDOW}, round(log2_rate - coalesce(mean_gc_offset, 0), 6) AS log2_rate, round(log2_rate, 6) AS log2_rate_raw, round(mean_gc_offset, 6) AS mean_gc_offset, true AS gc_corrected
FROM rates LEFT JOIN (SELECT {WINDOW}, avg(coalesce(log2_offset, 0)) AS mean_gc_offset FROM ew LEFT JOIN curve USING (enzyme, gc) GROUP BY ALL) USING ({WINDOW})""",
    (*Q.RATES, LOWESS_SQL),
)
def gc_corrected_rates(spark, d):
    c = X.counts(spark, d)
    w = G.offsets(N.enzyme_windows(c), G.fit_curves(c), c)
    mean = w.groupBy(*Q.KEY).agg(F.avg("gc_offset").alias("mean_gc_offset"))
    return G.apply_offset(Q.rates(spark, d).join(mean, Q.KEY)).select(*Q.KEY, *Q.r6("log2_rate", "log2_rate_raw", "mean_gc_offset"), "gc_corrected")


LOOKUP_SQL = """coarse AS (SELECT enzyme, list(gc ORDER BY gc) AS x, list(mean ORDER BY gc) AS y FROM (SELECT enzyme, gc, avg(count) / 10 AS mean FROM counts WHERE gc IS NOT NULL AND local_gc % 7 = 0 AND local_gc BETWEEN 70 AND 130 AND enzyme < 7 GROUP BY ALL) GROUP BY enzyme),
found AS (SELECT p.enzyme, p.gc, x, y, len(list_filter(x, lambda g: g <= gc)) AS below FROM (SELECT DISTINCT enzyme, gc FROM counts WHERE gc IS NOT NULL) p LEFT JOIN coarse USING (enzyme))"""


@query("SELECT enzyme, gc, round(CASE WHEN x IS NULL THEN 0 WHEN below = 0 THEN y[1] WHEN below = len(x) THEN y[-1] ELSE y[below] + (y[below + 1] - y[below]) / (x[below + 1] - x[below]) * (gc - x[below]) END, 6) AS gc_offset FROM found", (*Q.COUNTS, LOOKUP_SQL))
def gc_curve_lookup(spark, d):
    """A coarse curve read between and beyond its points, and for an enzyme without one."""
    c = X.counts(spark, d).where("gc IS NOT NULL")
    coarse = c.where("local_gc % 7 = 0 AND local_gc BETWEEN 70 AND 130 AND enzyme < 7").groupBy("enzyme", "gc").agg((F.avg("count") / 10).alias("log2_offset"))
    return G.lookup(c.select("enzyme", "gc").distinct(), coarse).withColumn("gc_offset", F.round("gc_offset", 6))


G3 = "sample, genome_id, enzyme"
KNOWN_ORI = 1000
#: No kink is one at the terminus.
NO_KINK = 1.0


def points_sql(source: str) -> str:
    """Windows of a source (x, y, s) that the quartile fences keep, their weights, and how many a group has."""
    return f"""points AS (SELECT {G3}, x, y, s, CASE WHEN s > 0 THEN 1 / s ** 2 ELSE median(CASE WHEN s > 0 THEN 1 / s ** 2 END) OVER g END AS w, count(*) OVER g AS n FROM (
  SELECT *, quantile_cont(y, 0.25) OVER g AS q1, quantile_cont(y, 0.75) OVER g AS q3, count(*) OVER g AS seen FROM {source} WHERE y IS NOT NULL WINDOW g AS (PARTITION BY {G3}))
  WHERE seen < 4 OR q3 <= q1 OR y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) WINDOW g AS (PARTITION BY {G3}))"""


def lines_sql(name: str, points: str, tried: str) -> tuple[str, ...]:
    """CTE ``name``: the weighted bent line of every (group, o, k) of ``tried``, from sums about the weighted means."""
    at = f"{G3}, o, k"
    det = "(s11 * s22 - s12 * s12)"
    return (
        f"{name}_t AS MATERIALIZED (SELECT {at}, y, w, n, least(d, k) AS u1, greatest(d - k, 0) AS u2 FROM (SELECT p.*, o, k, {Q.dist_sql('x - o')} / ({Q.GENOME} / 2) AS d FROM {points} p JOIN {tried} USING ({G3})))",
        f"{name}_m AS (SELECT {at}, sum(w * u1) / sum(w) AS m1, sum(w * u2) / sum(w) AS m2, sum(w * y) / sum(w) AS my FROM {name}_t GROUP BY ALL)",
        f"{name}_s AS (SELECT {at}, n, m1, m2, my, sum(w * (u1 - m1) ** 2) AS s11, sum(w * (u1 - m1) * (u2 - m2)) AS s12, sum(w * (u2 - m2) ** 2) AS s22, sum(w * (u1 - m1) * (y - my)) AS s1y, sum(w * (u2 - m2) * (y - my)) AS s2y FROM {name}_t JOIN {name}_m USING ({at}) GROUP BY ALL)",
        f"{name}_b AS MATERIALIZED (SELECT *, CASE WHEN k = {NO_KINK} THEN s1y / s11 ELSE (s1y * s22 - s2y * s12) / {det} END AS b1, CASE WHEN k = {NO_KINK} THEN 0 ELSE (s2y * s11 - s1y * s12) / {det} END AS b2 FROM {name}_s)",
        f"{name}_r AS (SELECT {at}, sum(w * e * e) AS chi2, sum(e * e) AS sse FROM (SELECT {at}, w, y - my - b1 * (u1 - m1) - b2 * (u2 - m2) AS e FROM {name}_t JOIN {name}_b USING ({at})) GROUP BY ALL)",
        f"{name} AS MATERIALIZED (SELECT *, n * ln(greatest(cost / n, 1e-12)) + par * ln(n) AS bic, red * CASE WHEN k = {NO_KINK} THEN 1 / s11 ELSE (k * k * s22 - 2 * k * (1 - k) * s12 + (1 - k) * (1 - k) * s11) / {det} END AS var FROM (SELECT *, red * greatest(n - par, 1) AS cost FROM ("
        f"SELECT *, b1 > 0 OR b2 > 0 AS uphill, -(b1 * k + b2 * (1 - k)) AS log2_ptr, CASE WHEN k = {NO_KINK} THEN 2 ELSE 4 END AS par, chi2 / greatest(n - CASE WHEN k = {NO_KINK} THEN 2 ELSE 3 END, 1) AS red FROM {name}_b JOIN {name}_r USING ({at}))))",
    )


#: The origin of a sample and genome from all enzymes' rates, each less its median: unweighted lines on the grid, then finer.
_STEP = f"({Q.GENOME} / 180.0::DOUBLE)"
SHARED_SQL = (
    f"""pooled AS MATERIALIZED (SELECT sample, genome_id, -1 AS enzyme, x, y - med AS y, 1.0::DOUBLE AS w, count(*) OVER (PARTITION BY sample, genome_id) AS n FROM (SELECT *, median(y) OVER g AS med, count(*) OVER g AS own FROM rp WHERE y IS NOT NULL WINDOW g AS (PARTITION BY {G3})) WHERE own >= 3)""",
    f"pool_tried AS (SELECT {G3}, i * {_STEP} AS o, {NO_KINK}::DOUBLE AS k FROM (SELECT DISTINCT {G3} FROM pooled WHERE n >= 5), range(180) a(i))",
    *lines_sql("pool", "pooled", "pool_tried"),
    f"pool_best AS MATERIALIZED (SELECT * EXCLUDE (low) FROM (SELECT *, min(bic) OVER (PARTITION BY {G3}) AS low FROM pool WHERE NOT uphill) WHERE bic <= low + 1e-7 QUALIFY row_number() OVER (PARTITION BY {G3} ORDER BY o) = 1)",
    f"pool_fine AS (SELECT {G3}, k, f - {Q.GENOME} * floor(f / {Q.GENOME}) AS o FROM (SELECT {G3}, k, o - {_STEP} + j * ({_STEP} / 20) AS f FROM pool_best, range(41) a(j)))",
    *lines_sql("finer", "pooled", "pool_fine"),
    f"shared AS MATERIALIZED (SELECT sample, genome_id, o FROM (SELECT *, min(sse) OVER (PARTITION BY {G3}) AS low FROM (SELECT *, 0 AS first FROM pool_best UNION ALL BY NAME SELECT *, 1 AS first FROM finer WHERE NOT uphill)) WHERE sse <= low * (1 + 1e-7) QUALIFY row_number() OVER (PARTITION BY {G3} ORDER BY first, o) = 1)",
)


def vfit_sql(source: str, known: int | str | None) -> tuple[str, ...]:
    """CTE ``vfit``: both stages at a known origin, one that a CTE of samples and genomes names, or one searched on the grid and refined."""
    step = f"({Q.GENOME} / 180.0::DOUBLE)"
    origins = f"(SELECT i, i * {step} AS o FROM range(180) a(i))" if known is None else "(SELECT 0 AS i)" if isinstance(known, str) else f"(SELECT 0 AS i, {known}::DOUBLE AS o)"
    groups = f"(SELECT DISTINCT {G3}, n, o FROM points JOIN {known} USING (sample, genome_id) WHERE n >= 5)" if isinstance(known, str) else f"(SELECT DISTINCT {G3}, n FROM points WHERE n >= 5)"
    allowed = "NOT uphill" if known is None else "true"
    out = [points_sql(source), f"probes AS (SELECT {G3}, o, {NO_KINK}::DOUBLE AS k FROM {groups}, {origins} WHERE i % 7 = 0)", *lines_sql("probe", "points", "probes")]
    out.append(f"tried AS MATERIALIZED (SELECT {G3}, o, k FROM {groups} JOIN (SELECT {G3}, coalesce(max(log2_ptr) FILTER ({allowed}) >= 1, false) AS steep FROM probe GROUP BY ALL) USING ({G3}), {origins}, (SELECT unnest([{NO_KINK}, 0.25, 0.4, 0.55, 0.7])::DOUBLE AS k) WHERE k = {NO_KINK} OR n >= 30 AND steep)")
    points = "points"
    for stage in ("a", "b"):
        out += [*lines_sql(f"{stage}0", points, "tried"), f"{stage}1 AS MATERIALIZED (SELECT * EXCLUDE (low) FROM (SELECT *, min(bic) OVER (PARTITION BY {G3}) AS low FROM {stage}0 WHERE {allowed}) WHERE bic <= low + 1e-7 QUALIFY row_number() OVER (PARTITION BY {G3} ORDER BY o, k = {NO_KINK} DESC, k) = 1)"]
        if known is None:
            fine = f"(SELECT {G3}, k, f - {Q.GENOME} * floor(f / {Q.GENOME}) AS o FROM (SELECT {G3}, k, o - {step} + j * ({step} / 20) AS f FROM {stage}1, range(41) a(j)))"
            out += [*lines_sql(f"{stage}2", points, fine), f"{stage} AS MATERIALIZED (SELECT * EXCLUDE (first, low) FROM (SELECT *, min(sse) OVER (PARTITION BY {G3}) AS low FROM (SELECT *, 0 AS first FROM {stage}1 UNION ALL BY NAME SELECT *, 1 AS first FROM {stage}2 WHERE NOT uphill)) WHERE sse <= low * (1 + 1e-7) QUALIFY row_number() OVER (PARTITION BY {G3} ORDER BY first, o) = 1)"]
        else:
            out.append(f"{stage} AS (SELECT * FROM {stage}1)")
        if stage == "a":
            out.append(f"""trend AS (SELECT {G3}, regr_slope(ln(s), y) AS eb, regr_intercept(ln(s), y) AS ea, min(s) AS lo, max(s) AS hi, count(*) AS usable FROM points WHERE s > 0 GROUP BY ALL),
again AS MATERIALIZED (SELECT {G3}, x, y, n, CASE WHEN usable < 8 THEN w ELSE 1 / least(hi, greatest(lo, exp(ea + eb * (my + b1 * (least(d, k) - m1) + b2 * (greatest(d - k, 0) - m2))))) ** 2 END AS w
  FROM (SELECT p.*, k, my, m1, m2, b1, b2, {Q.dist_sql('x - o')} / ({Q.GENOME} / 2) AS d FROM points p JOIN a USING ({G3})) JOIN trend USING ({G3}))""")
            points = "again"
    out.append(f"vfit AS (SELECT * FROM b JOIN (SELECT {G3}, sum((y - my) ** 2) AS scatter FROM (SELECT {G3}, y, avg(y) OVER (PARTITION BY {G3}) AS my FROM points) GROUP BY ALL) USING ({G3}))")
    return tuple(out)


VFIT_SELECT = f"""SELECT {G3}, coalesce(p.n, 0) AS n_windows, CASE WHEN k IS NULL THEN 'none' WHEN k < {NO_KINK} THEN 'v_shape_segmented' ELSE 'v_shape' END AS method, round(log2_ptr, 5) AS log2_ptr, CASE WHEN k IS NOT NULL THEN round(sqrt(greatest(var, 0)), 5) END AS se, round(1 - sse / scatter, 5) AS r2,
  round(red, 4) AS reduced_chi2, CASE WHEN k < {NO_KINK} THEN k * {Q.GENOME} / 2 END AS kink{{more}} FROM (SELECT DISTINCT {G3} FROM {{source}}) LEFT JOIN (SELECT DISTINCT {G3}, n FROM points) p USING ({G3}) LEFT JOIN vfit USING ({G3})"""
RATE_POINTS = "rp AS (SELECT sample, genome_id, enzyme, mid AS x, log2_rate AS y, log2_se AS s FROM rates)"


def vfit_columns(fits):
    return fits.select(*Q.GROUP, "n_windows", "method", *[F.round(c, 5).alias(c) for c in ("log2_ptr", "se", "r2")], F.round("reduced_chi2", 4).alias("reduced_chi2"), "kink")


@query(VFIT_SELECT.format(source="rp", more=""), (*Q.RATES, RATE_POINTS, *vfit_sql("rp", KNOWN_ORI)))
def vfit_known_origin(spark, d):
    """Both stages at a given origin, slopes as they are."""
    r = Q.rates(spark, d)
    genomes = r.select("genome_id").distinct().select("genome_id", F.lit(Q.GENOME).alias("genome_len"), F.lit(KNOWN_ORI).alias("ori"))
    return vfit_columns(V.fit_windows(r, genomes, method="v_shape"))


@query(VFIT_SELECT.format(source="rp", more=", round(o, 2) AS ori"), (*Q.RATES, RATE_POINTS, *SHARED_SQL, *vfit_sql("rp", "shared")))
def vfit_two_stage(spark, d):
    """Both stages at the origin that a sample and genome's enzymes share."""
    f = V.fit_windows(Q.rates(spark, d), float(Q.GENOME), method="v_shape")
    return vfit_columns(f).join(f.select(*Q.GROUP, F.round("ori", 2).alias("ori")), Q.GROUP)


#: Profiles with a kink, with a second slope that rises, straight and flat, about one origin; the rates' scatter on them.
STEEP_ORI = 123_456
STEEP = f"""steep AS (SELECT sample, genome_id, (enzyme % 2)::INT AS enzyme, x, 0.15 * log2_rate + CASE (genome_id + enzyme % 2) % 4 WHEN 0 THEN -3.0 * least(d, 0.4) - 0.5 * greatest(d - 0.4, 0)
  WHEN 1 THEN -3.2 * least(d, 0.55) + 1.5 * greatest(d - 0.55, 0) WHEN 2 THEN -1.6 * d ELSE 0.05 * d END AS y, log2_se AS s
  FROM (SELECT *, {Q.dist_sql(f'x - {STEEP_ORI}')} / ({Q.GENOME} / 2) AS d FROM (SELECT *, mid * 97 - {Q.GENOME} * floor(mid * 97 / {Q.GENOME}) AS x FROM rates)))"""


def steep(spark, d):
    r = Q.rates(spark, d).withColumn("x", F.col("mid") * 97 - Q.GENOME * F.floor(F.col("mid") * 97 / Q.GENOME))
    t = F.pmod(F.col("x") - STEEP_ORI, F.lit(float(Q.GENOME)))
    dist = F.least(t, F.lit(float(Q.GENOME)) - t) / (Q.GENOME / 2)
    bent = lambda k, near, far: near * F.least(dist, F.lit(k)) + far * F.greatest(dist - k, F.lit(0.0))
    kind = (F.col("genome_id") + F.col("enzyme") % 2) % 4
    profile = F.when(kind == 0, bent(0.4, -3.0, -0.5)).when(kind == 1, bent(0.55, -3.2, 1.5)).when(kind == 2, -1.6 * dist).otherwise(0.05 * dist)
    return r.select("sample", "genome_id", (F.col("enzyme") % 2).cast("int").alias("enzyme"), F.col("x").alias("mid"), (0.15 * F.col("log2_rate") + profile).alias("log2_rate"), "log2_se")


@query(VFIT_SELECT.format(source="steep", more=", round(o, 2) AS ori"), (*Q.RATES, STEEP, *vfit_sql("steep", None)))
def vfit_segmented(spark, d):
    """Origin and kink searched together for every enzyme of steep profiles; a second slope that rises is refused."""
    f = V.fit_windows(steep(spark, d), float(Q.GENOME), method="v_shape", shared_ori=False)
    return vfit_columns(f).join(f.select(*Q.GROUP, F.round("ori", 2).alias("ori")), Q.GROUP)


_DRAWN = [f"((t * {m}) % 4294967296 >> 8)" for m in V.PAIR_HASH]
RANSAC_SQL = f"""kept AS MATERIALIZED (SELECT * FROM (SELECT {G3}, y, row_number() OVER (PARTITION BY {G3} ORDER BY y) - 1 AS place, n AS total FROM points) WHERE place >= floor(total * 0.05) AND place < total - floor(total * 0.05)),
ranked AS MATERIALIZED (SELECT {G3}, y, total, place - floor(total * 0.05) AS x, count(*) OVER g AS n, max(y) OVER g - min(y) OVER g AS width FROM kept WHERE total >= 5 WINDOW g AS (PARTITION BY {G3})),
turns AS (SELECT {G3}, t, n, {_DRAWN[0]} % n AS i, ({_DRAWN[0]} % n + 1 + {_DRAWN[1]} % (n - 1)) % n AS j FROM (SELECT DISTINCT {G3}, n FROM ranked WHERE n >= 4), range(1, 101) a(t)),
through AS (SELECT {G3}, t, a.x AS xi, a.y AS yi, (b.y - a.y) / (b.x - a.x) AS slope FROM turns JOIN ranked a USING ({G3}) JOIN ranked b USING ({G3}) WHERE a.x = i AND b.x = j),
far AS (SELECT {G3}, t, x, y, width, abs(y - yi - slope * (x - xi)) AS away FROM through JOIN ranked USING ({G3})),
near AS (SELECT * FROM (SELECT *, quantile_cont(away, 0.5) OVER (PARTITION BY {G3}, t) AS limit_ FROM far) WHERE away <= limit_ + 1e-7 * width),
slopes AS (SELECT {G3}, t, regr_slope(y, x) AS slope FROM near GROUP BY ALL HAVING count(*) >= 3),
middle AS (SELECT {G3}, median(slope) AS m FROM slopes GROUP BY ALL),
spread AS (SELECT {G3}, m, 1.4826 * median(abs(slope - m)) AS mad FROM slopes JOIN middle USING ({G3}) GROUP BY ALL),
lines AS (SELECT {G3}, any_value(total) AS total, m, mad, 1 - sum((off - mid) ** 2) / sum((y - mean) ** 2) AS r2 FROM (SELECT *, median(off) OVER g AS mid, avg(y) OVER g AS mean FROM (SELECT *, y - m * x AS off FROM ranked JOIN spread USING ({G3})) WINDOW g AS (PARTITION BY {G3})) GROUP BY ALL)"""


@query(
    f"""SELECT {G3}, coalesce(p.n, 0) AS n_windows, CASE WHEN p.n >= 5 THEN 'sorted' ELSE 'none' END AS method, round(m * total, 5) AS log2_ptr, CASE WHEN mad * total > 0 THEN round(mad * total, 5) END AS se, round(r2, 5) AS r2, coalesce(m * total >= 0, false) AS ok
FROM (SELECT DISTINCT {G3} FROM rp) LEFT JOIN (SELECT DISTINCT {G3}, n FROM points) p USING ({G3}) LEFT JOIN lines USING ({G3})""",
    (*Q.RATES, RATE_POINTS, points_sql("rp"), RANSAC_SQL),
)
def ransac(spark, d):
    f = V.fit_windows(Q.rates(spark, d), float(Q.GENOME), method="sorted")
    return f.select(*Q.GROUP, "n_windows", "method", *[F.round(c, 5).alias(c) for c in ("log2_ptr", "se", "r2")], "ok")


@query(f"SELECT sample, genome_id, round(q, 5) AS q, k, CASE WHEN k > 1 THEN round({chi2_sql('q', '(k - 1)')}, 6) END AS p FROM fused", Q.FUSED)
def q_pvalue(spark, d):
    return Q.fused(spark, d).select(*Q.BY, F.round("q", 5).alias("q"), "k", F.round("q_pvalue", 6).alias("p"))


#: Fits of every enzyme, some failed, from the estimates; genomes and containment from nations.
_H = "(genome_id * 7 + enzyme * 3 + length(sample))"
FITS_SQL = f"""fits AS (SELECT sample, genome_id, enzyme, {_H} % 6 <> 0 AS ok, CASE WHEN {_H} % 12 = 0 THEN 'no downhill origin' ELSE '' END AS note, CASE WHEN {_H} % 6 <> 0 THEN est END AS est, se, n_anchors, r2, n AS n_windows_used,
  CASE WHEN {_H} % 4 = 1 THEN 'v_shape_segmented' ELSE 'v_shape' END AS method, {_H} * 1234.5::DOUBLE AS ori, {_H} % 10 / 10.0::DOUBLE AS ori_confidence, {_H} % 5 / 2.0::DOUBLE + 0.3013 AS mean_rate, {_H} % 7 / 8.0::DOUBLE + 0.2013 AS mean_fraction, {_H} % 13 / 2.0::DOUBLE + 0.0013 AS mean_dispersion FROM estimates)"""
FIT_FUSE_SQL = FUSE_SQL.replace("FROM estimates", "FROM fits").replace("CASE WHEN est IS NULL THEN", "CASE WHEN NOT ok THEN CASE WHEN note = '' THEN 'fit failed' ELSE note END WHEN est IS NULL THEN")
OUTPUT_SQL = f"""figures AS (SELECT sample, genome_id, avg(mean_rate) FILTER (reason IS NULL) AS coverage, avg(mean_dispersion) FILTER (reason IS NULL) AS dispersion, avg(mean_fraction) FILTER (reason IS NULL) AS fraction,
  median(ori) FILTER (reason IS NULL) AS ori, median(ori_confidence) FILTER (reason IS NULL) AS ori_confidence, coalesce(sum(n_anchors) FILTER (reason IS NULL), 0)::BIGINT AS n_anchors, coalesce(sum(n_windows_used) FILTER (reason IS NULL), 0)::BIGINT AS n_windows,
  coalesce(string_agg(DISTINCT method, ',' ORDER BY method) FILTER (reason IS NULL), 'none') AS method FROM reasoned GROUP BY ALL),
whole AS (SELECT t.*, f.* EXCLUDE (sample, genome_id), u.* EXCLUDE (sample, genome_id), worst_name, n_name AS genome, coalesce(r_name, '-') AS taxonomy, CASE WHEN genome_id % 3 > 0 THEN (genome_id * 5 + length(sample)) % 9 / 9.0::DOUBLE END AS containment,
  CASE WHEN k > 1 THEN {chi2_sql('q', '(k - 1)')} END AS p, coalesce(k, 0) / n_attempted::DOUBLE AS fit_rate
  FROM tab t JOIN figures f USING (sample, genome_id) LEFT JOIN fused u USING (sample, genome_id) LEFT JOIN worst USING (sample, genome_id) LEFT JOIN nation ON n_nationkey = genome_id LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey > 0)"""


@query(
    """SELECT sample, genome, taxonomy, round(coverage, 6) AS coverage, round(dispersion, 6) AS dispersion, round(fraction, 6) AS fraction, round(containment, 6) AS containment, round(2 ** log2_ptr, 6) AS "PTR", round(log2_ptr, 6) AS "log2(PTR)", round(p, 6) AS enzyme_consistency,
  n_anchors, round(ori_confidence, 6) AS ori_confidence, round(se, 6) AS se, round(log2_ptr - 1.959963984540054 * se, 6) AS ci_low, round(log2_ptr + 1.959963984540054 * se, 6) AS ci_high, coalesce(k, 0) AS n_enzymes, n_attempted AS n_enzymes_attempted, round(fit_rate, 6) AS enzyme_fit_rate,
  enzymes_used, round(i2, 5) AS enzyme_i2, coalesce(fusion_model, 'none') AS fusion_model, round(ori, 6) AS ori, method, n_windows, reason = '' AS pass_qc, reason AS qc_reason, excluded,
  CASE WHEN k IS NULL THEN 'no enzyme produced a usable estimate' WHEN k = 1 THEN 'single enzyme: no cross-enzyme consistency check available' WHEN p < 0.05 THEN 'enzymes disagree (Q=' || format('{:.1f}', round(q, 1)) || ', p=' || format('{:.3g}', p) || '); largest deviation from ' || worst_name ELSE '' END AS note
FROM (SELECT *, concat_ws('; ', CASE WHEN coverage < 1 THEN 'coverage ' || format('{:.2f}', round(coverage, 2)) || ' < 1.0' END, CASE WHEN fraction < 0.75 THEN 'fraction ' || format('{:.2f}', round(fraction, 2)) || ' < 0.75' END,
  CASE WHEN dispersion > 5 THEN 'dispersion ' || format('{:.2f}', round(dispersion, 2)) || ' > 5.0' END, CASE WHEN containment < 0.5 THEN 'containment ' || format('{:.2f}', round(containment, 2)) || ' < 0.5' END, CASE WHEN p < 0.05 THEN 'enzymes disagree (p=' || format('{:.2g}', p) || ')' END,
  CASE WHEN fit_rate < 0.8 THEN 'only ' || coalesce(k, 0) || '/' || n_attempted || ' enzymes produced a fit' END, CASE WHEN ori_confidence < 0.25 THEN 'ori_confidence ' || format('{:.2f}', round(ori_confidence, 2)) || ' < 0.25' END, CASE WHEN log2_ptr IS NULL THEN 'no PTR estimate' END) AS reason FROM whole)""",
    (*Q.EST, FITS_SQL, FIT_FUSE_SQL, Q.TABLE_SQL, OUTPUT_SQL),
)
def output_assemble(spark, d):
    """The 28 columns of the output table, assembled from fits of which some failed."""
    e, h = X.estimates(spark, d), F.col("genome_id") * 7 + F.col("enzyme") * 3 + F.length("sample")
    fits = e.select(
        *Q.GROUP, (h % 6 != 0).alias("ok"), F.when(h % 12 == 0, "no downhill origin").otherwise("").alias("note"), F.col("est").alias("log2_ptr"), "se", "n_anchors", "r2", F.col("n").alias("n_windows_used"), F.when(h % 4 == 1, "v_shape_segmented").otherwise("v_shape").alias("method"),
        (h * 1234.5).alias("ori"), (h % 10 / 10.0).alias("ori_confidence"), (h % 5 / 2.0 + 0.3013).alias("mean_rate"), (h % 7 / 8.0 + 0.2013).alias("mean_fraction"), (h % 13 / 2.0 + 0.0013).alias("mean_dispersion"),
    )
    n = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("genome_id"), F.col("n_name").alias("genome"), "n_regionkey")
    r = X.table(spark, d, "region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("taxonomy"))
    held = e.select("sample", "genome_id").distinct().where("genome_id % 3 > 0").withColumn("containment", (F.col("genome_id") * 5 + F.length("sample")) % 9 / 9.0)
    out = report.assemble(fits, n.join(r, "n_regionkey", "left"), held, gates={"min_ori_confidence": 0.25})
    kinds = dict(out.dtypes)
    return out.select(*[F.round(F.col(f"`{c}`"), 5 if c == "enzyme_i2" else 6).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in OUTPUT_COLUMNS])


DELTA_P_SQL = f"dp AS (SELECT *, CASE WHEN z IS NOT NULL THEN {erfc_sql('(abs(z) / sqrt(2))')} END AS p FROM ({Q.DELTA_SQL.format(where="WHERE sample = 'click'", other="WHERE f.sample <> 'click'").replace('5) AS z', '12) AS z')}))"


@query("SELECT sample, genome_id, delta, delta_se, round(z, 5) AS z, fold, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q FROM (SELECT *, row_number() OVER (ORDER BY p NULLS LAST) AS rk, count(p) OVER () AS m FROM dp)", (*Q.FUSED, DELTA_P_SQL))
def delta_pvalues(spark, d):
    out = Y.delta(Q.ptr(spark, d), F.col("sample") == "click").withColumn("p", S.z_pvalue("z"))
    return Y.benjamini_hochberg(out, "p").select(*Q.BY, *Q.r6("delta", "delta_se", "fold", "p", "q"), F.round("z", 5).alias("z"))


@query(
    f"SELECT sample, genome_id, n, round(slope, 6) AS slope, round(slope_se, 6) AS slope_se, round(t, 4) AS t, round({t_sql('t', '(n - 2)')}, 6) AS p FROM (SELECT *, slope / nullif(slope_se, 0) AS t FROM (SELECT *, sqrt(greatest(sse, 0) / (n - 2) / sxx) AS slope_se FROM ("
    + Q.fit_sql("enzyme", "est", "(1 / (se * se))", "sample, genome_id", "(SELECT * FROM estimates WHERE est IS NOT NULL AND se > 0)")
    + ") WHERE n >= 3))",
    Q.EST,
)
def trend_test(spark, d):
    t = Y.trend(X.estimates(spark, d).withColumnRenamed("est", "log2_ptr").withColumnRenamed("n", "m"), "enzyme", Q.BY)
    t = t.withColumn("p", S.t_pvalue("t", (F.col("n") - 2).cast("double")))
    return t.select(*Q.BY, "n", *Q.r6("slope", "slope_se", "p"), F.round("t", 4).alias("t"))
