"""The catalog's queries as ANSI SQL for an independent engine, on the same tables."""

from __future__ import annotations

# Fixed values, written out here on purpose: a wrong list in the code under test must not agree with itself.
MILEAGE, MAINTENANCE, RATIO = "mileage_km", "maintenance_cost_annual", "efficiency"
ORIGINAL_FEATURES = ("co2_emissions_g_per_km", "cost_per_km", "energy_storage_capacity", "acceleration_0_100_kph_sec",
                     "torque_Nm", "lifespan_years", "maintenance_cost_annual")
OLS, RIDGE, LASSO = "Linear Regression", "Ridge Regression", "Lasso Regression"
COARSE_POWERS = (-2.0, -1.75, -1.5, -1.25, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0)
SCALED = ("torque_Nm", "energy_storage_capacity", "lifespan_years")

_KEY = ("md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        "CAST(round(l_extendedprice * 100) AS BIGINT)))")

UNITS_CTE = f"""units AS (
  SELECT l_linestatus AS cohort, {_KEY} AS row_key,
         l_extendedprice AS mileage_km, l_quantity AS energy_consumption,
         c_acctbal AS co2_emissions_g_per_km, l_tax + 0.0 AS cost_per_km,
         l_discount + 0.0 AS energy_storage_capacity, CAST(p_size AS DOUBLE) AS acceleration_0_100_kph_sec,
         p_retailprice AS "torque_Nm", CAST(l_linenumber AS DOUBLE) AS lifespan_years,
         o_totalprice AS maintenance_cost_annual
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey)"""

DERIVED_CTE = UNITS_CTE + """,
derived AS (
  SELECT * REPLACE (CASE WHEN co2_emissions_g_per_km < 0 THEN 0 ELSE co2_emissions_g_per_km END AS co2_emissions_g_per_km),
         mileage_km / nullif(energy_consumption, 0) AS efficiency
  FROM units)"""

_EVENTS = "(SELECT event_type AS cohort, md5(CAST(event_id AS VARCHAR)) AS row_key, value FROM events)"


def _bucket(start: int, buckets: int) -> str:
    return f"CAST(concat('0x', substr(row_key, {start}, 8)) AS BIGINT) % {buckets}"


def _inside(column: str) -> str:
    return f"{column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"


def prepared_cte(target: str) -> str:
    return DERIVED_CTE + f""",
fences AS (SELECT quantile_cont({target}, 0.25) AS q1, quantile_cont({target}, 0.75) AS q3 FROM derived),
prepared AS (
  SELECT derived.*, CASE WHEN {_bucket(1, 100)} < 20 THEN 'test' ELSE 'train' END AS split,
         CAST({_bucket(9, 5)} AS INTEGER) AS fold
  FROM derived, fences WHERE {_inside(target)})"""


def _code(column: str) -> str:
    low, high = f"min_{column}", f"max_{column}"
    steps = " + ".join(f"CASE WHEN {column} > {low} + {k}.0 * (({high} - {low}) / 5.0) THEN 1 ELSE 0 END" for k in range(1, 5))
    return f"CASE WHEN {column} IS NULL THEN -1 WHEN {low} = {high} THEN 2 ELSE {steps} END"


def _when(electric: bool, expression: str) -> str:
    return f"CASE WHEN cohort {'=' if electric else '<>'} 'F' THEN {expression} END"


_T, _CO2, _E = '"torque_Nm"', "co2_emissions_g_per_km", "energy_storage_capacity"
_A, _M, _K, _L = "acceleration_0_100_kph_sec", "maintenance_cost_annual", "cost_per_km", "lifespan_years"


def _div(a: str, b: str) -> str:
    return f"{a} / nullif({b}, 0)"


ENGINEERED = {
    "power_efficiency": _div(_T, _A), "storage_per_torque": _div(_E, _T), "cost_efficiency": _div(_K, _T),
    "maintenance_per_year": _div(_M, _L), "maintenance_per_torque": _div(_M, _T), "lifespan_torque_ratio": f"{_L} * {_T}",
    "eco_efficiency": _when(True, _div("1.0::DOUBLE", f"({_CO2} + 1.0)")),
    "green_performance": _when(True, _div(_T, f"({_CO2} + 1.0)")),
    "emission_intensity": _when(False, _div(_CO2, _T)), "emission_per_storage": _when(False, _div(_CO2, _E)),
    "torque_category_num": _code("torque_Nm"), "acceleration_category_num": _code(_A),
    "torque_squared": f"{_T} * {_T}", "acceleration_squared": f"{_A} * {_A}", "cost_squared": f"{_K} * {_K}",
    "torque_x_lifespan": f"{_T} * {_L}", "cost_x_maintenance": f"{_K} * {_M}", "storage_x_lifespan": f"{_E} * {_L}",
    "log_maintenance": f"ln(1 + {_M})", "log_torque": f"ln(1 + {_T})", "log_storage": f"ln(1 + {_E})",
    "normalized_torque": _div(_T, "max_torque_Nm"), "normalized_cost": _div(_K, f"max_{_K}"),
    "normalized_maintenance": _div(_M, f"max_{_M}"),
}


def candidates(target: str) -> list[str]:
    """Originals, the ratio and the engineered features, without the target."""
    return [n for n in (*ORIGINAL_FEATURES, RATIO, *ENGINEERED) if n != target]


def engineered_cte(target: str) -> str:
    ranged = ("torque_Nm", _A, _K, _M)
    bounds = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ranged)
    columns = ", ".join(f"{sql} AS {name}" for name, sql in ENGINEERED.items())
    return prepared_cte(target) + f""",
ranges AS (SELECT cohort, {bounds} FROM prepared GROUP BY cohort),
engineered AS (SELECT prepared.*, {columns} FROM prepared JOIN ranges USING (cohort))"""


def _stack(source: str, names, extra: str = "") -> str:
    """(cohort, extra, feature, value) rows, missing values included."""
    cells = ", ".join(f"{{'feature': '{n}', 'value': CAST({n} AS DOUBLE)}}" for n in names)
    return f"SELECT cohort{extra}, unnest([{cells}], recursive := true) FROM {source}"


def _r(expression: str, digits: int, name: str | None = None) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


def _number(expression: str) -> str:
    return f"CASE WHEN isfinite({expression}) THEN {expression} END"


def _pairs(source: str, names) -> str:
    """Correlations of every pair a < b; NULL where undefined."""
    cells = ", ".join(
        f"{{'a': '{a}', 'b': '{b}', 'n': regr_count({a}, {b}), 'corr': corr({a}, {b})}}"
        for i, a in enumerate(names) for b in names[i + 1:])
    return (f"SELECT cohort, a, b, CAST(n AS BIGINT) AS n, {_number('corr')} AS corr FROM "
            f"(SELECT cohort, unnest([{cells}], recursive := true) FROM {source} GROUP BY cohort)")


def _target_correlations(target: str) -> str:
    """CTE chain ending in tc(cohort, feature, corr)."""
    names = candidates(target)
    cells = ", ".join(f"{{'feature': '{n}', 'corr': corr({n}, {target})}}" for n in names)
    return engineered_cte(target) + f""",
tc AS (SELECT cohort, feature, {_number('corr')} AS corr FROM
  (SELECT cohort, unnest([{cells}], recursive := true) FROM engineered GROUP BY cohort))"""


def _selection(target: str) -> str:
    """CTE chain ending in picked(cohort, feature, position)."""
    names = candidates(target)
    originals = [n for n in ORIGINAL_FEATURES if n != target]
    ranks = ", ".join(f"('{n}', {i + 1})" for i, n in enumerate(originals))
    return _target_correlations(target) + f""",
stacked AS ({_stack('engineered', names)}),
medians AS (SELECT cohort, feature, median(value) AS fill FROM stacked GROUP BY ALL),
variances AS (SELECT cohort, feature, var_pop(coalesce(value, fill)) AS variance
              FROM stacked JOIN medians USING (cohort, feature) GROUP BY ALL),
ranked AS (
  SELECT cohort, feature, row_number() OVER (PARTITION BY cohort ORDER BY round(abs(corr), 12) DESC, feature) AS pos
  FROM tc JOIN variances USING (cohort, feature)
  WHERE abs(corr) > CASE WHEN cohort = 'F' THEN 0.02 ELSE 0.03 END AND variance > 0.01),
pairs AS ({_pairs('engineered', names)}),
close AS (SELECT cohort, a AS feature, b AS other FROM pairs WHERE abs(corr) >= 0.85
          UNION ALL SELECT cohort, b, a FROM pairs WHERE abs(corr) >= 0.85),
walk_input AS (
  SELECT r.cohort, r.feature, r.pos, coalesce(list(c.other) FILTER (WHERE c.other IS NOT NULL), []::VARCHAR[]) AS near
  FROM ranked r LEFT JOIN close c ON c.cohort = r.cohort AND c.feature = r.feature GROUP BY ALL),
walk AS (
  SELECT cohort, pos, [feature] AS kept FROM walk_input WHERE pos = 1
  UNION ALL
  SELECT i.cohort, i.pos, CASE WHEN len(w.kept) < 20 AND len(list_intersect(w.kept, i.near)) = 0
                               THEN list_append(w.kept, i.feature) ELSE w.kept END
  FROM walk w JOIN walk_input i ON i.cohort = w.cohort AND i.pos = w.pos + 1),
final AS (SELECT cohort, arg_max(kept, pos) AS kept FROM walk GROUP BY cohort),
picked AS (
  SELECT cohort, unnest(kept) AS feature, generate_subscripts(kept, 1) AS position FROM final
  UNION ALL
  SELECT c.cohort, o.feature, o.position
  FROM (SELECT DISTINCT cohort FROM engineered) c, (VALUES {ranks}) o(feature, position)
  WHERE c.cohort NOT IN (SELECT cohort FROM final))"""


# --- single-feature linear models --------------------------------------------

def _slope(kind: str, alpha: str, scaler: str) -> str:
    """Closed-form slope from sxx, sxy, n and the size of the scaled unit."""
    size = {"none": "1.0", "minmax": "(hi - lo)", "standard": "sqrt(sxx / n)"}[scaler]
    if kind == "lasso":
        pull, curve = f"(sxy / {size} / n)", f"(sxx / {size} / {size} / n)"
        return f"sign({pull}) * greatest(abs({pull}) - {alpha}, 0) / {curve} / {size}"
    return f"(sxy / {size}) / (sxx / {size} / {size} + {alpha if kind == 'ridge' else 0}) / {size}"


_SUMS = ("regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, count(*) AS n, min(x) AS lo, max(x) AS hi, "
         "avg(x) AS mx, avg(y) AS my")


def long_cte(target: str, features=None) -> str:
    names = features or [n for n in (*ORIGINAL_FEATURES, RATIO) if n != target]
    stacked = _stack("prepared", names, f", row_key, split, fold, {target} AS y")
    return prepared_cte(target) + f""",
long AS (SELECT cohort, row_key, split, fold, y, feature, value AS x FROM ({stacked}))"""


def _fit_ctes(tag: str, kind: str, alpha: str, scaler: str, extra: str = "", grid: str = "") -> str:
    """sums -> final and left-out-fold coefficients, then scores, as CTEs suffixed with ``tag``."""
    keys = f"cohort, feature{extra}"
    source = f"sums{grid}"
    return f""",
fit_{tag} AS (SELECT {keys}, fold AS out, {_slope(kind, alpha, scaler)} AS b, my, mx FROM {source}),
err_{tag} AS (
  SELECT l.cohort, l.feature{extra}, f.out, l.split, l.y, l.y - (f.my + f.b * (l.x - f.mx)) AS e
  FROM long l JOIN fit_{tag} f ON f.cohort = l.cohort AND f.feature = l.feature
  AND (f.out = -1 OR (f.out = l.fold AND l.split = 'train'))),
score_{tag} AS (
  SELECT {keys}, out, split, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
         1 - sum(e * e) / (var_pop(y) * count(*)) AS r2
  FROM err_{tag} GROUP BY ALL)"""


SUMS_CTE = f""",
folds AS (SELECT -1 AS out UNION ALL SELECT DISTINCT fold FROM long),
sums AS (SELECT cohort, feature, out AS fold, {_SUMS} FROM long, folds WHERE split = 'train' AND fold <> out GROUP BY ALL)"""


def _two_features(penalty: float, cohort: str) -> str:
    """Mileage on the ratio and the unit cost by Cramer's rule; the penalty acts on features scaled to their ranges."""
    return f"""WITH {prepared_cte(MILEAGE)},
rows AS (SELECT {cohort} AS cohort, split, efficiency AS a, cost_per_km AS b, mileage_km AS y FROM prepared),
moments AS (
  SELECT cohort, avg(a) AS ma, avg(b) AS mb, avg(y) AS my,
         regr_sxx(a, a) + {penalty} * pow(max(a) - min(a), 2) AS aa, regr_sxx(b, b) + {penalty} * pow(max(b) - min(b), 2) AS bb,
         regr_sxy(a, b) AS ab, regr_sxy(y, a) AS ay, regr_sxy(y, b) AS yb
  FROM rows WHERE split = 'train' GROUP BY cohort),
fit AS (SELECT cohort, ma, mb, my, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM moments),
errors AS (SELECT cohort, wa, wb, my - wa * ma - wb * mb AS w0, y, y - (my + wa * (a - ma) + wb * (b - mb)) AS e
           FROM rows JOIN fit USING (cohort) WHERE split = 'test')
SELECT cohort, {_r('any_value(w0)', 4, 'intercept')}, {_r('any_value(wa)', 6, 'slope_ratio')}, {_r('any_value(wb)', 4, 'slope_cost')},
       {_r('avg(abs(e))', 6, 'test_mae')}, {_r('1 - sum(e * e) / (var_pop(y) * count(*))', 6, 'test_r2')}
FROM errors GROUP BY cohort"""


def _results_cte(tag: str, target: str, label: str = "feature", variant: str = "base") -> str:
    return f""",
results_{tag} AS (
  SELECT '{target}' AS target, cohort, {label} AS model, '{variant}' AS variant,
         avg(mae) FILTER (WHERE out >= 0) AS base_cv_mae_mean, stddev_pop(mae) FILTER (WHERE out >= 0) AS base_cv_mae_std,
         max(mae) FILTER (WHERE out = -1 AND split = 'train') AS train_mae,
         max(r2) FILTER (WHERE out = -1 AND split = 'train') AS train_r2,
         max(mae) FILTER (WHERE out = -1 AND split = 'test') AS test_mae,
         max(rmse) FILTER (WHERE out = -1 AND split = 'test') AS test_rmse,
         max(r2) FILTER (WHERE out = -1 AND split = 'test') AS test_r2
  FROM score_{tag} GROUP BY ALL)"""


def results_cte(target: str = MILEAGE, tuned: bool = False) -> str:
    """CTE chain ending in results(target, cohort, model, variant, metrics...)."""
    text = long_cte(target) + SUMS_CTE + _fit_ctes("base", "ols", "0", "none") + _results_cte("base", target)
    if tuned:
        text += _fit_ctes("tuned", "ridge", "1000.0", "minmax") + _results_cte("tuned", target, "'Tuned ' || feature", "tuned")
        return text + ",\nresults AS (SELECT * FROM results_base UNION ALL SELECT * FROM results_tuned)"
    return text + ",\nresults AS (SELECT * FROM results_base)"


def _all_targets(body: str) -> str:
    """Results of all targets, each in its own subquery."""
    parts = " UNION ALL ".join(f"SELECT * FROM (WITH {results_cte(t)} SELECT * FROM results)" for t in (MILEAGE, MAINTENANCE, RATIO))
    return f"WITH results AS ({parts}) {body}"


def scaler_cte() -> str:
    """CTE chain ending in results(cohort, scaler, model, metrics...) of penalties by scaler on one feature."""
    text = long_cte(MILEAGE, [RATIO]) + SUMS_CTE
    parts = []
    for scaler, shown in (("minmax", "MinMaxScaler"), ("standard", "StandardScaler"), ("none", "NoScaling")):
        for kind, model in (("ols", OLS), ("ridge", RIDGE), ("lasso", LASSO)):
            tag = f"{kind}_{scaler}"
            text += _fit_ctes(tag, kind, "1.0", scaler)
            parts.append(f"""
  SELECT cohort, '{shown}' AS scaler, '{model}' AS model,
         max(mae) FILTER (WHERE out = -1 AND split = 'test') AS test_mae,
         max(rmse) FILTER (WHERE out = -1 AND split = 'test') AS test_rmse,
         max(r2) FILTER (WHERE out = -1 AND split = 'test') AS test_r2,
         avg(mae) FILTER (WHERE out >= 0) AS cv_mae_mean, stddev_pop(mae) FILTER (WHERE out >= 0) AS cv_mae_std,
         CAST(max(n) FILTER (WHERE out = -1 AND split = 'test') + max(n) FILTER (WHERE out = -1 AND split = 'train') AS BIGINT) AS n_samples
  FROM score_{tag} GROUP BY cohort""")
    return text + ",\nresults AS (" + " UNION ALL ".join(parts) + ")"


_PENALISED = f"(SELECT * FROM results WHERE model IN ('{RIDGE}', '{LASSO}'))"


def _rank(by: str = "test_r2 DESC NULLS LAST") -> str:
    return f"row_number() OVER (PARTITION BY target, cohort ORDER BY {by}, model)"


def _sides(metrics, digits: int, where: str = "TRUE") -> str:
    columns = ", ".join(_r(f"{side}.{m}", digits, f"{m}_{tag}") for side, tag in (("a", "first"), ("b", "second")) for m in metrics)
    return f"SELECT a.model, {columns} FROM results a JOIN results b ON a.model = b.model WHERE a.cohort = 'F' AND b.cohort = 'O' AND {where}"


def _histogram(source: str, column: str, bins: int) -> str:
    """CTE chain ending in hist(cohort, bin, low, high, n, density)."""
    return f"""vals AS (SELECT cohort, {column} AS v FROM {source} WHERE {column} IS NOT NULL),
ends AS (SELECT cohort, min(v) AS a, max(v) AS b, count(*) AS total FROM vals GROUP BY cohort),
bounds AS (SELECT cohort, total, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM ends),
placed AS (
  SELECT cohort, CAST(least(floor((v - lo) * {bins}.0 / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS hits
  FROM vals JOIN bounds USING (cohort) GROUP BY ALL),
hist AS (
  SELECT w.cohort, CAST(k AS INTEGER) AS bin, lo + k * width AS low, lo + (k + 1) * width AS high, coalesce(hits, 0) AS n,
         coalesce(hits, 0)::DOUBLE / (total * width) AS density
  FROM (SELECT *, (hi - lo) / {bins}.0 AS width FROM bounds) w CROSS JOIN range({bins}) r(k)
  LEFT JOIN placed p ON p.cohort = w.cohort AND p.bin = k)"""


def _yeo_johnson(x: str, p: str) -> str:
    return (f"CASE WHEN {x} >= 0 AND {p} = 0 THEN ln({x} + 1) WHEN {x} >= 0 THEN (pow({x} + 1, {p}) - 1) / {p} "
            f"WHEN {p} = 2 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {p}) - 1) / (2 - {p}) END")


def _likelihood_cte() -> str:
    powers = ", ".join(f"({p})" for p in COARSE_POWERS)
    return f"""{UNITS_CTE},
cells AS (SELECT cohort, feature, value AS x, CAST(p AS DOUBLE) AS power FROM ({_stack('units', SCALED)}), (VALUES {powers}) g(p)),
lik AS (SELECT cohort, feature, power,
  -count(x) / 2.0 * ln(var_pop({_yeo_johnson('x', 'power')})) + (power - 1) * sum(sign(x) * ln(1 + abs(x))) AS loglik
  FROM cells GROUP BY cohort, feature, power)"""


_LINES = f"""lines AS (SELECT l_linestatus AS cohort, {_KEY} AS row_key, l_extendedprice AS mileage_km,
  l_quantity AS energy_consumption, l_extendedprice / nullif(l_quantity, 0) AS efficiency FROM lineitem),
fences AS (SELECT quantile_cont(efficiency, 0.25) AS q1, quantile_cont(efficiency, 0.75) AS q3 FROM lines),
kept AS (SELECT lines.* FROM lines, fences WHERE {_inside('efficiency')})"""


def _depth_two() -> str:
    """Trees of two levels over eight equally wide bins, by trying every split in plain SQL; six fits by cohort (-1: all rows)."""
    code = lambda k: " + ".join(f"CASE WHEN x{k} > low{k} + {b} * ((high{k} - low{k}) / 8.0) THEN 1 ELSE 0 END" for b in range(1, 8))
    fit = "cohort, left_out"

    def level(source: str, node: str, out: str) -> str:
        cells = " UNION ALL ".join(f"SELECT {fit}, {node} AS node, {k} AS f, c{k} AS b, g FROM {source} WHERE learn" for k in (0, 1))
        over = f"PARTITION BY {fit}, node, f"
        return f"""
h{out} AS (SELECT {fit}, node, f, b, count(*) AS n, sum(g) AS s FROM ({cells}) GROUP BY ALL),
l{out} AS (SELECT {fit}, node, f, b, sum(n) OVER ({over} ORDER BY b) AS nl, sum(s) OVER ({over} ORDER BY b) AS sl, sum(n) OVER ({over}) AS n, sum(s) OVER ({over}) AS s FROM h{out}),
p{out} AS (SELECT {fit}, node, f, b FROM l{out} WHERE nl < n QUALIFY row_number() OVER (PARTITION BY {fit}, node
  ORDER BY round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, 3) DESC, f, b) = 1)"""

    return f"""
WITH {prepared_cte(MILEAGE)},
t AS (SELECT cohort, split, fold, mileage_km AS y, efficiency AS x0, cost_per_km AS x1 FROM prepared),
e AS (SELECT cohort, min(x0) AS low0, max(x0) AS high0, min(x1) AS low1, max(x1) AS high1 FROM t WHERE split = 'train' GROUP BY cohort),
r AS (SELECT cohort, split, fold, y, {code(0)} AS c0, {code(1)} AS c1, left_out, split = 'train' AND fold <> left_out AS learn
      FROM t JOIN e USING (cohort), (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS left_out)),
m AS (SELECT {fit}, avg(y) AS base FROM r WHERE learn GROUP BY ALL),
z AS MATERIALIZED (SELECT r.*, base, y - base AS g FROM r JOIN m USING ({fit})),{level("z", "0", "1")},
z1 AS MATERIALIZED (SELECT z.*, CASE WHEN (CASE WHEN f = 0 THEN c0 ELSE c1 END) > b THEN 1 ELSE 0 END AS side FROM z JOIN p1 USING ({fit})),{level("z1", "side", "2")},
z2 AS (SELECT z1.*, 2 * side + CASE WHEN (CASE WHEN f = 0 THEN c0 ELSE c1 END) > b THEN 1 ELSE 0 END AS leaf FROM z1 JOIN p2 ON z1.cohort = p2.cohort AND z1.left_out = p2.left_out AND z1.side = p2.node),
v AS (SELECT {fit}, leaf, avg(g) AS value FROM z2 WHERE learn GROUP BY ALL),
d AS (SELECT cohort, left_out, CASE WHEN left_out < 0 THEN split ELSE 'cv' END AS split, y, base + value - y AS error FROM z2 JOIN v USING ({fit}, leaf)
      WHERE left_out < 0 OR (split = 'train' AND fold = left_out))
SELECT cohort, left_out, split, count(*) AS n, {_r('avg(abs(error))', 4, 'mae')}, {_r('sqrt(avg(error * error))', 4, 'rmse')}, {_r('1 - avg(error * error) / var_pop(y)', 4, 'r2')}
FROM d GROUP BY ALL"""


def _part_models() -> str:
    """Normal equations of two features for every part, with each fold left out (-1: none), and their errors over the rows."""
    keyed = f"SELECT CAST(l_partkey AS VARCHAR) AS cohort, {_KEY} AS row_key, l_quantity AS y, l_tax + 0.0 AS a, l_discount + 0.0 AS b FROM lineitem"
    solved = ("(ga * hbb - gb * hab) / (haa * hbb - hab * hab)", "(gb * haa - ga * hab) / (haa * hbb - hab * hab)")
    return f"""
WITH t AS (SELECT *, CASE WHEN {_bucket(1, 100)} < 20 THEN 'test' ELSE 'train' END AS split, CAST({_bucket(9, 5)} AS INTEGER) AS fold FROM ({keyed})),
o AS (SELECT DISTINCT cohort, unnest([-1, fold]) AS left_out FROM t WHERE split = 'train'),
x AS (SELECT t.*, left_out, CASE WHEN split = 'train' AND fold <> left_out THEN 'learn' WHEN split = 'test' AND left_out = -1 OR split = 'train' AND fold = left_out THEN 'held' END AS part
      FROM t JOIN o USING (cohort)),
s AS (SELECT cohort, left_out, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab,
      covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby, max(a) - min(a) AS ra, max(b) - min(b) AS rb FROM x WHERE part = 'learn' GROUP BY ALL),
h AS (SELECT *, 'ols' AS model, 1.0::DOUBLE AS ua, 1.0::DOUBLE AS ub, saa AS haa, sbb AS hbb, sab AS hab, say AS ga, sby AS gb FROM s
      UNION ALL SELECT *, 'ridge', ra, rb, saa / (ra * ra) + 1, sbb / (rb * rb) + 1, sab / (ra * rb), say / ra, sby / rb FROM s),
w AS (SELECT cohort, left_out, model, n, my, ma, mb, {solved[0]} / ua AS wa, {solved[1]} / ub AS wb FROM h),
e AS (SELECT w.*, part, y, y - my - wa * (a - ma) - wb * (b - mb) AS error FROM w LEFT JOIN x USING (cohort, left_out)),
g AS (SELECT cohort, model, left_out, n, my - wa * ma - wb * mb AS intercept, wa AS w_tax, wb AS w_discount, sqrt(avg(error * error) FILTER (part = 'learn')) AS train_rmse,
      1 - avg(error * error) FILTER (part = 'learn') / nullif(var_pop(y) FILTER (part = 'learn'), 0) AS train_r2, count(*) FILTER (part = 'held') AS held_n,
      sqrt(avg(error * error) FILTER (part = 'held')) AS held_rmse FROM e GROUP BY ALL)
SELECT cohort, model, CAST(left_out AS INTEGER) AS left_out, n, held_n, {", ".join(_r(f"{c} + 1e-8", 5, c) for c in ("intercept", "w_tax", "w_discount", "train_rmse", "train_r2", "held_rmse"))} FROM g"""


def _determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    terms = [f"({m[0][k]}) * ({_determinant([row[:k] + row[k + 1:] for row in m[1:]])})" for k in range(len(m))]
    return " - ".join([terms[0], terms[1]]) + (f" + {terms[2]}" if len(m) == 3 else "")


def _path(kind: str, features: dict[str, str]) -> str:
    """Solutions of every penalty from normal equations over features scaled to their ranges, with each fold left out (-1: none).

    Ridge by Cramer's rule. The lasso of two features takes the best of its seven possible shapes: none, one alone, both with either signs.
    """
    names = list(features)
    pairs = [(p, q) for k, p in enumerate(names) for q in names[k:]]
    entry = lambda p, q: f"h{min(p, q)}{max(p, q)}"
    moments = ", ".join([f"covar_pop({p}, {q}) / ((max({p}) - min({p})) * (max({q}) - min({q}))) AS {entry(p, q)}" for p, q in pairs]
                        + [f"covar_pop({p}, y) / (max({p}) - min({p})) AS g{p}, avg({p}) AS m{p}, max({p}) - min({p}) AS r{p}" for p in names])
    if kind == "ridge":
        penalties = "SELECT cohort, step, pow(10.0, 3 - 7.0 * step / 39) AS alpha FROM s, steps WHERE left_out = -1"
        matrix = [[entry(p, q) + (" + alpha / n" if p == q else "") for q in names] for p in names]
        swapped = lambda at: [[f"g{names[i]}" if k == at else row[k] for k in range(len(names))] for i, row in enumerate(matrix)]
        solved = "SELECT cohort, step, left_out, alpha, " + ", ".join(
            f"({_determinant(swapped(k))}) / ({_determinant(matrix)}) AS v{p}" for k, p in enumerate(names)) + " FROM s JOIN penalties USING (cohort)"
    else:
        penalties = f"SELECT cohort, step, greatest({', '.join(f'abs(g{p})' for p in names)}) * pow(1000.0, -step / 39.0) AS alpha FROM s, steps WHERE left_out = -1"
        alone = lambda p: f"sign(g{p}) * greatest(abs(g{p}) - alpha, 0) / h{p}{p}"
        shapes = ["{'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}", f"{{'a': {alone('a')}, 'b': 0.0::DOUBLE}}", f"{{'a': 0.0::DOUBLE, 'b': {alone('b')}}}"]
        for i in (1, -1):
            for j in (1, -1):
                ga, gb = f"(ga - alpha * {i})", f"(gb - alpha * {j})"
                shapes.append(f"{{'a': ({ga} * hbb - {gb} * hab) / (haa * hbb - hab * hab), 'b': ({gb} * haa - {ga} * hab) / (haa * hbb - hab * hab)}}")
        solved = f"""SELECT cohort, step, left_out, alpha, arg_min(v.a, loss) AS va, arg_min(v.b, loss) AS vb FROM (
  SELECT *, (haa * v.a * v.a + hbb * v.b * v.b) / 2 + hab * v.a * v.b - ga * v.a - gb * v.b + alpha * (abs(v.a) + abs(v.b)) AS loss
  FROM (SELECT *, unnest([{', '.join(shapes)}]) AS v FROM s JOIN penalties USING (cohort))) GROUP BY ALL"""
    formula = " + ".join(f"w{p} * {p}" for p in names)
    shown = ", ".join(_r(f"any_value(w{p})", 4, f"w_{column}") for p, column in features.items())
    return f"""WITH {prepared_cte(MILEAGE)},
steps AS (SELECT CAST(i AS INTEGER) AS step FROM range(40) r(i)),
x AS (SELECT cohort, left_out, split = 'train' AND fold <> left_out AS learn, mileage_km AS y, {", ".join(f"{column} AS {p}" for p, column in features.items())}
      FROM prepared, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS left_out) WHERE split = 'train' OR left_out = -1),
s AS (SELECT cohort, left_out, count(*) AS n, avg(y) AS my, {moments} FROM x WHERE learn GROUP BY ALL),
penalties AS ({penalties}),
solved AS ({solved}),
w AS (SELECT cohort, step, left_out, alpha, n, {", ".join(f"v{p} / r{p} AS w{p}" for p in names)}, my - {" - ".join(f"v{p} / r{p} * m{p}" for p in names)} AS w0
      FROM solved JOIN s USING (cohort, left_out)),
e AS (SELECT w.*, learn, y, y - (w0 + {formula}) AS error FROM w JOIN x USING (cohort, left_out))
SELECT cohort, step, CAST(left_out AS INTEGER) AS left_out, any_value(n) AS n, count(*) FILTER (NOT learn) AS held_n, {_r("any_value(alpha)", 6, "alpha")}, {shown},
       {_r("any_value(w0)", 3, "intercept")}, {_r("sqrt(avg(error * error) FILTER (learn))", 4, "train_rmse")}, {_r("sqrt(avg(error * error) FILTER (NOT learn))", 4, "held_rmse")},
       {_r("1 - avg(error * error) FILTER (NOT learn) / var_pop(y) FILTER (NOT learn)", 6, "held_r2")} FROM e GROUP BY cohort, step, left_out"""


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {"depth_two_trees": _depth_two(), "part_models": _part_models(),
                           "ridge_path": _path("ridge", {"a": RATIO, "b": "cost_per_km", "c": "energy_storage_capacity"}),
                           "lasso_path": _path("lasso", {"a": RATIO, "b": "cost_per_km"})}
    # projections, filters, distributions
    sql["ratio_target"] = f"WITH {_LINES} SELECT cohort, row_key, efficiency FROM lines"
    sql["clamp_lower"] = f"WITH {DERIVED_CTE} SELECT cohort, row_key, co2_emissions_g_per_km FROM derived"
    sql["iqr_outliers"] = f"WITH {_LINES} SELECT cohort, row_key, efficiency FROM kept"
    sql["iqr_outliers_any"] = (
        f"SELECT e.* FROM {_EVENTS} e, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) "
        f"WHERE {_inside('value')}")
    sql["iqr_outliers_by_cohort"] = (
        f"SELECT e.* FROM {_EVENTS} e JOIN (SELECT event_type AS cohort, quantile_cont(value, 0.25) AS q1, "
        f"quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (cohort) WHERE {_inside('value')}")
    sql["sketched_quantiles"] = (
        "SELECT event_type AS cohort, 'value' AS feature, CAST(p AS DOUBLE) AS p, count(value) AS n, TRUE AS within "
        "FROM events, (VALUES (0.25), (0.5), (0.75)) q(p) GROUP BY 1, 3")
    sql["iqr_missing_column"] = "SELECT event_type AS cohort, count(*) AS n FROM events GROUP BY 1"
    sql["outlier_accounting"] = (
        f"WITH {_LINES} SELECT cohort, count(*) AS n_before, count(*) FILTER (WHERE {_inside('efficiency')}) AS n_kept, "
        f"count(*) - count(*) FILTER (WHERE {_inside('efficiency')}) AS n_removed FROM lines, fences GROUP BY cohort")
    sql["prepared_rows"] = (
        f"WITH {prepared_cte(RATIO)} SELECT cohort, row_key, {', '.join(ORIGINAL_FEATURES)}, efficiency FROM prepared")
    sql["cohort_filter"] = f"WITH {_LINES} SELECT row_key, mileage_km, energy_consumption, efficiency FROM lines WHERE cohort = 'F'"
    sql["row_preview"] = f"WITH {_LINES} SELECT cohort, row_key, mileage_km, energy_consumption, efficiency FROM lines ORDER BY efficiency DESC, row_key LIMIT 10"
    describe = ("SELECT cohort, count(efficiency) AS n, avg(efficiency) AS mean, median(efficiency) AS median, "
                "stddev_samp(efficiency) AS std, min(efficiency) AS minimum, max(efficiency) AS maximum FROM kept GROUP BY cohort")
    sql["cohort_stats"] = (f"WITH {_LINES}, d AS ({describe}) SELECT cohort, n, "
                           + ", ".join(_r(c, 6) for c in ("mean", "median", "std", "minimum", "maximum")) + " FROM d")
    sql["cohort_counts"] = "SELECT l_linestatus AS cohort, count(*) AS n_rows, 9 AS n_columns FROM lineitem GROUP BY 1"
    bars = ", ".join(_r(c, 9) for c in ("low", "high", "density"))
    sql["histogram_density"] = f"WITH {_LINES}, {_histogram('kept', 'efficiency', 30)} SELECT cohort, bin, n, {bars} FROM hist"
    bars = ", ".join(_r(c, 6) for c in ("low", "high", "density", "mean", "median"))
    sql["target_distribution"] = (f"WITH {_LINES}, d AS ({describe}), {_histogram('kept', 'efficiency', 40)} "
                                  f"SELECT cohort, bin, hist.n, {bars} FROM hist JOIN d USING (cohort)")
    fenced = f"(SELECT e.* FROM {_EVENTS} e, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE {_inside('value')})"
    sql["overlaid_distribution"] = (f"WITH {_histogram(fenced, 'value', 35)} SELECT cohort, bin, "
                                    + ", ".join(_r(c, 6) for c in ("low", "high", "density")) + " FROM hist")
    sql["boxplot_stats"] = f"""WITH q AS (SELECT event_type AS cohort, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
      SELECT cohort, {_r('q1', 6)}, {_r('median', 6)}, {_r('q3', 6)},
      {_r(f"min(value) FILTER (WHERE {_inside('value')})", 6, 'whisker_low')},
      {_r(f"max(value) FILTER (WHERE {_inside('value')})", 6, 'whisker_high')},
      count(*) FILTER (WHERE NOT ({_inside('value')})) AS n_outliers
      FROM {_EVENTS} JOIN q USING (cohort) GROUP BY cohort, q1, median, q3"""
    means = f"SELECT feature, avg(value) FILTER (WHERE cohort = 'F') AS a, avg(value) FILTER (WHERE cohort = 'O') AS b FROM ({_stack('units', ORIGINAL_FEATURES)}) GROUP BY feature"
    sql["cohort_mean_gap"] = (f"WITH {UNITS_CTE}, m AS ({means}) SELECT feature, {_r('a', 6, 'mean_first')}, {_r('b', 6, 'mean_second')}, "
                              f"{_r('(a / b - 1) * 100', 6, 'pct_difference')}, CASE WHEN a > b THEN 'F' ELSE 'O' END AS higher FROM m")
    # features
    shown = ", ".join(_r(n, 9) if n.startswith("log_") else n for n in ENGINEERED)
    sql["engineered_features"] = f"WITH {engineered_cte(RATIO)} SELECT row_key, cohort, efficiency, {shown} FROM engineered"
    sql["equal_width_bins"] = (
        f"WITH {engineered_cte(RATIO)} SELECT cohort, feature, CAST(value AS INTEGER) AS code, count(*) AS n FROM "
        f"({_stack('engineered', ('torque_category_num', 'acceleration_category_num'))}) GROUP BY ALL")
    sql["max_normalised"] = (
        f"WITH {UNITS_CTE} SELECT row_key, \"torque_Nm\" / max(\"torque_Nm\") OVER (PARTITION BY cohort) AS normalized_torque, "
        "cost_per_km / max(cost_per_km) OVER (PARTITION BY cohort) AS normalized_cost, "
        "maintenance_cost_annual / max(maintenance_cost_annual) OVER (PARTITION BY cohort) AS normalized_maintenance FROM units")
    gappy = f"WITH {UNITS_CTE}, g AS (SELECT row_key, cohort, {_when(False, _div(_CO2, _E))} AS v, \"torque_Nm\" FROM units)"
    sql["median_impute"] = f"{gappy} SELECT row_key, {_r('coalesce(v, median(v) OVER (PARTITION BY cohort))', 6, 'emission_per_storage')}, \"torque_Nm\" FROM g"
    sql["mean_impute"] = f"{gappy} SELECT row_key, {_r('coalesce(v, avg(v) OVER (PARTITION BY cohort))', 4, 'emission_per_storage')}, \"torque_Nm\" FROM g"
    sql["missing_counts"] = (
        f"WITH {engineered_cte(RATIO)} SELECT cohort, feature, count(*) AS n_rows, count(*) - count(value) AS n_missing FROM "
        f"({_stack('engineered', candidates(RATIO))}) GROUP BY ALL")
    sql["train_test_split"] = f"WITH {_LINES} SELECT row_key, CASE WHEN {_bucket(1, 100)} < 20 THEN 'test' ELSE 'train' END AS split FROM lines"
    sql["kfold_assignment"] = f"WITH {_LINES} SELECT row_key, CAST({_bucket(9, 5)} AS INTEGER) AS fold FROM lines WHERE {_bucket(1, 100)} >= 20"
    over = "OVER (PARTITION BY cohort)"
    sql["minmax_scale"] = f"WITH {UNITS_CTE} SELECT row_key, " + ", ".join(
        f"({c} - min({c}) {over}) / (max({c}) {over} - min({c}) {over}) AS {c}" for c in SCALED) + " FROM units"
    sql["zscore_scale"] = f"WITH {UNITS_CTE} SELECT row_key, " + ", ".join(
        _r(f"({c} - avg({c}) {over}) / stddev_pop({c}) {over}", 8, c) for c in SCALED) + " FROM units"
    sql["yeo_johnson_grid"] = f"WITH {_likelihood_cte()} SELECT cohort, feature, power, {_r('loglik', 2)} FROM lik"
    sql["yeo_johnson_best"] = f"WITH {_likelihood_cte()} SELECT cohort, feature, arg_max(power, loglik) AS power FROM lik GROUP BY ALL"
    sql["onehot_cohort"] = f"WITH {_LINES} SELECT row_key, CAST(cohort = 'F' AS INTEGER) AS is_F, CAST(cohort = 'O' AS INTEGER) AS is_O FROM lines"
    # correlation and selection
    names = [*candidates(MILEAGE), MILEAGE]
    sql["correlation_pairs"] = f"WITH {engineered_cte(MILEAGE)}, p AS ({_pairs('engineered', names)}) SELECT cohort, a, b, n, {_r('corr', 6)} FROM p"
    sql["wide_correlation"] = f"""WITH e AS (SELECT CAST(label AS VARCHAR) AS cohort, vec_id, generate_subscripts(embedding, 1) - 1 AS i,
      CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      p AS (SELECT a.cohort, a.i, b.i AS j, count(*) AS n, corr(a.x, b.x) AS corr FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL)
      SELECT cohort, 'e' || lpad(CAST(i AS VARCHAR), 2, '0') AS a, 'e' || lpad(CAST(j AS VARCHAR), 2, '0') AS b, n, {_r(_number('corr'), 6, 'corr')} FROM p"""
    sql["tiled_correlation"] = sql["wide_correlation"]
    tc = f"WITH {_target_correlations(MAINTENANCE)}"
    sql["target_correlation"] = f"{tc} SELECT cohort, feature, {_r('corr', 8)} FROM tc"
    words = "array_to_string(list_transform(string_split(feature, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    sql["correlation_bars"] = f"{tc} SELECT cohort, feature, {words} AS label, CAST(sign(corr) AS INTEGER) AS sign FROM tc WHERE corr IS NOT NULL"
    sql["top_correlations"] = (
        f"{tc}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY round(corr, 12) DESC, feature) AS rank FROM tc WHERE corr IS NOT NULL) "
        f"SELECT cohort, feature, {_r('corr', 8)}, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
    limit = "CASE WHEN cohort = 'F' THEN 0.02 ELSE 0.03 END"
    sql["corr_strength_buckets"] = (
        f"{tc} SELECT cohort, count(*) FILTER (WHERE abs(corr) > 0.05) AS strong, "
        f"count(*) FILTER (WHERE abs(corr) > {limit} AND abs(corr) <= 0.05) AS moderate, "
        f"count(*) FILTER (WHERE abs(corr) <= {limit}) AS weak FROM tc GROUP BY cohort")
    sql["cohort_corr_compare"] = (
        f"{tc} SELECT feature, {_r('a.corr', 8, 'corr_first')}, {_r('b.corr', 8, 'corr_second')}, {_r('a.corr - b.corr', 8, 'gap')} "
        "FROM tc a JOIN tc b USING (feature) WHERE a.cohort = 'F' AND b.cohort = 'O'")
    square = [*ORIGINAL_FEATURES, RATIO]
    place = ", ".join(f"('{c}', {i})" for i, c in enumerate(square))
    sql["corr_lower_triangle"] = f"""WITH {prepared_cte(RATIO)}, p AS ({_pairs('prepared', square)}), names(name, k) AS (VALUES {place}),
      full_matrix AS (SELECT cohort, b AS "row", a AS col, corr FROM p UNION ALL
                      SELECT cohort, name, name, 1.0 FROM (SELECT DISTINCT cohort FROM prepared), names)
      SELECT cohort, "row", col, x.k AS i, y.k AS j, {_r('corr', 8)} FROM full_matrix JOIN names x ON x.name = "row" JOIN names y ON y.name = col"""
    chosen = _selection(RATIO)
    sql["variance_filter"] = f"WITH {chosen} SELECT cohort, feature, variance > 0.01 AS passes FROM variances WHERE variance IS NOT NULL".replace("WITH units", "WITH RECURSIVE units", 1)
    for name, target in (("feature_selection", MAINTENANCE), ("feature_selection_fallback", RATIO)):
        sql[name] = f"WITH RECURSIVE {_selection(target)} SELECT cohort, feature, CAST(position AS INTEGER) AS position FROM picked"
    sql["selected_features_file"] = sql["feature_selection_rounds"] = sql["feature_selection"]
    sql["feature_name_sets"] = (
        f"{tc}, n AS (SELECT feature, bool_or(cohort = 'F') AS f, bool_or(cohort = 'O') AS o FROM tc WHERE corr IS NOT NULL GROUP BY feature) "
        "SELECT feature, CASE WHEN f AND o THEN 'both' WHEN f THEN 'first_only' ELSE 'second_only' END AS membership FROM n")
    electric = ("eco_efficiency", "green_performance")
    combustion = ("emission_intensity", "emission_per_storage")
    listed = ", ".join(f"('{n}', {str(n in ORIGINAL_FEATURES).upper()}, {str(n not in combustion).upper()}, {str(n not in electric).upper()})"
                       for n in candidates(MAINTENANCE))
    sql["feature_summary"] = f"""WITH RECURSIVE {_selection(MAINTENANCE)}, names(feature, original, f, o) AS (VALUES {listed}),
      mine AS (SELECT cohort, names.* FROM (SELECT DISTINCT cohort FROM engineered), names WHERE CASE WHEN cohort = 'F' THEN f ELSE o END)
      SELECT cohort, count(*) AS candidates, count(*) FILTER (WHERE original) AS originals, count(*) FILTER (WHERE NOT original) AS engineered,
      count(picked.feature) AS selected FROM mine LEFT JOIN picked USING (cohort, feature) GROUP BY cohort"""
    # linear models
    for name, kind, alpha, scaler in (("ols_by_cohort", "ols", "0", "none"), ("ridge_by_cohort", "ridge", "1.0", "minmax"),
                                      ("lasso_by_cohort", "lasso", "1.0", "minmax")):
        sql[name] = (f"WITH {long_cte(MILEAGE)}{SUMS_CTE}{_fit_ctes('m', kind, alpha, scaler)} SELECT cohort, feature, "
                     f"{_r('my - b * mx', 4, 'intercept')}, {_r('b', 6, 'slope')} FROM fit_m WHERE out = -1")
    for name, penalty in (("ols_two_features", 0.0), ("ridge_two_features", 1.0)):
        for prefix, cohort in (("", "cohort"), ("pooled_", "'pooled'")):
            sql[prefix + name] = _two_features(penalty, cohort)
    one = f"WITH {long_cte(MILEAGE, [RATIO])}{SUMS_CTE}{_fit_ctes('m', 'ols', '0', 'none')}"
    sql["regression_metrics_by_split"] = f"{one} SELECT cohort, split, n, {_r('mae', 6)}, {_r('rmse', 6)}, {_r('r2', 6)} FROM score_m WHERE out = -1"
    sql["predicted_vs_actual_rows"] = (
        f"{one} SELECT row_key, {_r('y', 4, 'actual')}, {_r('my + b * (x - mx)', 4, 'predicted')}, {_r('y - (my + b * (x - mx))', 4, 'residual')} "
        "FROM long JOIN fit_m USING (cohort, feature) WHERE out = -1 AND split = 'test'")
    sql["cv_linear_scores"] = (
        f"{one} SELECT cohort, 'ols' AS model, count(*) AS folds, {_r('avg(mae)', 6, 'cv_mae_mean')}, "
        f"{_r('stddev_pop(mae)', 6, 'cv_mae_std')}, {_r('avg(r2)', 6, 'cv_r2_mean')} FROM score_m WHERE out >= 0 GROUP BY cohort")
    grid = """, grid AS (SELECT CAST(i AS INTEGER) AS candidate, pow(10.0, -4 + 7.0 * i / 19) AS alpha FROM range(20) t(i)),
sums_grid AS (SELECT * FROM sums, grid)"""
    for name, kind, shown in (("alpha_grid_search", "ridge", _r("avg(mae)", 4, "cv_mae")),
                              ("lasso_grid_search", "lasso", _r("avg(r2)", 8, "cv_r2"))):
        fits = _fit_ctes("g", kind, "alpha", "minmax", ", candidate", "_grid")
        fits = fits.replace("SELECT l.cohort, l.feature, candidate", "SELECT l.cohort, l.feature, f.candidate")
        sql[name] = f"WITH {long_cte(MILEAGE, [RATIO])}{SUMS_CTE}{grid}{fits} SELECT cohort, candidate, {shown} FROM score_g WHERE out >= 0 GROUP BY ALL"
    winners = []
    for kind, model in (("ridge", RIDGE), ("lasso", LASSO)):
        fits = _fit_ctes("g", kind, "alpha", "minmax", ", candidate", "_grid") + _fit_ctes("one", kind, "1.0", "minmax")
        fits = fits.replace("SELECT l.cohort, l.feature, candidate", "SELECT l.cohort, l.feature, f.candidate")
        for metric, first in (("mae", "mae"), ("r2", "-r2")):
            winners.append(f"""SELECT * FROM (WITH {long_cte(MILEAGE, [RATIO])}{SUMS_CTE}{grid}{fits},
tried AS (SELECT cohort, candidate, avg(mae) AS mae, avg(r2) AS r2 FROM score_g WHERE out >= 0 GROUP BY ALL),
won AS (SELECT cohort, arg_min(candidate, {first}) AS candidate, arg_min(mae, {first}) AS mae FROM tried GROUP BY cohort)
SELECT '{metric}' AS metric, w.cohort, '{model}' AS model, {_r('any_value(alpha)', 8, 'alpha')}, {_r('any_value(w.mae)', 4, 'tuned_cv_mae_mean')},
       {_r('(SELECT avg(o.mae) FROM score_one o WHERE o.out >= 0 AND o.cohort = w.cohort)', 4, 'base_cv_mae_mean')}, {_r('any_value(s.r2)', 6, 'test_r2')}
FROM won w JOIN grid USING (candidate) JOIN score_g s ON s.cohort = w.cohort AND s.candidate = w.candidate AND s.out = -1 AND s.split = 'test'
GROUP BY w.cohort)""")
    sql["search_winner"] = " UNION ALL ".join(winners)
    sql["pooled_ols"] = f"""WITH {long_cte(MILEAGE, [RATIO])}{SUMS_CTE},
      pooled AS (SELECT sum(sxy) / sum(sxx) AS b FROM sums WHERE fold = -1),
      e AS (SELECT l.split, l.y, l.y - (s.my + b * (l.x - s.mx)) AS e FROM long l JOIN sums s ON s.cohort = l.cohort AND s.fold = -1, pooled),
      m AS (SELECT split, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY split)
      SELECT {_r("a.mae", 6, "train_mae")}, {_r("a.r2", 6, "train_r2")}, {_r("b.mae", 6, "test_mae")}, {_r("b.rmse", 6, "test_rmse")}, {_r("b.r2", 6, "test_r2")}
      FROM m a, m b WHERE a.split = 'train' AND b.split = 'test'"""
    # result tables
    res = f"WITH {results_cte()}"
    metrics = ("base_cv_mae_mean", "base_cv_mae_std", "train_mae", "train_r2", "test_mae", "test_rmse", "test_r2")
    sql["feature_models"] = f"{res} SELECT target, cohort, model, {', '.join(_r(m, 6) for m in metrics)} FROM results"
    sql["model_ranking"] = f"{res} SELECT cohort, model, CAST({_rank()} AS INTEGER) AS rank FROM results"
    sql["model_ranking_by_mae"] = f"{res} SELECT cohort, model, CAST({_rank('test_mae NULLS LAST')} AS INTEGER) AS rank FROM results"
    ranked = f"{res}, ranked AS (SELECT *, CAST({_rank()} AS INTEGER) AS rank FROM results)"
    sql["topk_models"] = f"{ranked} SELECT cohort, model, rank, {_r('test_r2', 6)} FROM ranked WHERE rank <= 3"
    sql["best_models"] = f"{ranked} SELECT cohort, model, {_r('test_r2', 6)}, {_r('test_mae', 6)} FROM ranked WHERE rank = 1"
    sql["rankings_file"] = f"{ranked} SELECT target, cohort, model, {_r('test_r2', 6)}, rank FROM ranked WHERE rank = 1"
    both = f"WITH {results_cte(tuned=True)}"
    sql["append_tuned"] = f"{both} SELECT cohort, model, variant, {_r('test_r2', 6)} FROM results"
    sql["tuned_vs_base"] = f"""{both} SELECT t.target, t.cohort, b.model AS base_model, {_r('b.test_mae', 6, 'base_mae')}, {_r('t.test_mae', 6, 'tuned_mae')},
      {_r('b.test_r2', 6, 'base_r2')}, {_r('t.test_r2', 6, 'tuned_r2')}, {_r('b.test_mae - t.test_mae', 6, 'mae_gain')}, {_r('t.test_r2 - b.test_r2', 6, 'r2_gain')}
      FROM results t JOIN results b ON t.cohort = b.cohort AND t.model = 'Tuned ' || b.model"""
    sql["train_test_gap"] = f"{res} SELECT target, cohort, model, {_r('train_r2 - test_r2', 6, 'r2_gap')}, {_r('test_mae / nullif(train_mae, 0)', 6, 'mae_ratio')} FROM results"
    sql["model_cohort_pivot"] = f"{res} {_sides(('test_r2', 'test_mae'), 6)}"
    sql["cv_stability"] = f"{res} {_sides(('base_cv_mae_mean', 'base_cv_mae_std'), 6, 'a.base_cv_mae_std IS NOT NULL AND b.base_cv_mae_std IS NOT NULL')}"
    sql["predictable_cohort"] = _all_targets(
        f"SELECT target, arg_max(cohort, r) AS cohort, {_r('max(r)', 6, 'best_r2')}, {_r('max(r) - min(r)', 6, 'lead')} "
        "FROM (SELECT target, cohort, max(test_r2) AS r FROM results GROUP BY ALL) GROUP BY target")
    cells = ", ".join(f"max(model) FILTER (WHERE cohort = '{c}') AS {c}_model, "
                      + _r(f"max(test_r2) FILTER (WHERE cohort = '{c}')", 6, f"{c}_test_r2") + ", "
                      + _r(f"max(test_mae) FILTER (WHERE cohort = '{c}')", 6, f"{c}_test_mae") for c in ("F", "O"))
    sql["target_leaderboard"] = _all_targets(f"SELECT target, {cells} FROM (SELECT *, {_rank()} AS rank FROM results) WHERE rank = 1 GROUP BY target")
    sql["best_of_runs"] = _all_targets(f"SELECT target, cohort, target AS run, model, {_r('test_r2', 6)}, {_r('test_mae', 6)} FROM (SELECT *, {_rank()} AS rank FROM results) WHERE rank = 1")
    # scaler comparison
    sca = f"WITH {scaler_cte()}"
    sql["scaler_results"] = (f"{sca} SELECT cohort, scaler, model, "
                             + ", ".join(_r(m, 6) for m in ("test_mae", "test_rmse", "test_r2", "cv_mae_mean", "cv_mae_std")) + ", n_samples FROM results")
    sql["scaler_file"] = f"{sca} SELECT cohort, scaler, model, {_r('test_mae', 6)}, n_samples FROM results"
    cells = ", ".join(_r(f"{fn}({c})", 4, f"{c}_{name}") for c in ("test_r2", "test_mae")
                      for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    sql["scaler_summary"] = (f"{sca} SELECT cohort, scaler, {cells}, {_r('avg(cv_mae_mean)', 4, 'cv_mae_mean_mean')}, "
                             f"{_r('stddev_samp(cv_mae_mean)', 4, 'cv_mae_mean_std')} FROM {_PENALISED} GROUP BY cohort, scaler")
    sql["scaler_means"] = f"{sca} SELECT cohort, scaler, {_r('avg(test_r2)', 4, 'test_r2')}, {_r('avg(test_mae)', 4, 'test_mae')} FROM {_PENALISED} GROUP BY cohort, scaler"
    pick = lambda order, label: (f"SELECT cohort, '{label}' AS criterion, scaler || ' + ' || model AS combination, {_r('test_r2', 6)}, {_r('test_mae', 6)} FROM "
                                 f"(SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY {order}, scaler, model) AS place FROM {_PENALISED}) WHERE place = 1")
    sql["scaler_best"] = f"{sca} {pick('test_r2 DESC NULLS LAST', 'r2')} UNION ALL {pick('test_mae NULLS LAST', 'mae')}"
    sql["scaler_ranking"] = (f"{sca} SELECT cohort, scaler, CAST(row_number() OVER (PARTITION BY cohort ORDER BY m DESC, scaler) AS INTEGER) AS rank "
                             f"FROM (SELECT cohort, scaler, avg(test_r2) AS m FROM {_PENALISED} GROUP BY cohort, scaler)")
    sql["scaler_overall_best"] = (f"{sca} SELECT arg_max(scaler, r) AS best_by_r2, arg_min(scaler, m) AS best_by_mae FROM "
                                  f"(SELECT scaler, avg(test_r2) AS r, avg(test_mae) AS m FROM {_PENALISED} GROUP BY scaler)")
    sql["scaler_pivot"] = (f"{sca} SELECT scaler, " + ", ".join(_r(f"avg(test_r2) FILTER (WHERE cohort = '{c}')", 8, c) for c in ("F", "O"))
                           + f" FROM {_PENALISED} GROUP BY scaler")
    cells = ", ".join(_r(f"avg({m}) FILTER (WHERE scaler = '{s}')", 4, f"{s}_{m}") for s in ("MinMaxScaler", "NoScaling", "StandardScaler")
                      for m in ("test_r2", "test_mae", "cv_mae_mean"))
    sql["scaler_details"] = f"{sca} SELECT cohort, model, {cells} FROM {_PENALISED} GROUP BY cohort, model"
    # files
    sql["scaler_pivot_file"] = sql["scaler_details"]
    sql["importances_file"] = (
        f"WITH {long_cte(MILEAGE)}{SUMS_CTE}{_fit_ctes('m', 'ols', '0', 'none')} SELECT '{MILEAGE}' AS target, cohort, feature AS model, feature, "
        f"{_r('abs(b)', 6, 'importance')}, CAST(sign(b) AS INTEGER) AS sign FROM fit_m WHERE out = -1")
    sql["csv_scan"] = f"WITH {_LINES} SELECT cohort, row_key, mileage_km, energy_consumption FROM lines"
    sql["cohort_files"] = f"WITH {_LINES} SELECT cohort, row_key, efficiency FROM lines WHERE cohort = 'O'"
    return {name: text.strip() for name, text in sql.items()}
