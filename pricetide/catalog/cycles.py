"""Cycles and projections: each brand's monthly median unit price is one series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators.joins import align_cycles
from ..plans import cycles as C
from ..plans import forecast as P
from ..session import settle
from .base import PART_QUOTES_SQL, part_quotes, query, rounded

# The shared prices carry no real cycles, so reversals of 5 % count.
THRESHOLD = math.log(1.05)
ASOF, SINCE, MIN_RISE = "2001-06-01", "1995-01-01", 1.05
NORMAL, NOW = ("1996-01-01", "1997-12-31"), ("2001-04-01", "2001-06-30")
CAP = "2002-04-01"
TARGETS = {"1.0x": 1.0, "0.9x": 0.9, "0.8x": 0.8}


def brand_series(spark, folder):
    rows = A.monthly(part_quotes(spark, folder).withColumnRenamed("p_brand", "series"), ["series"], "day", "price")
    return settle(rows)  # a few rows per brand and month that every later step reads


def brand_cycles(series):
    return settle(C.cycle_table(series, THRESHOLD))


MONTHLY = f"""
  q AS ({PART_QUOTES_SQL}),
  m AS (SELECT p_brand AS series, month, quantile_cont(price, 0.5) AS value FROM q GROUP BY 1, 2)"""
ZIGZAG = f"""{MONTHLY},
  x AS (SELECT series, month AS t, ln(value) AS v, row_number() OVER (PARTITION BY series ORDER BY month) AS rn FROM m),
  z AS (
    SELECT series, rn, CAST(NULL AS VARCHAR) AS mode, t AS hi_t, v AS hi, t AS lo_t, v AS lo,
           CAST(NULL AS DATE) AS pt, CAST(NULL AS VARCHAR) AS pk FROM x WHERE rn = 1
    UNION ALL
    SELECT series, rn,
           CASE WHEN bottomed THEN 'up' WHEN topped THEN 'down' ELSE mode END,
           CASE WHEN bottomed THEN t ELSE nhi_t END, CASE WHEN bottomed THEN v ELSE nhi END,
           CASE WHEN NOT bottomed AND topped THEN t ELSE nlo_t END, CASE WHEN NOT bottomed AND topped THEN v ELSE nlo END,
           CASE WHEN bottomed THEN nlo_t WHEN topped THEN nhi_t END,
           CASE WHEN bottomed THEN 'T' WHEN topped THEN 'P' END
    FROM (SELECT *, coalesce(mode, '') <> 'up' AND v - nlo >= {THRESHOLD!r} AS bottomed,
                    coalesce(mode, '') <> 'down' AND nhi - v >= {THRESHOLD!r} AS topped
          FROM (SELECT x.series, x.rn, x.t, x.v, z.mode,
                       CASE WHEN coalesce(mode, '') <> 'down' AND v > hi THEN t ELSE hi_t END AS nhi_t,
                       CASE WHEN coalesce(mode, '') <> 'down' AND v > hi THEN v ELSE hi END AS nhi,
                       CASE WHEN coalesce(mode, '') <> 'up' AND v < lo THEN t ELSE lo_t END AS nlo_t,
                       CASE WHEN coalesce(mode, '') <> 'up' AND v < lo THEN v ELSE lo END AS nlo
                FROM z JOIN x ON x.series = z.series AND x.rn = z.rn + 1))
  ),
  pts AS (SELECT series, pt AS month, pk AS kind FROM z WHERE pk IS NOT NULL)"""


@query("turning_points", f"WITH RECURSIVE {ZIGZAG} SELECT series, month, kind FROM pts")
def turning_points(spark, folder):
    return C.turning_points(brand_series(spark, folder), THRESHOLD)


def _months(a: str, b: str) -> str:
    return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"


def _first_after(test: str) -> str:
    return f"(SELECT min(m.month) FROM m WHERE m.series = s.series AND m.month > s.peak AND {test})"


CYCLES = f"""{ZIGZAG},
  spans AS (SELECT p.series, p.month AS peak,
      (SELECT max(o.month) FROM pts o WHERE o.series = p.series AND o.kind = 'T' AND o.month < p.month) AS trough0,
      (SELECT min(o.month) FROM pts o WHERE o.series = p.series AND o.kind = 'T' AND o.month > p.month) AS trough1
    FROM pts p WHERE p.kind = 'P'),
  priced AS (SELECT s.*, a.value AS p_trough0, b.value AS p_peak, c.value AS p_trough1 FROM spans s
    JOIN m a ON a.series = s.series AND a.month = s.trough0 JOIN m b ON b.series = s.series AND b.month = s.peak
    LEFT JOIN m c ON c.series = s.series AND c.month = s.trough1),
  backs AS (SELECT s.*, {_first_after('m.value <= s.p_trough0')} AS b1, {_first_after('m.value <= 1.2 * s.p_trough0')} AS b2,
      {_first_after('ln(m.value / s.p_trough0) <= ln(s.p_peak / s.p_trough0) / 2')} AS hl FROM priced s),
  cyc AS (SELECT series, trough0, peak, trough1, p_trough0, p_peak, p_trough1, p_peak / p_trough0 AS rise_x,
      {_months('trough0', 'peak')} AS up_months, {_months('peak', 'b1')} AS back_months, {_months('peak', 'b2')} AS back_months_120,
      {_months('peak', 'hl')} AS half_life, {_months('peak', 'trough1')} AS fall_months,
      CASE WHEN {_months('peak', 'trough1')} > 0 THEN ln(p_peak / p_trough1) / {_months('peak', 'trough1')} END AS fall_rate FROM backs)"""


@query("cycle_table", f"""WITH RECURSIVE {CYCLES} SELECT series, trough0, peak, trough1, round(p_trough0, 6) AS p_trough0,
  round(p_peak, 6) AS p_peak, round(p_trough1, 6) AS p_trough1, round(rise_x, 6) AS rise_x, up_months, back_months,
  back_months_120, half_life, fall_months, round(fall_rate, 6) AS fall_rate FROM cyc""")
def cycle_table(spark, folder):
    cycles = C.cycle_table(brand_series(spark, folder), THRESHOLD)
    return rounded(cycles, 6, "p_trough0", "p_peak", "p_trough1", "rise_x", "fall_rate")


@query("cycle_alignment", f"""WITH RECURSIVE {CYCLES} SELECT c.series, c.trough0, c.peak, m.month,
  {_months('c.trough0', 'm.month')} AS months_since, round(m.value / c.p_trough0, 6) AS ratio
  FROM cyc c JOIN m ON m.series = c.series
   AND m.month BETWEEN c.trough0 AND coalesce(c.trough1, c.peak + INTERVAL 30 MONTH)""")
def cycle_alignment(spark, folder):
    series = brand_series(spark, folder)
    return rounded(align_cycles(series, C.cycle_table(series, THRESHOLD)), 6, "ratio")


DECAY = f"""{CYCLES},
  lvl AS (SELECT series, CAST(date_trunc('quarter', month) AS DATE) AS q, ln(avg(value)) AS l FROM m GROUP BY 1, 2),
  inc0 AS (SELECT series, q, l - lag(l) OVER (PARTITION BY series ORDER BY q) AS inc FROM lvl),
  inc AS (SELECT series, q, inc, lag(inc) OVER (PARTITION BY series ORDER BY q) AS prev FROM inc0 WHERE inc IS NOT NULL),
  ups AS (SELECT c.series, c.peak, c.p_trough0, c.back_months, i.q, i.inc,
      count(*) OVER (PARTITION BY c.series, c.peak) AS n,
      row_number() OVER (PARTITION BY c.series, c.peak ORDER BY i.inc DESC, i.q) AS rk
    FROM cyc c JOIN inc i ON i.series = c.series AND i.q > c.trough0
     AND i.q <= make_date(year(c.peak), 3 * quarter(c.peak), 1)),
  top AS (SELECT series, peak, p_trough0, back_months, q AS max_q, inc AS max_inc FROM ups WHERE rk = 1 AND n >= 2),
  stops AS (SELECT t.*, (SELECT min(i.q) FROM inc i WHERE i.series = t.series AND i.q > t.max_q AND i.inc <= 0) AS stop FROM top t),
  ratios AS (SELECT s.series, s.peak, i.q, i.inc / i.prev AS r FROM stops s JOIN inc i ON i.series = s.series
     AND i.q > s.max_q AND (s.stop IS NULL OR i.q < s.stop) AND s.max_inc > 0),
  timing AS (SELECT s.series, s.peak, s.p_trough0, s.back_months, s.max_q, s.max_inc,
      (year(s.peak) * 4 + quarter(s.peak)) - (year(s.max_q) * 4 + quarter(s.max_q)) AS lag_q,
      coalesce((SELECT arg_min(r, q) FROM ratios k WHERE k.series = s.series AND k.peak = s.peak), 0) AS decay_first,
      (SELECT count(*) FROM ratios k WHERE k.series = s.series AND k.peak = s.peak) AS n_ratios FROM stops s),
  pooled AS (SELECT series, peak, r FROM ratios UNION ALL SELECT series, peak, 0.0 FROM timing WHERE n_ratios = 0),
  fall AS (SELECT * FROM cyc WHERE peak >= DATE '{SINCE}' AND rise_x >= {MIN_RISE} AND fall_rate IS NOT NULL)"""


@query("upswing_decay", f"""WITH RECURSIVE {DECAY} SELECT series, peak, max_q, round(max_inc, 6) AS max_inc,
  CAST(date_trunc('quarter', peak) AS DATE) AS peak_q, lag_q, round(decay_first, 6) AS decay_first,
  CAST(n_ratios AS INTEGER) AS n_ratios FROM timing""")
def upswing_decay(spark, folder):
    series = brand_series(spark, folder)
    decay = C.upswing_decay(series, C.cycle_table(series, THRESHOLD))
    return rounded(decay.withColumn("n_ratios", F.size("decay_ratios")).drop("decay_ratios"), 6, "max_inc", "decay_first")


def learned(spark, folder):
    """Series, cycles, upswing timing and fall sample: a row per cycle, each written once."""
    series = brand_series(spark, folder)
    cycles = brand_cycles(series)
    timing = settle(C.upswing_decay(series, cycles, ["back_months"]))
    return series, cycles, timing, P.fall_sample(cycles, SINCE, MIN_RISE)


def fitted(timing, fall):
    """One row: quartiles of the decay ratio and of the fall rate, and the fastest fall."""
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    decay = P.param_quantiles(C.pooled_ratios(timing), "ratio", {f"decay_{k}": q for k, q in quartiles.items()})
    rates = P.param_quantiles(fall, "fall_rate", {**{f"fall_{k}": q for k, q in quartiles.items()}, "fall_max": 1.0})
    return A.attach(decay, rates)


PARAMS = f"""{DECAY},
  params AS (SELECT
    (SELECT quantile_cont(r, 0.25) FROM pooled) AS decay_q25, (SELECT quantile_cont(r, 0.5) FROM pooled) AS decay_q50,
    (SELECT quantile_cont(r, 0.75) FROM pooled) AS decay_q75, (SELECT quantile_cont(fall_rate, 0.25) FROM fall) AS fall_q25,
    (SELECT quantile_cont(fall_rate, 0.5) FROM fall) AS fall_q50, (SELECT quantile_cont(fall_rate, 0.75) FROM fall) AS fall_q75,
    (SELECT max(fall_rate) FROM fall) AS fall_max)"""
PARAM_NAMES = ["decay_q25", "decay_q50", "decay_q75", "fall_q25", "fall_q50", "fall_q75", "fall_max"]


@query("decay_params", f"WITH RECURSIVE {PARAMS} SELECT {', '.join(f'round({n}, 6) AS {n}' for n in PARAM_NAMES)} FROM params")
def decay_params(spark, folder):
    _, _, timing, fall = learned(spark, folder)
    return rounded(fitted(timing, fall), 6, *PARAM_NAMES)


@query("parameter_table", f"""WITH RECURSIVE {DECAY}
  SELECT 'fall' AS kind, series, peak, round(rise_x, 6) AS rise_x, round(fall_rate, 6) AS fall_rate, back_months,
         CAST(NULL AS DATE) AS max_q, NULL AS lag_q, CAST(NULL AS DOUBLE) AS decay_first FROM fall
  UNION ALL SELECT 'timing', series, peak, NULL, NULL, NULL, max_q, lag_q, round(decay_first, 6) FROM timing""")
def parameter_table(spark, folder):
    _, _, timing, fall = learned(spark, folder)
    rows = P.parameter_table(fall, timing)
    return rounded(rows, 6, "rise_x", "fall_rate", "decay_first")


@query("rank_corr", f"""WITH RECURSIVE {CYCLES},
  used AS (SELECT rise_x, fall_rate FROM cyc WHERE fall_rate IS NOT NULL),
  ranks AS (SELECT rank() OVER (ORDER BY rise_x) + (count(*) OVER (PARTITION BY rise_x) - 1) / 2.0 AS a,
                   rank() OVER (ORDER BY fall_rate) + (count(*) OVER (PARTITION BY fall_rate) - 1) / 2.0 AS b FROM used)
  SELECT count(*) AS n, round(corr(a, b), 6) AS rank_corr FROM ranks""")
def rank_corr(spark, folder):
    return rounded(A.rank_corr(brand_cycles(brand_series(spark, folder)), "rise_x", "fall_rate"), 6, "rank_corr")


@query("baseline_ratio", f"""WITH q AS ({PART_QUOTES_SQL}),
  m AS (SELECT p_brand AS series, month, quantile_cont(price, 0.5) AS value FROM q GROUP BY 1, 2),
  b AS (SELECT series, avg(value) FILTER (WHERE month BETWEEN DATE '{NORMAL[0]}' AND DATE '{NORMAL[1]}') AS normal,
               avg(value) FILTER (WHERE month BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}') AS now FROM m GROUP BY 1)
  SELECT series, round(normal, 6) AS normal, round(now, 6) AS now, round(now / normal, 6) AS ratio FROM b""")
def baseline_ratio(spark, folder):
    base = A.baseline_ratio(brand_series(spark, folder), ["series"], "month", "value", NORMAL, NOW)
    return rounded(base, 6, "normal", "now", "ratio")


def levels(series):
    """Each series' ratio to normal and its newest quarterly increment, known at ``ASOF``."""
    known = series.where(F.col("month") <= F.lit(ASOF).cast("date"))
    base = A.baseline_ratio(known, ["series"], "month", "value", NORMAL, NOW).select("series", F.col("ratio").alias("ratio_now"))
    return base.join(P.latest_increment(known), "series")


LEVELS = f"""{PARAMS},
  known AS (SELECT * FROM m WHERE month <= DATE '{ASOF}'),
  base AS (SELECT series, avg(value) FILTER (WHERE month BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}')
     / avg(value) FILTER (WHERE month BETWEEN DATE '{NORMAL[0]}' AND DATE '{NORMAL[1]}') AS ratio_now FROM known GROUP BY 1),
  klvl AS (SELECT series, CAST(date_trunc('quarter', month) AS DATE) AS q, ln(avg(value)) AS l FROM known GROUP BY 1, 2),
  kinc AS (SELECT series, q, l - lag(l) OVER (PARTITION BY series ORDER BY q) AS inc FROM klvl),
  last AS (SELECT series, max(q) AS last_q, arg_max(inc, q) AS last_inc FROM kinc WHERE inc IS NOT NULL GROUP BY 1),
  scen AS (SELECT b.series, b.ratio_now, l.last_q, l.last_inc, s.scenario, s.decay_ratio, s.fall_rate, s.cap
    FROM base b JOIN last l USING (series), params p, LATERAL (VALUES
      ('fast', p.decay_q25, p.fall_q75, CAST(NULL AS DATE)), ('base', p.decay_q50, p.fall_q50, NULL),
      ('slow', p.decay_q75, p.fall_q25, DATE '{CAP}'), ('crash', 0.0, p.fall_max, NULL)) s(scenario, decay_ratio, fall_rate, cap)),
  walk AS (SELECT series, scenario, cap, decay_ratio, last_q AS q, last_inc AS step, CAST(0 AS DOUBLE) AS total FROM scen
    UNION ALL SELECT series, scenario, cap, decay_ratio, CAST(q + INTERVAL 3 MONTH AS DATE), step * decay_ratio, total + step * decay_ratio
      FROM walk WHERE step * decay_ratio >= 0.02 AND (cap IS NULL OR q + INTERVAL 3 MONTH <= cap)),
  path AS (SELECT s.series, s.scenario, s.ratio_now, s.decay_ratio, s.fall_rate, max(w.q) AS peak_q, arg_max(w.total, w.q) AS further_rise
    FROM scen s JOIN walk w ON w.series = s.series AND w.scenario = s.scenario GROUP BY ALL),
  peaks AS (SELECT *, greatest(CAST(peak_q + INTERVAL 1 MONTH AS DATE), CAST(DATE '{ASOF}' + INTERVAL 1 MONTH AS DATE)) AS peak,
      ratio_now * exp(further_rise) AS peak_ratio FROM path)"""


@query("decay_path", f"""WITH RECURSIVE {LEVELS} SELECT series, scenario, peak_q, round(further_rise, 6) AS further_rise FROM path""")
def decay_path(spark, folder):
    series, _, timing, fall = learned(spark, folder)
    rows = A.attach(levels(series), fitted(timing, fall))
    rows = P.cross_scenarios(rows, P.standard_scenarios(CAP))
    path = P.decay_path(rows, "last_inc", "decay_ratio", "last_q", "cap")
    return rounded(path.select("series", "scenario", "peak_q", "further_rise"), 6, "further_rise")


def _cross(target: float, late: str = "0") -> str:
    months = f"CASE WHEN peak_ratio <= {target} THEN 0 ELSE ln(peak_ratio / {target}) / fall_rate END"
    return f"CAST(peak + CAST(round_even({months}, 0) + {late} AS INTEGER) * INTERVAL 1 MONTH AS DATE)"


BACKTEST = f"""{DECAY},
  tim AS (SELECT series, peak, r, 1.0 / greatest(count(*) OVER (PARTITION BY series, peak), 1) AS w FROM pooled),
  dq AS (SELECT DISTINCT max_q FROM timing WHERE back_months IS NOT NULL),
  pt AS (SELECT d.max_q, quantile_cont(t.r, 0.5) AS decay_used, count(DISTINCT (t.series, t.peak)) AS n
    FROM dq d JOIN pooled t ON t.peak < d.max_q GROUP BY 1),
  pf AS (SELECT d.max_q, quantile_cont(f.fall_rate, 0.5) AS fall_used, count(*) AS n FROM dq d JOIN fall f ON f.peak < d.max_q GROUP BY 1),
  cases AS (SELECT t.series, t.peak, t.p_trough0, t.back_months, t.max_q, CAST(t.max_q + INTERVAL 6 MONTH AS DATE) AS decision_q,
      pt.decay_used, pf.fall_used FROM timing t JOIN pt ON pt.max_q = t.max_q AND pt.n >= 2 JOIN pf ON pf.max_q = t.max_q AND pf.n >= 3
    WHERE t.back_months IS NOT NULL),
  known AS (SELECT c.*, (SELECT max(i.q) FROM inc i WHERE i.series = c.series AND i.q <= c.decision_q) AS last_q,
      (SELECT max(i.q) FROM inc i WHERE i.series = c.series AND i.q <= c.decision_q AND i.inc > 0) AS rose_q,
      (SELECT arg_max(l.l, l.q) FROM lvl l WHERE l.series = c.series AND l.q <= c.decision_q) AS lv FROM cases c),
  knowni AS (SELECT k.*, i.inc AS last_inc FROM known k JOIN inc i ON i.series = k.series AND i.q = k.last_q),
  steps AS (SELECT series, peak, decay_used, 0 AS n, last_inc AS step, CAST(0 AS DOUBLE) AS total FROM knowni
    UNION ALL SELECT series, peak, decay_used, n + 1, step * decay_used, total + step * decay_used FROM steps WHERE step * decay_used >= 0.02),
  more AS (SELECT k.*, w.n_steps, w.rise FROM knowni k
    JOIN (SELECT series, peak, max(n) AS n_steps, arg_max(total, n) AS rise FROM steps GROUP BY 1, 2) w ON w.series = k.series AND w.peak = k.peak),
  pred AS (SELECT *, CAST(CASE WHEN last_inc <= 0 THEN coalesce(rose_q, last_q) ELSE last_q + n_steps * INTERVAL 3 MONTH END + INTERVAL 1 MONTH AS DATE) AS pred_peak,
      CAST(round_even((lv + rise - ln(p_trough0)) / fall_used, 0) AS INTEGER) AS back FROM more),
  tested AS (SELECT series, peak AS actual_peak, decision_q, pred_peak, CAST(peak + back_months * INTERVAL 1 MONTH AS DATE) AS actual_back,
      CAST(pred_peak + back * INTERVAL 1 MONTH AS DATE) AS pred_back, decay_used, fall_used FROM pred),
  bt AS (SELECT *, {_months('actual_peak', 'pred_peak')} AS peak_err_m, {_months('actual_back', 'pred_back')} AS back_err_m FROM tested)"""


@query("backtest", f"""WITH RECURSIVE {BACKTEST} SELECT series, actual_peak, decision_q, pred_peak, actual_back, pred_back, peak_err_m,
  back_err_m, round(decay_used, 6) AS decay_used, round(fall_used, 6) AS fall_used FROM bt""")
def backtest(spark, folder):
    return rounded(P.backtest(*learned(spark, folder)), 6, "decay_used", "fall_used")


@query("backtest_prior", f"""WITH RECURSIVE {BACKTEST} SELECT series, peak, max_q, round(decay_used, 6) AS decay_used,
  round(fall_used, 6) AS fall_used FROM cases""")
def backtest_prior(spark, folder):
    _, _, timing, fall = learned(spark, folder)
    cases = timing.where("back_months IS NOT NULL").select("series", "peak", "max_q")
    pool = C.pooled_ratios(timing.withColumn("w", 1.0 / F.greatest(F.size("decay_ratios"), F.lit(1))), ["peak", "w"])
    cases = P.prior_params(cases, pool, "max_q", "ratio", "decay_used", 2, weight="w")
    return rounded(P.prior_params(cases, fall.select("peak", "fall_rate"), "max_q", "fall_rate", "fall_used", 3), 6, "decay_used", "fall_used")


@query("backtest_bias", f"WITH RECURSIVE {BACKTEST} SELECT CAST(-round_even(quantile_cont(back_err_m, 0.5), 0) AS INTEGER) AS bias FROM bt")
def backtest_bias(spark, folder):
    return P.bias_months(P.backtest(*learned(spark, folder)))


def known_levels(spark, folder):
    """Levels with the fitted parameters and the bias on every row."""
    series, cycles, timing, fall = learned(spark, folder)
    bias = settle(P.bias_months(P.backtest(series, cycles, timing, fall)))
    return A.attach(A.attach(levels(series), fitted(timing, fall)), bias)


def scenarios(spark, folder):
    rows = known_levels(spark, folder)
    return P.scenario_table(rows, P.standard_scenarios(CAP), TARGETS, ASOF, F.col("bias"))


BIASED = LEVELS.replace(DECAY, BACKTEST, 1) + """,
  bias AS (SELECT CAST(-round_even(quantile_cont(back_err_m, 0.5), 0) AS INTEGER) AS bias FROM bt)"""
BIASED = BIASED.replace("  known AS (SELECT * FROM m", "  knownm AS (SELECT * FROM m").replace("FROM known GROUP BY", "FROM knownm GROUP BY")
DATES = ", ".join(
    f'{_cross(t)} AS "date_{n}", {_cross(t, "bias")} AS "date_{n}_adj"' for n, t in TARGETS.items()
)


@query("scenario_table", f"""WITH RECURSIVE {BIASED} SELECT series, scenario, round(decay_ratio, 6) AS decay_ratio, round(fall_rate, 6) AS fall_rate,
  peak, round(100 * (exp(further_rise) - 1), 6) AS further_rise_pct, round(peak_ratio, 6) AS peak_ratio, {DATES}, bias FROM peaks, bias""")
def scenario_table(spark, folder):
    table = scenarios(spark, folder).withColumn("further_rise_pct", 100 * (F.exp("further_rise") - 1))
    dates = [f"date_{n}{s}" for n in TARGETS for s in ("", "_adj")]
    out = table.select(
        "series", "scenario", "decay_ratio", "fall_rate", "peak", "further_rise_pct", "peak_ratio", *[F.col(f"`{d}`") for d in dates], "bias"
    )
    return rounded(out, 6, "decay_ratio", "fall_rate", "further_rise_pct", "peak_ratio")


@query("scenario_paths", f"""WITH RECURSIVE {BIASED},
  cal AS (SELECT CAST(DATE '2000-01-01' + g * INTERVAL 1 MONTH AS DATE) AS month FROM range(0, 60) r(g)),
  today AS (SELECT DATE '{ASOF}' AS today_m)
  SELECT series, scenario, month, round(CASE WHEN month <= today_m THEN NULL
    WHEN month <= peak THEN ratio_now * exp(further_rise * {_months('today_m', 'month')} / greatest({_months('today_m', 'peak')}, 1))
    ELSE peak_ratio * exp(-fall_rate * greatest({_months('peak', 'month')} - bias, 0)) END, 6) AS ratio FROM peaks, bias, cal, today""")
def scenario_paths(spark, folder):
    paths = P.scenario_paths(scenarios(spark, folder), "2000-01-01", "2004-12-01", ASOF, F.col("bias"), ["series", "scenario"])
    return rounded(paths, 6, "ratio")


FIXED_PEAKS = {"fast": "2001-07-01", "base": "2001-10-01", "slow": "2002-02-01"}


@query("scenario_fixed_peak", f"""WITH RECURSIVE {BIASED},
  fixed AS (SELECT b.series, b.ratio_now AS peak_ratio, s.scenario, s.fall_rate, s.peak FROM base b, params p, LATERAL (VALUES
     ('fast', p.fall_q75, DATE '{FIXED_PEAKS["fast"]}'), ('base', p.fall_q50, DATE '{FIXED_PEAKS["base"]}'),
     ('slow', p.fall_q25, DATE '{FIXED_PEAKS["slow"]}')) s(scenario, fall_rate, peak))
  SELECT series, scenario, peak, round(fall_rate, 6) AS fall_rate, {_cross(0.9, 'bias')} AS "date_0.9x_adj" FROM fixed, bias""")
def scenario_fixed_peak(spark, folder):
    rows = known_levels(spark, folder)
    rates = {"fast": "fall_q75", "base": "fall_q50", "slow": "fall_q25"}
    table = P.scenario_table(
        rows, {n: {"fall_rate": F.col(c)} for n, c in rates.items()}, {"0.9x": 0.9}, ASOF, F.col("bias"), FIXED_PEAKS
    )
    return rounded(table.select("series", "scenario", "peak", "fall_rate", F.col("`date_0.9x_adj`")), 6, "fall_rate")
