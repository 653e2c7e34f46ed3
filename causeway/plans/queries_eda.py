"""Catalog entries for the exploratory aggregates (F)."""

from __future__ import annotations

from causeway.functions.hashing import SALT_SAMPLE, uniform_sql
from causeway.functions.quantiles import exact_quantiles
from causeway.operators import eda as E
from causeway.plans.catalog import register, rnd
from causeway.plans.frames import ORDERS_NAN_SQL, ORDERS_NULLS_SQL, orders_causal, orders_nan, orders_nulls, with_oc

_F1_COLS = ("x1", "y", "t", "post")


@register("f1_describe", with_oc(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, "
    f"round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, "
    f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM oc" for c in _F1_COLS)))
def f1_describe(spark, sf_dir):
    return rnd(E.describe(orders_causal(spark, sf_dir), list(_F1_COLS)))


_F2_COLS = ("id", "x1", "seg", "y", "t", "x2")


@register("f2_missing", with_oc(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100.0, 6) AS missing_pct FROM onul" for c in _F2_COLS),
    ORDERS_NULLS_SQL))
def f2_missing(spark, sf_dir):
    return rnd(E.missing_summary(orders_nulls(spark, sf_dir).select(*_F2_COLS)), 6)


_F3_COLS = ("x1", "y", "t", "x2")


def _f3_sql():
    parts = []
    for i, a in enumerate(_F3_COLS):
        for b in _F3_COLS:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM onul")
    return " UNION ALL ".join(parts)


@register("f3_correlation", with_oc(_f3_sql(), ORDERS_NULLS_SQL))
def f3_correlation(spark, sf_dir):
    return rnd(E.correlation_matrix(orders_nulls(spark, sf_dir), list(_F3_COLS)), 6)


_F_AGG_SQL = {"mean": "avg(y)", "sum": "coalesce(sum(y), 0)", "count": "count(y)", "median": "quantile_cont(y, 0.5)",
              "min": "min(y)", "max": "max(y)"}
_F_ID = {"mean": "f4", "sum": "f5", "count": "f6", "median": "f7", "min": "f8", "max": "f9"}


def _mk_grouped(agg, keys):
    def q(spark, sf_dir):
        return rnd(E.grouped_agg(orders_nulls(spark, sf_dir), keys, "y", agg))
    return q


for _agg, _sql in _F_AGG_SQL.items():
    for _keys in (["seg"], ["seg", "t"]):
        _name = f"{_F_ID[_agg]}_grouped_{_agg}" + ("_by_color" if len(_keys) > 1 else "")
        _k = ", ".join(_keys)
        _expr = f"round({_sql}, 4)" if _agg != "count" else _sql
        register(_name, with_oc(
            f"SELECT {_k}, {_expr} AS {_agg}_y FROM onul WHERE {' AND '.join(k + ' IS NOT NULL' for k in _keys)} "
            f"GROUP BY {_k}", ORDERS_NULLS_SQL))(_mk_grouped(_agg, _keys))


_HIST_SQL = """
hr AS (SELECT min(y) AS lo, max(y) AS hi, (max(y) - min(y)) / 20 AS step FROM oc),
hb AS (SELECT {code} AS bin, count(*) AS n FROM oc, hr GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))"""


def _code(x, lo, step, bins):
    return " + ".join(f"CAST({x} >= {i} * {step} + {lo} AS INTEGER)" for i in range(1, bins))


@register("f10_histogram", with_oc("""
SELECT b.bin, round(b.bin * step + lo, 4) AS lower,
       round(CASE WHEN b.bin = 19 THEN hi ELSE (b.bin + 1) * step + lo END, 4) AS upper, coalesce(hb.n, 0) AS n
FROM bins b CROSS JOIN hr LEFT JOIN hb ON b.bin = hb.bin""", _HIST_SQL.format(code=_code("y", "lo", "step", 20))))
def f10_histogram(spark, sf_dir):
    return rnd(E.histogram(orders_causal(spark, sf_dir), "y", 20))


@register("f11_histogram_by_group", with_oc("""
SELECT g.seg, b.bin, round(b.bin * g.step + g.lo, 4) AS lower,
       round(CASE WHEN b.bin = 19 THEN g.hi ELSE (b.bin + 1) * g.step + g.lo END, 4) AS upper, coalesce(c.n, 0) AS n
FROM gr g CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b
LEFT JOIN gc c ON c.seg = g.seg AND c.bin = b.bin""",
    "gr AS (SELECT seg, min(y) AS lo, max(y) AS hi, (max(y) - min(y)) / 20.0 AS step FROM oc GROUP BY seg)",
    f"gc AS (SELECT oc.seg, {_code('y', 'gr.lo', 'gr.step', 20)} AS bin, count(*) AS n "
    "FROM oc JOIN gr ON oc.seg = gr.seg GROUP BY 1, 2)"))
def f11_histogram_by_group(spark, sf_dir):
    return rnd(E.histogram_by(orders_causal(spark, sf_dir), "y", "seg", 20))


_BOX_SQL = """
SELECT {keys_sel} round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(min(CASE WHEN y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1) THEN y END), 4) AS whisker_low,
  round(max(CASE WHEN y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1) THEN y END), 4) AS whisker_high,
  CAST(sum(CASE WHEN y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
  count(*) AS n
FROM oc {join}
GROUP BY {keys_grp} q1, med, q3"""


@register("f12_box_stats", with_oc(_BOX_SQL.format(
    keys_sel="", keys_grp="", join=", (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS med, "
                                   "quantile_cont(y, 0.75) AS q3 FROM oc) q")))
def f12_box_stats(spark, sf_dir):
    return rnd(E.box_stats(orders_causal(spark, sf_dir), "y"))


@register("f13_box_stats_by_group", with_oc(_BOX_SQL.format(
    keys_sel="oc.seg,", keys_grp="oc.seg,",
    join="JOIN (SELECT seg, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) AS q3 "
         "FROM oc GROUP BY seg) q ON oc.seg = q.seg")))
def f13_box_stats_by_group(spark, sf_dir):
    return rnd(E.box_stats(orders_causal(spark, sf_dir), "y", "seg"))


@register("f14_category_counts", with_oc(
    "SELECT prio, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(prio) FROM oc) * 100.0, 6) AS share_pct "
    "FROM oc WHERE prio IS NOT NULL GROUP BY prio ORDER BY n DESC, prio"))
def f14_category_counts(spark, sf_dir):
    return rnd(E.category_counts(orders_causal(spark, sf_dir), "prio"), 6)


@register("f15_point_series", with_oc("SELECT id, x1, y, seg FROM oc"))
def f15_point_series(spark, sf_dir):
    return E.point_series(orders_causal(spark, sf_dir), "x1", "y", "seg", id_col="id")


@register("f15_point_series_sampled", with_oc(
    f"SELECT id, x1, y, seg FROM oc WHERE {uniform_sql('id', SALT_SAMPLE, 0)} < 0.1"))
def f15_point_series_sampled(spark, sf_dir):
    return E.point_series(orders_causal(spark, sf_dir), "x1", "y", "seg", id_col="id", fraction=0.1)


@register("f15_point_series_bounded", with_oc(
    f"SELECT id, x1, y, seg FROM oc ORDER BY {uniform_sql('id', SALT_SAMPLE, 0)}, id LIMIT 2000"))
def f15_point_series_bounded(spark, sf_dir):
    """At most 2,000 points for a scatter: the rows with the smallest sampling draws."""
    return E.point_series(orders_causal(spark, sf_dir), "x1", "y", "seg", id_col="id", max_points=2000)


_NAN_COLS = ("x1", "y")


@register("f1_describe_nan", with_oc(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, "
    f"round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM onan" for c in _NAN_COLS), ORDERS_NAN_SQL))
def f1_describe_nan(spark, sf_dir):
    """F1 where missing values come as NaN and null."""
    return rnd(E.describe(orders_nan(spark, sf_dir), list(_NAN_COLS)))


@register("f2_missing_nan", with_oc(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100.0, 6) AS missing_pct FROM onan" for c in _NAN_COLS), ORDERS_NAN_SQL))
def f2_missing_nan(spark, sf_dir):
    return rnd(E.missing_summary(orders_nan(spark, sf_dir).select(*_NAN_COLS)), 6)


@register("f13_box_stats_by_group_nan", with_oc("""
SELECT seg, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(min(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END), 4) AS whisker_low,
  round(max(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END), 4) AS whisker_high,
  CAST(sum(CASE WHEN y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
  count(y) AS n
FROM onan JOIN (SELECT seg, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3
                FROM onan GROUP BY seg) USING (seg)
WHERE y IS NOT NULL GROUP BY seg, q1, q2, q3""", ORDERS_NAN_SQL))
def f13_box_stats_by_group_nan(spark, sf_dir):
    return rnd(E.box_stats(orders_nan(spark, sf_dir), "y", "seg"))


@register("f7_grouped_median_refined", with_oc(
    "SELECT seg, round(quantile_cont(y, 0.5), 4) AS median_y FROM oc GROUP BY seg"))
def f7_grouped_median_refined(spark, sf_dir):
    """F7 with every group beyond the limit: brackets are cut until they hold one value."""
    return rnd(E.grouped_quantiles(orders_causal(spark, sf_dir), ["seg"], "y", [0.5], ["median_y"], quantile_limit=0))


_REFINED = ("x1", "y", "y_planted", "t")
_REFINED_QS = (0.05, 0.5, 0.95)


@register("c8_quantiles_refined", with_oc(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 6) AS value FROM oc" for c in _REFINED for q in _REFINED_QS)))
def c8_quantiles_refined(spark, sf_dir):
    """The quantiles behind C2, C8 and C12, all columns and ranks at once, every column beyond the limit."""
    got = exact_quantiles(orders_causal(spark, sf_dir), list(_REFINED), list(_REFINED_QS), quantile_limit=0)
    rows = [(c, q, round(v, 6)) for c in _REFINED for q, v in zip(_REFINED_QS, got[c])]
    return spark.createDataFrame(rows, "column string, q double, value double")
