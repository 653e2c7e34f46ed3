"""Catalog entries for sources (A), coercion (B), preprocessing (C) and filters (D)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from causeway.operators import coerce as B
from causeway.operators import filters as D
from causeway.operators import prep as C
from causeway.plans.catalog import register, rnd
from causeway.plans.frames import (BOOL_TEXT_SQL, ORDERS_NULLS_SQL, bool_text, orders_causal, orders_nulls, tied,
                                   with_oc)
from causeway.session import ensure_checkpoint_dir
from causeway.sources import io as A


def scratch_path(spark, tag: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (never a machine-local path)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


OC_COLS = "id, seg, prio, x1, x2, post, t, y, yb, tc"

# ---- A: sources and sinks -----------------------------------------------------------------------


@register("a1_read_csv", "SELECT * FROM customer")
def a1_read_csv(spark, sf_dir):
    src = A.read_table(spark, sf_dir, "customer")
    path = scratch_path(spark, "a1-customer-csv")
    A.write_csv(src, path)
    return A.read_csv(spark, path, schema=src.schema)


@register("a1_read_csv_infer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a1_read_csv_infer(spark, sf_dir):
    src = A.read_table(spark, sf_dir, "customer")
    path = scratch_path(spark, "a1-customer-infer")
    A.write_csv(src, path)
    df = A.read_csv(spark, path)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in src.schema.fields])


_WHOLE = "SELECT '{c}' AS \"column\", CASE WHEN max(abs({c})) < 2147483648 THEN 'int' ELSE 'bigint' END AS type FROM customer"


@register("a1_csv_inferred_types", " UNION ALL ".join([
    *[_WHOLE.format(c=c) for c in ("c_custkey", "c_nationkey")],
    *[f"SELECT '{c}', '{t}'" for c, t in (("c_name", "string"), ("c_acctbal", "double"), ("c_mktsegment", "string"))]]))
def a1_csv_inferred_types(spark, sf_dir):
    path = scratch_path(spark, "a1-customer-types")
    A.write_csv(A.read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return spark.createDataFrame(A.read_csv(spark, path).dtypes, "column string, type string")


@register("a2_write_csv_roundtrip", with_oc(f"SELECT {OC_COLS}, round(y_planted, 4) AS y_planted FROM oc"))
def a2_write_csv_roundtrip(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select(*[c.strip() for c in OC_COLS.split(",")], "y_planted")
    path = scratch_path(spark, "a2-export")
    A.write_csv(oc, path)
    return rnd(A.read_csv(spark, path, schema=oc.schema))


@register("a3_preview", with_oc(f"SELECT {OC_COLS} FROM oc ORDER BY id LIMIT 5"))
def a3_preview(spark, sf_dir):
    return A.preview(orders_causal(spark, sf_dir).select(*[c.strip() for c in OC_COLS.split(",")]), "id", 5)


# ---- B: coercion and encodings ------------------------------------------------------------------

@register("b1_bool_to_int", with_oc("SELECT id, CAST(flag_bool AS INTEGER) AS flag_bool FROM btxt", BOOL_TEXT_SQL))
def b1_bool_to_int(spark, sf_dir):
    return B.bools_to_int(bool_text(spark, sf_dir).select("id", "flag_bool"))


@register("b2_text_bool_to_int", with_oc("""
SELECT id,
  CASE WHEN upper(flag) IN ('TRUE','T','1','1.0') THEN 1 WHEN upper(flag) IN ('FALSE','F','0','0.0') THEN 0 END AS flag,
  flag_null, flag_mixed, prio
FROM btxt""", BOOL_TEXT_SQL))
def b2_text_bool_to_int(spark, sf_dir):
    return B.text_bools_to_int(bool_text(spark, sf_dir).select("id", "flag", "flag_null", "flag_mixed", "prio"))


@register("b2_text_bool_allow_null", with_oc("""
SELECT id,
  CASE WHEN upper(flag_null) IN ('TRUE','T','1','1.0') THEN 1 WHEN upper(flag_null) IN ('FALSE','F','0','0.0') THEN 0 END AS flag_null,
  flag_mixed
FROM btxt""", BOOL_TEXT_SQL))
def b2_text_bool_allow_null(spark, sf_dir):
    return B.text_bools_to_int(bool_text(spark, sf_dir).select("id", "flag_null", "flag_mixed"), allow_null=True)


@register("b4_cast_columns", with_oc("SELECT id, CAST(x2 AS DOUBLE) AS x2, CAST(post AS BIGINT) AS post, "
                                     "CAST(id AS VARCHAR) AS id_text FROM oc"))
def b4_cast_columns(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "x2", "post", F.col("id").alias("id_text"))
    return B.cast_columns(oc, {"x2": "double", "post": "bigint", "id_text": "string"})


@register("b5_encode_treatment_drop", with_oc(
    "SELECT id, prio, CASE WHEN prio = '1-URGENT' THEN 1 ELSE 0 END AS Treatment_Encoded FROM oc "
    "WHERE prio IN ('1-URGENT', '5-LOW')"))
def b5_encode_treatment_drop(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "prio")
    return B.encode_treatment(oc, "prio", "1-URGENT", "5-LOW", others="drop")


@register("b5_encode_treatment_control", with_oc(
    "SELECT id, prio, CASE WHEN prio = '1-URGENT' THEN 1 ELSE 0 END AS Treatment_Encoded FROM oc"))
def b5_encode_treatment_control(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "prio")
    return B.encode_treatment(oc, "prio", "1-URGENT", "5-LOW", others="control")


@register("b6_distinct_values", with_oc("SELECT DISTINCT prio FROM oc"))
def b6_distinct_values(spark, sf_dir):
    return B.distinct_values(orders_causal(spark, sf_dir), "prio")


_B7_COLS = ("yb", "t", "x2", "post", "prio", "seg", "x1")


@register("b7_is_binary", with_oc(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) = 2 AS is_binary FROM oc" for c in _B7_COLS)))
def b7_is_binary(spark, sf_dir):
    oc = orders_causal(spark, sf_dir)
    rows = list(B.binary_columns(oc, _B7_COLS).items())
    return spark.createDataFrame(rows, "column string, is_binary boolean")


@register("b9_interactions", with_oc(
    "SELECT id, tc * post AS tc_x_post, tc * x2 AS tc_x_x2, post * x2 AS post_x_x2, tc * post * x2 AS tc_x_post_x_x2, "
    "round(tc * x1, 4) + 0.0 AS tc_x_x1 FROM oc"))
def b9_interactions(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "tc", "post", "x2", "x1")
    out = B.add_interactions(oc, [("tc", "post"), ("tc", "x2"), ("post", "x2"), ("tc", "post", "x2"), ("tc", "x1")])
    return rnd(out.drop("tc", "post", "x2", "x1"))


@register("b11_drop_missing", with_oc("SELECT id, x1, seg, y FROM onul WHERE x1 IS NOT NULL AND y IS NOT NULL",
                                      ORDERS_NULLS_SQL))
def b11_drop_missing(spark, sf_dir):
    return B.drop_missing(orders_nulls(spark, sf_dir).select("id", "x1", "seg", "y"), ["x1", "y"])


# ---- C: preprocessing ---------------------------------------------------------------------------

def _onul(spark, sf_dir):
    return orders_nulls(spark, sf_dir).select("id", "x1", "seg", "y")


@register("c1_impute_mean", with_oc(
    "SELECT id, round(coalesce(x1, avg(x1) OVER ()), 4) AS x1, seg, round(coalesce(y, avg(y) OVER ()), 4) AS y FROM onul",
    ORDERS_NULLS_SQL))
def c1_impute_mean(spark, sf_dir):
    return rnd(C.impute_numeric(_onul(spark, sf_dir), "mean"))


@register("c2_impute_median", with_oc(
    "SELECT id, round(coalesce(x1, (SELECT quantile_cont(x1, 0.5) FROM onul)), 4) AS x1, seg, "
    "round(coalesce(y, (SELECT quantile_cont(y, 0.5) FROM onul)), 4) AS y FROM onul", ORDERS_NULLS_SQL))
def c2_impute_median(spark, sf_dir):
    return rnd(C.impute_numeric(_onul(spark, sf_dir), "median"))


@register("c3_impute_zero", with_oc("SELECT id, coalesce(x1, 0) AS x1, seg, coalesce(y, 0) AS y FROM onul",
                                    ORDERS_NULLS_SQL))
def c3_impute_zero(spark, sf_dir):
    return C.impute_numeric(_onul(spark, sf_dir), "zero")


@register("c4_impute_custom", with_oc("SELECT id, coalesce(x1, 7.5) AS x1, seg, coalesce(y, 7.5) AS y FROM onul",
                                      ORDERS_NULLS_SQL))
def c4_impute_custom(spark, sf_dir):
    return C.impute_numeric(_onul(spark, sf_dir), "custom", 7.5)


@register("c5_impute_mode", with_oc(
    "SELECT id, x1, coalesce(seg, (SELECT seg FROM onul WHERE seg IS NOT NULL GROUP BY seg "
    "ORDER BY count(*) DESC, seg ASC LIMIT 1)) AS seg, y FROM onul", ORDERS_NULLS_SQL))
def c5_impute_mode(spark, sf_dir):
    return C.impute_categorical(_onul(spark, sf_dir), "mode")


@register("c5_mode_ties", with_oc(
    "SELECT (SELECT CAST(k AS VARCHAR) FROM tk GROUP BY k ORDER BY count(*) DESC, CAST(k AS VARCHAR) ASC LIMIT 1) "
    "AS mode_k", "tk AS (SELECT id, CAST(id % 3 AS INTEGER) AS k FROM oc)"))
def c5_mode_ties(spark, sf_dir):
    """Mode of id mod 3 over every order: the three classes tie (or nearly), the smallest value wins ties."""
    modes = C.column_modes(tied(spark, sf_dir), ["k"])
    return spark.createDataFrame([(modes.get("k"),)], "mode_k string")


@register("c6_impute_missing_indicator", with_oc("SELECT id, x1, coalesce(seg, 'Missing') AS seg, y FROM onul",
                                                 ORDERS_NULLS_SQL))
def c6_impute_missing_indicator(spark, sf_dir):
    return C.impute_categorical(_onul(spark, sf_dir), "missing")


@register("c7_impute_custom_text", with_oc("SELECT id, x1, coalesce(seg, 'UNKNOWN') AS seg, y FROM onul",
                                           ORDERS_NULLS_SQL))
def c7_impute_custom_text(spark, sf_dir):
    return C.impute_categorical(_onul(spark, sf_dir), "custom", "UNKNOWN")


@register("c8_winsorize", with_oc("""
SELECT id,
  round(CASE WHEN x1 IS NULL THEN NULL ELSE greatest(least(x1, q.x1_hi), q.x1_lo) END, 4) AS x1, seg,
  round(CASE WHEN y IS NULL THEN NULL ELSE greatest(least(y, q.y_hi), q.y_lo) END, 4) AS y
FROM onul, (SELECT quantile_cont(x1, 0.05) AS x1_lo, quantile_cont(x1, 0.95) AS x1_hi,
                   quantile_cont(y, 0.05) AS y_lo, quantile_cont(y, 0.95) AS y_hi FROM onul) q""", ORDERS_NULLS_SQL))
def c8_winsorize(spark, sf_dir):
    return rnd(C.winsorize(_onul(spark, sf_dir), ["x1", "y"], 0.05))


@register("c9_log1p", with_oc("SELECT id, x1, round(ln(1 + y), 6) AS y FROM oc"))
def c9_log1p(spark, sf_dir):
    df, _ = C.log1p_columns(orders_causal(spark, sf_dir).select("id", "x1", "y"), ["x1", "y"])
    return rnd(df, 6)


@register("c10_standardize", with_oc(
    "SELECT id, round((x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER (), 6) AS x1, "
    "round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS y FROM oc"))
def c10_standardize(spark, sf_dir):
    return rnd(C.standardize(orders_causal(spark, sf_dir).select("id", "x1", "y"), ["x1", "y"]), 6)


_CUT_SQL = """
mm AS (SELECT min(x1) AS lo, max(x1) AS hi FROM oc),
ed AS (SELECT lo, hi, (hi - lo) / 4 AS step FROM mm)"""


@register("c11_cut", with_oc("""
SELECT id,
  CAST((x1 > 1 * step + lo)::INT + (x1 > 2 * step + lo)::INT + (x1 > 3 * step + lo)::INT AS INTEGER) AS x1_binned_code
FROM oc, ed""", _CUT_SQL))
def c11_cut(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "x1")
    return C.bucketize(oc, "x1", 4, "cut").select("id", "x1_binned_code")


_QCUT_SQL = "qe AS (SELECT list_sort(list_distinct(quantile_cont(x1, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM oc)"


@register("c12_qcut", with_oc("""
SELECT id, CAST(len(list_filter(e[2:], lambda v: v < x1)) AS INTEGER) AS x1_binned_code FROM oc, qe""", _QCUT_SQL))
def c12_qcut(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "x1")
    return C.bucketize(oc, "x1", 4, "qcut").select("id", "x1_binned_code")


@register("c12_qcut_duplicate_edges", with_oc("""
SELECT id, CAST(len(list_filter(e[2:], lambda v: v < k)) AS INTEGER) AS k_binned_code FROM tk, qk""",
    "tk AS (SELECT id, CAST(id % 3 AS INTEGER) AS k FROM oc)",
    "qk AS (SELECT list_sort(list_distinct(quantile_cont(k, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM tk)"))
def c12_qcut_duplicate_edges(spark, sf_dir):
    return C.bucketize(tied(spark, sf_dir).select("id", "k"), "k", 4, "qcut").select("id", "k_binned_code")


@register("c13_bucket_counts", with_oc("""
SELECT CAST(len(list_filter(e[2:], lambda v: v < x1)) AS INTEGER) AS x1_binned_code, count(*) AS n
FROM oc, qe GROUP BY 1 ORDER BY 1""", _QCUT_SQL))
def c13_bucket_counts(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "x1")
    return C.bucket_counts(C.bucketize(oc, "x1", 4, "qcut"), "x1_binned_code")


@register("c14_step_chain", with_oc("""
SELECT id, round(x1s, 6) AS x1, seg, round(y, 4) AS y FROM (
  SELECT id, seg, y, (x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS x1s
  FROM (SELECT id, seg, greatest(least(x1, q.x1_hi), q.x1_lo) AS x1, greatest(least(y, q.y_hi), q.y_lo) AS y
        FROM imp, (SELECT quantile_cont(x1, 0.05) AS x1_lo, quantile_cont(x1, 0.95) AS x1_hi,
                          quantile_cont(y, 0.05) AS y_lo, quantile_cont(y, 0.95) AS y_hi FROM imp) q) w
) s WHERE y > 100000""", ORDERS_NULLS_SQL,
    "imp AS (SELECT id, coalesce(x1, avg(x1) OVER ()) AS x1, coalesce(seg, 'Missing') AS seg, "
    "coalesce(y, avg(y) OVER ()) AS y FROM onul)"))
def c14_step_chain(spark, sf_dir):
    steps = C.default_order(impute=C.Impute("mean", categorical="missing"),
                            winsor=C.Winsorize(("x1", "y"), 0.05),
                            std=C.Standardize(("x1",)),
                            filters=[C.Filter("y", ">", 100000)])
    out = C.apply_steps(_onul(spark, sf_dir), steps)
    return out.select("id", F.round("x1", 6).alias("x1"), "seg", F.round("y", 4).alias("y"))


# ---- D: filters ---------------------------------------------------------------------------------

_D = [("d1_eq", "seg", "==", "BUILDING", "seg = 'BUILDING'"),
      ("d3_gt", "x1", ">", 5000.0, "x1 > 5000.0"),
      ("d4_lt", "x1", "<", 0.0, "x1 < 0.0"),
      ("d5_ge", "post", ">=", 1, "post >= 1"),
      ("d6_le", "y", "<=", 50000.0, "y <= 50000.0"),
      ("d7_contains", "prio", "contains", "URG|HIGH", "coalesce(regexp_matches(CAST(prio AS VARCHAR), 'URG|HIGH'), false)")]


def _mk_filter(col, op, val):
    def q(spark, sf_dir):
        return D.filter_rows(orders_causal(spark, sf_dir).select(*[c.strip() for c in OC_COLS.split(",")]), col, op, val)
    return q


for _name, _col, _op, _val, _pred in _D:
    register(_name, with_oc(f"SELECT {OC_COLS} FROM oc WHERE {_pred}"))(_mk_filter(_col, _op, _val))


@register("d2_ne_keeps_missing", with_oc("SELECT id, x1, seg, y FROM onul WHERE seg IS DISTINCT FROM 'BUILDING'",
                                         ORDERS_NULLS_SQL))
def d2_ne_keeps_missing(spark, sf_dir):
    return D.filter_rows(_onul(spark, sf_dir), "seg", "!=", "BUILDING")


@register("d7_contains_missing_never_matches", with_oc(
    "SELECT id, x1, seg, y FROM onul WHERE coalesce(regexp_matches(CAST(seg AS VARCHAR), 'ILD'), false)",
    ORDERS_NULLS_SQL))
def d7_contains_missing_never_matches(spark, sf_dir):
    return D.filter_rows(_onul(spark, sf_dir), "seg", "contains", "ILD")


@register("d8_filter_counts", with_oc(
    "SELECT count(*) AS rows_before, CAST(sum(CASE WHEN x1 > 5000.0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_after FROM oc"))
def d8_filter_counts(spark, sf_dir):
    return D.filter_counts(orders_causal(spark, sf_dir), "x1", ">", 5000.0)
