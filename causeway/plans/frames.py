"""Frames derived from the given tables, in the shape of one flat causal table.

``orders_causal``: one row per order (``orders`` joined to ``customer``), with a placebo
treatment ``t``, a confounded treatment ``tc`` and outcomes with planted effects. Only integer
and double arithmetic, so DuckDB builds the identical frame (``ORDERS_CAUSAL_SQL``).

The join is a plain equi-join: Spark's size-checked broadcast threshold and AQE decide between a
broadcast and a sort-merge join, so a customer table that grows with the data is never forced
into a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.io import read_table

# Fixed values of the derived frame (FIXTURES.md §3).
POST_START = "1998-04-15"
X2_SEGMENTS = ("BUILDING", "MACHINERY")
T_PRIORITIES = ("1-URGENT", "2-HIGH")
U1_MULT, U1_MOD = 7919, 1009
U2_MULT, U2_MOD = 104729, 997
U3_MULT, U3_MOD = 15485863, 991


def _unit(id_col, mult: int, mod: int):
    # (id*mult mod m)/m computed as ((id mod m)*(mult mod m)) mod m: equal, and never overflows bigint
    return ((F.col(id_col) % mod) * (mult % mod) % mod).cast("double") / F.lit(float(mod))


def orders_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    x2 = F.col("c_mktsegment").isin(*X2_SEGMENTS).cast("int")
    base = j.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("seg"),
        F.col("o_orderpriority").alias("prio"),
        F.col("c_acctbal").alias("x1"),
        x2.alias("x2"),
        (F.col("o_orderdate") >= F.lit(POST_START).cast("timestamp_ntz")).cast("int").alias("post"),
        F.col("o_orderpriority").isin(*T_PRIORITIES).cast("int").alias("t"),
        F.col("o_totalprice").alias("y"),
        (F.col("o_orderstatus") == "F").cast("int").alias("yb"),
        _unit("o_orderkey", U1_MULT, U1_MOD).alias("u1"),
        _unit("o_orderkey", U2_MULT, U2_MOD).alias("u2"),
        _unit("o_orderkey", U3_MULT, U3_MOD).alias("u3"),
    )
    tc = (F.col("u1") < F.lit(0.3) + F.lit(0.3) * F.col("x2") + F.lit(0.00001) * F.col("x1")).cast("int")
    base = base.withColumn("tc", tc)
    # planted truths, own to this repository: customers of the x2 segments spend far less and are treated more often
    noise = F.lit(90.0) * F.col("u2")
    level = F.lit(0.03) * F.col("x1") - F.lit(700) * F.col("x2")
    return base.select(
        "*",
        (F.lit(320) * F.col("tc") + level + noise).alias("y_planted"),
        (F.when(F.col("x2") == 1, 440).otherwise(260) * F.col("tc") + level + noise).alias("y_hte"),
        (F.lit(210) * F.col("tc") * F.col("post") + F.lit(25) * F.col("tc") - F.lit(35) * F.col("post")
         + F.lit(90) * F.col("x2") + noise).alias("y_did"),
        (F.col("u3") * (F.lit(1.0) + F.exp(F.lit(0.4) + F.lit(0.7) * F.col("x2") - F.lit(0.9) * F.col("tc"))) < F.lit(1.0))
        .cast("int").alias("yb_planted"),
        # discrete confounder cell used by the stratified propensity and cell-mean learners
        F.floor(F.col("x1") / F.lit(1000.0)).cast("int").alias("x1_band"),
    )


def _unit_sql(mult: int, mod: int) -> str:
    return f"(CAST(((o.o_orderkey % {mod}) * {mult % mod}) % {mod} AS DOUBLE) / {float(mod)!r})"


ORDERS_CAUSAL_SQL = f"""
base AS (
  SELECT o.o_orderkey AS id, c.c_mktsegment AS seg, o.o_orderpriority AS prio, c.c_acctbal AS x1,
         CAST(c.c_mktsegment IN ('BUILDING', 'MACHINERY') AS INTEGER) AS x2,
         CAST(o.o_orderdate >= TIMESTAMP '{POST_START}' AS INTEGER) AS post,
         CAST(o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS t,
         o.o_totalprice AS y,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS yb,
         {_unit_sql(U1_MULT, U1_MOD)} AS u1,
         {_unit_sql(U2_MULT, U2_MOD)} AS u2,
         {_unit_sql(U3_MULT, U3_MOD)} AS u3
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
base2 AS (
  SELECT *, CAST(u1 < 0.3 + 0.3 * x2 + 0.00001 * x1 AS INTEGER) AS tc FROM base
),
oc AS (
  SELECT *,
    320 * tc + (0.03 * x1 - 700 * x2) + 90.0 * u2 AS y_planted,
    (CASE WHEN x2 = 1 THEN 440 ELSE 260 END) * tc + (0.03 * x1 - 700 * x2) + 90.0 * u2 AS y_hte,
    210 * tc * post + 25 * tc - 35 * post + 90 * x2 + 90.0 * u2 AS y_did,
    CAST(u3 * (1.0 + exp(0.4 + 0.7 * x2 - 0.9 * tc)) < 1.0 AS INTEGER) AS yb_planted,
    CAST(floor(x1 / 1000.0) AS INTEGER) AS x1_band
  FROM base2
)"""


def with_oc(select_sql: str, *more_ctes: str) -> str:
    """Wrap an oracle SELECT with the ``oc`` CTE (and optional extra CTEs that may read ``oc``)."""
    extra = "".join(f",\n{c}" for c in more_ctes)
    return f"WITH {ORDERS_CAUSAL_SQL.strip()}{extra}\n{select_sql}"


def orders_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_causal`` whose planted outcomes are null in a third of the rows and whose segment is null in a seventh."""
    gone, unknown = F.col("id") % 3 == 0, F.col("id") % 7 == 0
    return orders_causal(spark, sf_dir).withColumns({
        "seg": F.when(~unknown, F.col("seg")), "y_planted": F.when(~gone, F.col("y_planted")),
        "y_hte": F.when(~gone, F.col("y_hte"))})


def orders_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_causal`` with NaN as the price in an eleventh of the rows and null or NaN as the balance in a thirteenth."""
    nan = F.lit(float("nan"))
    x1 = F.when(F.col("id") % 26 == 0, F.lit(None)).when(F.col("id") % 13 == 0, nan).otherwise(F.col("x1"))
    return orders_causal(spark, sf_dir).withColumns({"y": F.when(F.col("id") % 11 == 0, nan).otherwise(F.col("y")), "x1": x1})


#: The same rows for the oracle, where missing is null.
ORDERS_NAN_SQL = ("onan AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN NULL ELSE y END AS y, "
                  "CASE WHEN id % 13 = 0 THEN NULL ELSE x1 END AS x1) FROM oc)")


def with_holes(select_sql: str, *more_ctes: str) -> str:
    """Oracle on the usable rows of ``orders_holes``; the null segment is a cell of its own."""
    base = ORDERS_CAUSAL_SQL.strip().replace("\noc AS (", "\noc_all AS (")
    oc = "oc AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN '~' ELSE seg END AS seg) FROM oc_all WHERE id % 3 <> 0)"
    return f"WITH {base},\n" + ",\n".join([oc, *more_ctes]) + f"\n{select_sql}"


# ---- edge frames (FIXTURES.md §4) -------------------------------------------------------------

def orders_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    oc = orders_causal(spark, sf_dir)
    return oc.select(
        "id",
        F.when(F.col("id") % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("x1")).alias("x1"),
        F.when(F.col("id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("seg")).alias("seg"),
        F.when(F.col("id") % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("y")).alias("y"),
        "t", "x2",
    )


ORDERS_NULLS_SQL = """
onul AS (
  SELECT id,
         CASE WHEN id % 10 = 0 THEN NULL ELSE x1 END AS x1,
         CASE WHEN id % 7 = 0 THEN NULL ELSE seg END AS seg,
         CASE WHEN id % 13 = 0 THEN NULL ELSE y END AS y,
         t, x2
  FROM oc
)"""

# Boolean-like spellings used for the text flags, by id mod 4.
BOOL_TEXT_SPELLINGS = ("TRUE", "false", "T", "f")


def bool_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    oc = orders_causal(spark, sf_dir)
    k = F.col("id") % 4
    flag = (F.when(k == 0, "TRUE").when(k == 1, "false").when(k == 2, "T").otherwise("f"))
    return oc.select(
        "id",
        flag.alias("flag"),
        F.when(F.col("id") % 11 == 0, F.lit(None).cast("string")).otherwise(flag).alias("flag_null"),
        F.when(F.col("id") == 5, F.lit("maybe")).otherwise(flag).alias("flag_mixed"),
        (k % 2 == 0).alias("flag_bool"),
        F.col("prio"),
        F.col("y"),
    )


BOOL_TEXT_SQL = """
btxt AS (
  SELECT id,
    CASE id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'T' ELSE 'f' END AS flag,
    CASE WHEN id % 11 = 0 THEN NULL ELSE (CASE id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'T' ELSE 'f' END) END AS flag_null,
    CASE WHEN id = 5 THEN 'maybe' ELSE (CASE id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'T' ELSE 'f' END) END AS flag_mixed,
    (id % 4) % 2 = 0 AS flag_bool,
    prio, y
  FROM oc
)"""


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_causal(spark, sf_dir).select("id", (F.col("id") % 3).cast("int").alias("k"), "y")


def collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_causal(spark, sf_dir).select(
        "id", "tc", "x2", (F.lit(2) * F.col("x2")).alias("x2b"), F.lit(1).alias("const"), "x1", "y_planted")
