"""Deterministic randomness as column expressions.

Every random draw is a function of (row id, stream salt, replicate), never ``rand(seed)``,
so results do not depend on partitioning, retries or executor loss.

Two generators:
* ``md5``: first eight hex digits of md5("<id>-<salt>-<rep>") / 2^32. DuckDB computes the same
  bits, so every query built on it has an exact SQL oracle.
* ``xxhash``: ``xxhash64(id, salt, rep)`` mod 2^53 / 2^53; several times cheaper, no oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
TWO_53 = float(2 ** 53)

# Stream salts (fixed values): one per use, so draws of different operators are independent.
SALT_BOOTSTRAP = "b"
SALT_FOLD = "f"
SALT_SPLIT = "s"
SALT_COMMON_CAUSE_A = "ra"
SALT_COMMON_CAUSE_B = "rb"
SALT_PLACEBO = "p"
SALT_SAMPLE = "h"


def uniform(id_col: str | Column, salt: str, rep: int | str | Column = 0, rng: str = "md5") -> Column:
    """u in [0, 1) from (id, salt, rep)."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    repc = rep if isinstance(rep, Column) else (F.col(rep) if isinstance(rep, str) else F.lit(rep))
    if rng == "md5":
        return F.conv(F.substring(_md5_key(idc, salt, repc), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)
    if rng == "xxhash":
        return F.pmod(F.xxhash64(idc, F.lit(salt), repc), F.lit(2 ** 53)).cast("double") / F.lit(TWO_53)
    raise ValueError(f"unknown rng {rng!r}")


def draw_key(id_col: str | Column, salt: str, rep: int | str | Column = 0, rng: str = "md5") -> Column:
    """60 bits (md5) or 64 bits (xxhash) from (id, salt, rep) as a bigint to order rows by; with md5 the order of the
    digests themselves."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    repc = rep if isinstance(rep, Column) else (F.col(rep) if isinstance(rep, str) else F.lit(rep))
    if rng == "md5":
        return F.conv(F.substring(_md5_key(idc, salt, repc), 1, 15), 16, 10).cast("bigint")
    if rng == "xxhash":
        return F.xxhash64(idc, F.lit(salt), repc)
    raise ValueError(f"unknown rng {rng!r}")


def uniform_sql(id_expr: str, salt: str, rep_expr: str | int = 0) -> str:
    """DuckDB text of the md5 generator (oracle side)."""
    key = f"CAST({id_expr} AS VARCHAR) || '-{salt}-' || CAST({rep_expr} AS VARCHAR)"
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"


def explode_draws(df, id_col: str, n: int, salt: str, rng: str = "md5", idx: str = "rep", u: str = "u",
                  normal: bool = False):
    """Rows x n: adds ``idx`` (0..n-1) and its draw ``u`` (uniform, or N(0,1) with ``normal``).

    The input is first spread over the cluster's cores (no-op for a large table). The draw is a
    projection over the exploded rows, computed once per (row, idx); callers must not filter on it
    (a pushed-down filter would re-inline the hash) -- zero bootstrap weights simply add nothing.
    """
    from causeway.session import spread
    df = spread(df)
    ex = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(idx))
    draw = standard_normal(id_col, F.col(idx), rng) if normal else uniform(id_col, salt, F.col(idx), rng)
    return ex.withColumn(u, draw)


def poisson1_thresholds(kmax: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities P(K <= k), k = 0..kmax-1."""
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def poisson1_weight(u: Column, kmax: int = 12) -> Column:
    """Inverse-CDF Poisson(1) count from a uniform; replaces multinomial resampling counts."""
    th = poisson1_thresholds(kmax)
    expr = F.when(u < F.lit(th[0]), F.lit(0))
    for k in range(1, kmax):
        expr = expr.when(u < F.lit(th[k]), F.lit(k))
    return expr.otherwise(F.lit(kmax))


def poisson1_weight_sql(u_sql: str, kmax: int = 12) -> str:
    th = poisson1_thresholds(kmax)
    parts = " ".join(f"WHEN {u_sql} < {t!r} THEN {k}" for k, t in enumerate(th))
    return f"(CASE {parts} ELSE {kmax} END)"


def _md5_key(idc: Column, salt: str, repc: Column) -> Column:
    return F.md5(F.concat_ws("-", idc.cast("string"), F.lit(salt), repc.cast("string")))


def standard_normal(id_col: str | Column, rep: int | str | Column = 0, rng: str = "md5") -> Column:
    """N(0,1) by Box-Muller from two independent uniforms of the row.

    md5: both uniforms come from ONE digest (hex digits 1-8 and 9-16), so one hash per draw.
    """
    if rng != "md5":
        u1 = uniform(id_col, SALT_COMMON_CAUSE_A, rep, rng)
        u2 = uniform(id_col, SALT_COMMON_CAUSE_B, rep, rng)
    else:
        idc = F.col(id_col) if isinstance(id_col, str) else id_col
        repc = rep if isinstance(rep, Column) else (F.col(rep) if isinstance(rep, str) else F.lit(rep))
        h = _md5_key(idc, SALT_COMMON_CAUSE_A, repc)
        u1 = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)
        u2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint") / F.lit(TWO_32)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def standard_normal_sql(id_expr: str, rep_expr: str | int = 0) -> str:
    key = f"md5(CAST({id_expr} AS VARCHAR) || '-{SALT_COMMON_CAUSE_A}-' || CAST({rep_expr} AS VARCHAR))"
    u1 = f"(CAST(('0x' || substr({key}, 1, 8)) AS BIGINT) / 4294967296.0)"
    u2 = f"(CAST(('0x' || substr({key}, 9, 8)) AS BIGINT) / 4294967296.0)"
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos({2 * math.pi!r} * {u2}))"


def fold(id_col: str | Column, k: int, rng: str = "md5", salt: str = SALT_FOLD) -> Column:
    """Fold number 0..k-1 of the row."""
    return F.floor(uniform(id_col, salt, 0, rng) * F.lit(k)).cast("int")


def fold_sql(id_expr: str, k: int, salt: str = SALT_FOLD) -> str:
    return f"CAST(floor({uniform_sql(id_expr, salt, 0)} * {k}) AS INTEGER)"
