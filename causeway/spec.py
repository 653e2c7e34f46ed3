"""Column roles, method names and the result schemas every operator returns."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Method(str, Enum):
    OLS = "ols"
    LOGIT = "logit"
    DID = "did"
    DID_LOGIT = "did_logit"
    PSM = "psm"
    IPTW = "iptw"
    LINEAR_DML = "linear_dml"
    CAUSAL_FOREST = "causal_forest"
    S_LEARNER = "s_learner"
    T_LEARNER = "t_learner"

    @property
    def is_cate(self) -> bool:
        return self in (Method.LINEAR_DML, Method.CAUSAL_FOREST, Method.S_LEARNER, Method.T_LEARNER)


@dataclass(frozen=True)
class CausalSpec:
    """Roles of the columns of one flat table.

    ``id_col`` is required by everything that draws hash-seeded randomness (bootstrap,
    folds, refutations): a stable row identity, independent of partitioning.
    """

    treatment: str
    outcome: str
    confounders: tuple[str, ...] = field(default_factory=tuple)
    time_period: str | None = None
    id_col: str = "id"

    def __post_init__(self):
        object.__setattr__(self, "confounders", tuple(self.confounders))
        roles = [self.treatment, self.outcome, *self.confounders]
        if self.time_period:
            roles.append(self.time_period)
        if len(set(roles)) != len(roles):
            raise ValueError(f"a column has two roles: {roles}")

    def effect_modifiers(self, method: Method | str) -> tuple[str, ...]:
        return self.confounders if Method(method).is_cate else ()

    def validate(self, df: DataFrame) -> None:
        names = set(df.columns)
        needed = [self.treatment, self.outcome, *self.confounders]
        if self.time_period:
            needed.append(self.time_period)
        missing = [c for c in needed if c not in names]
        if missing:
            raise ValueError(f"columns not in table: {missing}")

    def with_(self, **kw) -> "CausalSpec":
        d = dict(treatment=self.treatment, outcome=self.outcome, confounders=self.confounders,
                 time_period=self.time_period, id_col=self.id_col)
        d.update(kw)
        return CausalSpec(**d)


_TYPES = {"STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BIGINT": T.LongType(),
          "INT": T.IntegerType(), "BOOLEAN": T.BooleanType()}


def _schema(ddl: str) -> T.StructType:
    """Flat ``name TYPE, ...`` schema without needing a session."""
    fields = []
    for part in ddl.split(","):
        name, typ = part.split()
        fields.append(T.StructField(name, _TYPES[typ], True))
    return T.StructType(fields)


ESTIMATE = _schema("method STRING, estimand STRING, n BIGINT, value DOUBLE, se DOUBLE, "
                   "ci_lower DOUBLE, ci_upper DOUBLE, se_source STRING")
COEFFICIENTS = _schema("term STRING, coef DOUBLE, se DOUBLE, stat DOUBLE, p_value DOUBLE, "
                       "ci_lower DOUBLE, ci_upper DOUBLE")
ODDS = _schema("odds_ratio DOUBLE, log_odds DOUBLE, p_value DOUBLE, ci_lower DOUBLE, ci_upper DOUBLE, "
               "baseline_risk DOUBLE, risk_diff DOUBLE, rd_lower DOUBLE, rd_upper DOUBLE")
HTE = _schema("feature STRING, coef DOUBLE, p_value DOUBLE, significant BOOLEAN, skipped_reason STRING")
REFUTATION = _schema("test STRING, original DOUBLE, new_effect DOUBLE, p_value DOUBLE, passed BOOLEAN")
BOOTSTRAP = _schema("rep INT, estimate DOUBLE")
FIT_SUMMARY = _schema("statistic STRING, value DOUBLE")
