"""One key holds a third of the rows: grouped quantiles, modes, cell propensities and matching stay exact."""

import numpy as np
from pyspark.sql import functions as F

from causeway.operators import eda as E
from causeway.operators import matching as M
from causeway.operators import prep as C
from causeway.operators import propensity as P
from causeway.spec import CausalSpec


def _skewed(oc):
    # every third order is moved into one hot segment with one score: a third of the table on one key
    hot = (F.col("id") % 3 == 0)
    return oc.select("id", "tc", "y_planted", "x1", "x2",
                     F.when(hot, F.lit("HOT")).otherwise(F.col("seg")).alias("seg"),
                     F.when(hot, F.lit(-1)).otherwise(F.col("x1_band")).alias("x1_band"))


def test_grouped_quantiles_hot_group_exact(oc_small):
    d = _skewed(oc_small)
    a = E.grouped_quantiles(d, ["seg"], "y_planted", [0.5], ["med"]).toPandas().set_index("seg")
    b = E.grouped_quantiles(d, ["seg"], "y_planted", [0.5], ["med"], quantile_limit=400).toPandas().set_index("seg")
    p = d.select("seg", "y_planted").toPandas()
    for seg, grp in p.groupby("seg"):
        assert np.isclose(a.loc[seg, "med"], np.median(grp.y_planted))
        assert np.isclose(b.loc[seg, "med"], np.median(grp.y_planted))


def test_mode_with_hot_value(oc_small):
    out = C.column_modes(_skewed(oc_small), ["seg"])
    assert out["seg"] == "HOT"


def test_stratified_matching_with_hot_cell_equals_brute_force(oc_small):
    spec = CausalSpec("tc", "y_planted", ("x1", "x2"))
    d = _skewed(oc_small)
    scored = P.propensity_scores(d, spec, "stratified", ["seg", "x1_band"])
    groups = M.score_groups(scored, spec)
    pg = groups.toPandas()
    from test_properties import _brute_force
    both = M.matched_effects(groups)
    for arm in (1, 0):
        assert np.isclose(both[arm][0], _brute_force(pg, arm), rtol=1e-9)
