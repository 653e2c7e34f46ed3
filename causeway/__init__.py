"""causeway: treatment-effect analytics expressed as Spark DataFrame / SQL / ML jobs.

Layout
------
sources/    reading and writing tables (CSV, parquet), preview
functions/  column-expression helpers: hash uniforms, Poisson weights, folds, distribution tails
operators/  the analysis operators: coercion, preprocessing, filters, EDA aggregates,
            Gram-matrix regressions, logit, DiD, propensity, matching, learners,
            bootstrap, heterogeneity, refutation
plans/      derived input frames, the step-chain pipeline, the full analysis and the query catalog
streaming/  the Gram job over a file stream (incremental OLS)
"""

from causeway.spec import CausalSpec, Method  # noqa: F401

__all__ = ["CausalSpec", "Method"]
