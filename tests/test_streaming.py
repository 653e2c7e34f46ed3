"""The streaming Gram job reaches the batch estimate once the stream has delivered every file."""

import numpy as np

from causeway.operators import regression as R
from causeway.spec import CausalSpec
from causeway.streaming.gram_stream import effect_from_sums, running_ols


def test_running_ols_equals_batch(spark, oc_small, tmp_path):
    spec = CausalSpec("tc", "y_planted", ("x1", "x2"))
    src = oc_small.select("id", "tc", "x1", "x2", "y_planted")
    path = str(tmp_path / "in")
    src.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(path)
    shift = [0.5, 4000.0, 0.5, 1500.0]
    agg, names = running_ols(stream, spec, shift)
    q = agg.writeStream.outputMode("complete").format("memory").queryName("gram_stream_test").start()
    try:
        q.processAllAvailable()
        row = spark.sql("SELECT * FROM gram_stream_test").collect()[-1]
    finally:
        q.stop()
    fit = effect_from_sums(row, names, shift, spec)
    batch = {r["term"]: r["coef"] for r in R.ols_coefficients(oc_small, spec).collect()}
    assert np.isclose(fit.coef[fit.index("tc")], batch["tc"], rtol=1e-9)
