"""Digests of many texts at once: the bits of the library, and its order keys."""

import time
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.functions.digests import digest_words
from causeway.functions.hashing import SALT_PLACEBO, draw_key
from causeway.operators.replicates import Drawn, key_columns


def test_digests_are_those_of_the_library():
    prefixes = [b"", b"7-", b"-5-", b"123456789-", "né-".encode(), b"x" * 45 + b"-", b"x" * 52 + b"-", b"y" * 90 + b"-"]
    tails = [f"p-{r}".encode() for r in (0, 3, 10, 99, 100, 12345)]
    want = np.frombuffer(b"".join(md5(p + t).digest() for p in prefixes for t in tails), ">u4").reshape(8, 6, 4)
    assert (digest_words(prefixes, tails).transpose(1, 2, 0) == want).all()
    assert (digest_words(prefixes, tails, 2) == want.transpose(2, 0, 1)[:2]).all()
    assert digest_words([], tails).shape == (4, 0, 6)


def test_a_draw_costs_less_than_a_call_of_the_library():
    ids, tails = [str(i) for i in range(4000, 8000)], [f"ra-{r}".encode() for r in range(100)]
    draws = Drawn([pa.array(ids)], 100, "md5", ())
    taken = []
    for run in (lambda: draws.uniform("ra"), lambda: [md5(i.encode() + b"-" + t).digest() for i in ids for t in tails]):
        start = time.process_time()
        run()
        taken.append(time.process_time() - start)
    assert taken[0] < taken[1]


@pytest.mark.parametrize("rng", ["md5", "xxhash"])
def test_order_is_that_of_the_draw_keys(spark, rng):
    df = spark.range(300)
    rows = df.select(*[k.alias(f"k{i}") for i, k in enumerate(key_columns("id", rng, (SALT_PLACEBO,)))],
                     *[draw_key("id", SALT_PLACEBO, F.lit(s), rng).alias(f"d{s}") for s in (5, 6)]).toArrow().combine_chunks()
    got = Drawn([rows.column(0).combine_chunks()], range(5, 7), rng, (SALT_PLACEBO,)).order(SALT_PLACEBO)
    for j, s in enumerate((5, 6)):
        assert (np.argsort(got[:, j]) == np.argsort(rows[f"d{s}"].to_numpy())).all()
