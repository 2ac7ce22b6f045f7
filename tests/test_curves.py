"""Curve keys: bijection, adjacency, agreement of the column and array forms, and fixed values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import curves
from lodestone.operators import allocation


@pytest.mark.parametrize("bits", [(2, 1, 3), (3, 3, 2), (1, 0, 2), (3, 3, 3), (0, 0, 4)])
def test_hilbert_is_a_bijection(bits):
    q = np.array(list(itertools.product(*(range(1 << b) for b in bits))))
    keys = curves.hilbert_array(q, bits)
    assert sorted(keys) == list(range(len(q)))
    assert (curves.hilbert_decode_array(keys, bits) == q).all()


def test_equal_depths_move_to_a_face_neighbour():
    q = curves.hilbert_decode_array(np.arange(1 << 12), (4, 4, 4))
    assert (np.abs(np.diff(q, axis=0)).sum(axis=1) == 1).all()


def test_compact_key_is_the_rank_in_the_padded_curve():
    bits = (3, 1, 2)
    q = np.array(list(itertools.product(*(range(1 << b) for b in bits))))
    padded = curves.hilbert_array(q, (3, 3, 3))
    assert (np.argsort(padded) == np.argsort(curves.hilbert_array(q, bits))).all()


def test_columns_equal_arrays(spark):
    rng = np.random.default_rng(5)
    for bits in ((10, 4, 1), (21, 21, 21), (0, 5, 0)):
        q = np.column_stack([rng.integers(0, 1 << b, 200) for b in bits])
        df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(q)], "i long, x long, y long, z long")
        cells = [F.col(c) for c in "xyz"]
        got = df.select("i", curves.hilbert(cells, bits).alias("h"), curves.morton(cells, bits).alias("m")).orderBy("i").collect()
        assert [r["h"] for r in got] == curves.hilbert_array(q, bits).tolist()
        assert [r["m"] for r in got] == curves.morton_array(q, bits).tolist()


def test_keys_and_depths_out_of_range_are_errors():
    with pytest.raises(ValueError):
        curves.check_depths((22, 22, 22))
    with pytest.raises(ValueError):
        curves.hilbert_decode_array(np.array([8]), (1, 1, 1))


def test_quantizer_edges(spark):
    values = [float("nan"), float("inf"), float("-inf"), -1.0, 0.0, 0.5, 1.0, 2.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(curves.quantize(F.col("v"), 0.0, 1.0, 3)).collect()]
    assert got == [0, 7, 0, 0, 0, 4, 7, 7, 0]


def test_allocation_rules():
    assert allocation.monotone_half([1, 1, 1]) == (10, 4, 1)
    assert allocation.monotone_half([1, 5, 3]) == (1, 10, 4)
    assert allocation.within_budget([32, 32, 32]) == (21, 21, 21)
    assert allocation.sample_count_depth(1 << 40) == 14
    assert sum(allocation.occupancy([1e9, 1e-9, 1.0], 10**9)) <= 63
    assert allocation.occupancy([1.0, 0.0, 1.0], 100) == (1, 1, 1)
