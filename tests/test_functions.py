import itertools
import math

import pytest

from epsgrid.functions import (cell_min_sq_dist, count_offsets, grid_coord, neighbor_offsets,
                               uniform_hash)
from epsgrid.operators.grid import _shifts


@pytest.mark.parametrize("dim,kept", [(1, 3), (2, 21), (3, 117), (4, 609), (5, 3903), (6, 28197)])
def test_offset_counts(dim, kept):
    assert count_offsets(dim) == kept
    if dim <= 5:
        assert len(neighbor_offsets(dim)) == kept


def test_offsets_match_definition():
    # brute force: every integer offset whose cell gap is below eps
    for dim in (1, 2, 3):
        delta = math.ceil(math.sqrt(dim))
        want = {o for o in itertools.product(range(-delta - 2, delta + 3), repeat=dim)
                if sum(max(abs(v) - 1, 0) ** 2 for v in o) / dim < 1}
        assert set(neighbor_offsets(dim)) == want
        assert (0,) * dim in want


@pytest.mark.parametrize("width", [0, 1, 3, 4, 5, 1000, 2 ** 40])
def test_levels_end_at_one_cell(width):
    shifts = _shifts(width)
    assert shifts[0] == 0 and width >> shifts[-1] == 0
    assert len(shifts) == 1 or width >> shifts[-2] > 0


def test_grid_coord_floor_negative(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (0.99,), (1.0,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(grid_coord("x", 1.0, 1)).collect()]
    assert got == [-1, 0, 0, 1, -1]


def test_grid_coord_operation_order(spark):
    # floor(x / eps * sqrt(dim)), divide first
    x, eps = 7.0, 2.3
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(grid_coord("x", eps, 2)).first()[0] == math.floor(x / eps * math.sqrt(2))


def test_grid_coord_overflow_raises(spark):
    df = spark.createDataFrame([(1e300,)], "x double")
    with pytest.raises(Exception):
        df.select(grid_coord("x", 1.0, 2)).collect()


def test_cell_min_sq_dist(spark):
    df = spark.createDataFrame([(0, 0, 3, 1)], "a long, b long, c long, d long")
    v = df.select(cell_min_sq_dist(["a", "b"], ["c", "d"])).first()[0]
    assert v == (2 ** 2 + 0) / 2


def test_uniform_hash_range_and_determinism(spark):
    df = spark.range(2000)
    a = [r[0] for r in df.select(uniform_hash("id", 3)).collect()]
    b = [r[0] for r in df.repartition(7).orderBy("id").select(uniform_hash("id", 3)).collect()]
    assert a == b and all(0.0 <= v < 1.0 for v in a)
    assert 0.4 < sum(a) / len(a) < 0.6
