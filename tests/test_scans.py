import numpy as np
import pytest

from rasterloom.operators import neighbourhood
from tests.test_operators import back, box, field, wave


@pytest.mark.parametrize("r, block", [(1, 1), (1, 64), (4, 5), (7, 7), (8, 7), (9, 1), (40, 8), (40, 64)])
def test_blocks_equal_whole_lines(spark, r, block):
    v = wave()
    assert np.allclose(back(neighbourhood.box_blur(field(spark, v), ["v"], r, block=block)), box(v, r), atol=1e-12)


@pytest.mark.parametrize("block", [2, 16])
def test_gaussian_and_guided_by_blocks(spark, block):
    v = wave()
    d = field(spark, v)
    assert np.allclose(back(neighbourhood.gaussian_blur(d, ["v"], 1.5, block=block)), back(neighbourhood.gaussian_blur(d, ["v"], 1.5)), atol=1e-12)
    by_blocks, whole = (neighbourhood.guided_filter(d, ["v"], ["v"], 3, 1e-3, block=b) for b in (block, None))
    assert np.allclose(back(by_blocks), back(whole), atol=1e-12)


@pytest.mark.parametrize("r", [3, 30])
def test_images_of_many_sizes_keep_their_columns(spark, r):
    g = np.random.default_rng(5)
    sizes = {1: (1, 1), 2: (1, 50), 3: (17, 2), 4: (4, 9)}
    images = {k: g.normal(size=s) for k, s in sizes.items()}
    rows = [(k, *v.shape, y, x, float(v[y, x]), float(-v[y, x]), f"{y}-{x}") for k, v in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    df = spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, v double, other double, note string")
    out = neighbourhood.box_blur(df, ["v", "other"], r, block=5)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = out.collect()
    assert len(got) == len(rows) and all(o.note == f"{o.y}-{o.x}" for o in got)
    for k, v in images.items():
        want = box(v, r)
        assert all(abs(o.v - want[o.y, o.x]) < 1e-12 and abs(o.other + want[o.y, o.x]) < 1e-12 for o in got if o.image_id == k)


@pytest.mark.parametrize("r", [2, 30])
def test_a_line_is_no_window_group(spark, r):
    out = neighbourhood.box_blur(field(spark, wave(1, 400)), ["v"], r, axes="x", block=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [p for p in plan.splitlines() if "Exchange hashpartitioning" in p and "__block" in p]
    assert dealt and np.allclose(back(out), box(wave(1, 400), r), atol=1e-12)


def test_empty_and_bad_blocks(spark):
    df = spark.createDataFrame([], "image_id long, h int, w int, y int, x int, v double")
    assert neighbourhood.box_blur(df, ["v"], 2, block=4).count() == 0
    assert neighbourhood.box_blur(df, ["v"], 9, block=4).count() == 0
    with pytest.raises(ValueError):
        neighbourhood.box_blur(df, ["v"], 2, block=0)
