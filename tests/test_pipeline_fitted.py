import numpy as np

from rasterloom.plans import pipeline


def picture(spark, sizes):
    r = np.random.default_rng(3)
    rows = [(i, h, w, y, x, *map(float, r.random(4))) for i, (h, w) in enumerate(sizes) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, r double, g double, b double, a double").coalesce(2)


def sizes_of(df):
    p = df.toPandas()
    assert p[["r", "g", "b", "a"]].notna().all().all()
    out = {}
    for i, g in p.groupby("image_id"):
        assert len(g) == g.h.iloc[0] * g.w.iloc[0] == len(g[["y", "x"]].drop_duplicates())
        out[i] = (int(g.h.iloc[0]), int(g.w.iloc[0]))
    return out


def test_target_size_keeps_alpha_and_backend(spark):
    px = picture(spark, [(4, 6), (5, 5)])
    out = pipeline.enhance(px, pipeline.Options(longest_side=12, detail=0.0, backend="nearest", alpha_mode="nearest"))
    assert sizes_of(out) == {0: (8, 12), 1: (12, 12)}
    src = {(p.y, p.x): p for p in px.where("image_id = 0").collect()}
    for p in out.where("image_id = 0").collect():
        s = src[p.y // 2, p.x // 2]
        assert max(abs(p.r - s.r), abs(p.g - s.g), abs(p.a - s.a)) < 1e-12


def test_max_pixels_without_target_size(spark):
    px = picture(spark, [(10, 10)])
    assert sizes_of(pipeline.enhance(px, pipeline.Options(scale=4.0, detail=0.0, max_pixels=400))) == {0: (20, 20)}


def test_tiles_are_as_wide_as_their_margins(spark, monkeypatch):
    from rasterloom.operators import tilework

    seen, cut = [], tilework.cut_with_margin
    monkeypatch.setattr(tilework, "cut_with_margin", lambda *a: seen.append(cut(*a)) or seen[-1])
    px = spark.range(400 * 8).selectExpr("0L AS image_id", "400 AS h", "8 AS w", "CAST(id DIV 8 AS INT) AS y", "CAST(id % 8 AS INT) AS x", "0.1D AS r", "0.2D AS g", "0.3D AS b")
    pipeline.enhance(px, pipeline.with_options("quality", scale=2.0, tile=16, auto_levels=0.0))
    assert 400 * 8 < seen[-1].count() <= 3 * 400 * 8
