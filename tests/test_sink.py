import os

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import encode, images, sink

from .test_pipeline_fitted import picture


def rows(spark, named, parts=4):
    return spark.createDataFrame(named, "name string, content binary").repartition(parts)


def test_files_appear_together(spark, tmp_path):
    many = [(f"f{i}", bytes([i]) * i) for i in range(50)]
    sink.save(rows(spark, [*many, ("none", None)]), str(tmp_path), "name", extension=".bin")
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {f"{n}.bin": c for n, c in many}
    # A second job adds; a file of an old name is replaced; overwriting drops the rest of that extension.
    (tmp_path / "other.txt").write_text("kept")
    sink.save(rows(spark, [("f1", b"new"), ("g", b"g")]), f"file://{tmp_path}", "name", extension=".bin")
    assert (tmp_path / "f1.bin").read_bytes() == b"new" and len(list(tmp_path.iterdir())) == 52
    sink.save(rows(spark, [("h", b"h")]), str(tmp_path), "name", extension=".bin", overwrite=True)
    assert sorted(os.listdir(tmp_path)) == ["h.bin", "other.txt"]
    sink.save(rows(spark, []), str(tmp_path), "name", extension=".bin")
    assert sorted(os.listdir(tmp_path)) == ["h.bin", "other.txt"]


@pytest.mark.parametrize("bad", [[("x", b"1"), ("x", b"2")], [("a/b", b"1")], [("..", b"1")], [("", b"1")]])
@pytest.mark.parametrize("parts", [1, 5])
def test_nothing_appears_on_an_error(spark, tmp_path, bad, parts):
    with pytest.raises(Exception):
        sink.save(rows(spark, [("good", b"0"), *bad], parts), str(tmp_path), "name")
    assert os.listdir(tmp_path) == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    d = rows(spark, [(str(i), b"x") for i in range(20)]).withColumn("content", F.when(F.col("name") == "7", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        sink.save(d, str(tmp_path), "name")
    assert os.listdir(tmp_path) == []


def test_losing_attempts(tmp_path):
    """Of two attempts of a task only the accepted one's file is published."""
    w = sink.FileWriter(str(tmp_path), False, ".png")
    first = w.write(iter([{"name": "a", "content": b"1"}]))
    w.write(iter([{"name": "a", "content": b"1"}, {"name": "half", "content": b"2"}]))
    w.commit([first, None])
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a.png": b"1"}


def test_images_to_files_and_back(spark, tmp_path):
    px = picture(spark, [(9, 5), (6, 8)])
    sink.save(encode.encode(px.drop("a"), "TIFF"), str(tmp_path), extension=".tif")
    back = images.load(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.y, r.x): (r.r, r.g, r.b) for r in back.collect()}
    want = {(f"{r.image_id}.tif", r.y, r.x): (r.r, r.g, r.b) for r in px.collect()}
    assert set(got) == set(want)
    assert all(abs(a - b) <= 0.5 / 255 + 1e-9 for k in want for a, b in zip(got[k], want[k]))
