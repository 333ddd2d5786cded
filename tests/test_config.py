import json

import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.operators import models
from rasterloom.plans import config
from rasterloom.plans.pipeline import Options
from rasterloom.sources import images, tables


@pytest.mark.parametrize("name,text", [("a.json", '{"preset": "fast", "options": {"detail": 0.1, "colour": 1}}'), ("a.toml", 'preset = "fast"\n[options]\ndetail = 0.1\ncolour = 1'), ("a.yaml", "preset: fast\noptions:\n  detail: 0.1\n  colour: 1")])
def test_layers(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    o = config.load(str(tmp_path / name), scale=3.0, width=None)
    assert (o.scale, o.detail, o.detail_radius, o.width, o.extra) == (3.0, 0.1, 3, None, {"colour": 1})


def test_wrong_files(tmp_path):
    (tmp_path / "a.json").write_text("[1]")
    (tmp_path / "b.json").write_text('{"tiles": 1}')
    for name in ("a.json", "b.json", "none.json"):
        with pytest.raises(config.ConfigError):
            config.load(str(tmp_path / name))


def test_requests(spark):
    d = spark.createDataFrame([({"scale": "2.5", "tile": "x", "odd": "1"},), ({"options": '{"tile": "64"}', "tile": "32"},)], "form map<string,string>")
    rows = d.select(config.options_from(config.form_fields(F.col("form")), Options()).alias("o"), config.extras("form").alias("e")).collect()
    assert (rows[0].o.scale, rows[0].o.tile, rows[0].e) == (2.5, 512, {"odd": "1"})
    assert rows[1].o.tile == 64 and rows[1].o.scale == 4.0
    b = spark.createDataFrame([("auto", "m.onnx", None, None), (None, None, None, "w.pth"), ("nearest", "m.onnx", None, None), (None, None, None, None)], "backend string, path string, onnx string, weights string")
    assert [r[0] for r in b.select(config.backend_name(*(F.col(c) for c in b.columns))).collect()] == ["onnx", "torch", "nearest", "classical"]
    m = spark.createDataFrame([("x4plus",), ("what",), ("own.onnx",), ("classical",)], "model string")
    assert {r.model: r.error for r in config.resolve_models(m, models.catalogue(spark)).collect()} == {"x4plus": None, "what": "unknown model what", "own.onnx": None, "classical": None}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    images.write_files(images.encode_png(tables.synthetic(spark, 8)), str(tmp_path / "in"))
    run = lambda *a: cli.main(["batch", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--scale", "2", "--detail", "0", *a])
    assert run() == 0 and json.loads(capsys.readouterr().out) == {"ok": 1}
    assert images.probe(spark.read.format("binaryFile").load(str(tmp_path / "out"))).first().width == 16
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    assert run() == 1 and json.loads(capsys.readouterr().out) == {"skipped": 1, "error": 1}
    assert cli.main(["--config", str(tmp_path / "none"), "capabilities"]) == 0 and cli.main(["--config", str(tmp_path / "none"), "benchmark"]) == 2
