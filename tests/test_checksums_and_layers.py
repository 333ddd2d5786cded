import hashlib

from rasterloom.operators import models
from rasterloom.plans import catalogue, catalogue_jobs, config  # noqa: F401


def test_checksums(spark, tmp_path):
    want = {}
    for name, content in (("a.onnx", b"one"), ("b.onnx", b"\x00two")):
        (tmp_path / name).write_bytes(content)
        want[name] = hashlib.sha256(content).hexdigest()
    got = models.checksums(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {g.path.rsplit("/", 1)[1]: g.sha256 for g in got} == want


def test_option_layers_calls_the_operators(spark, monkeypatch):
    called = []
    for name in ("options_from", "form_fields"):
        monkeypatch.setattr(config, name, lambda *a, f=getattr(config, name), n=name: called.append(n) or f(*a))
    catalogue.QUERIES["option_layers"](spark, "/root/testdata/sf0.001")
    assert sorted(called) == ["form_fields", "options_from"]
