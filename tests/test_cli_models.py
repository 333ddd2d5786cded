import json

from rasterloom import cli


def run(capsys, *args):
    assert cli.main(["models", *args]) == 0
    return capsys.readouterr().out


def test_list_and_usage(spark, tmp_path, capsys):
    sub = tmp_path / "more"
    sub.mkdir()
    (tmp_path / "x4plus.onnx").write_bytes(b"0123456789")
    (tmp_path / "x4plus_fp16.onnx").write_bytes(b"01234")
    (sub / "animevideov3.pth").write_bytes(b"abc")
    (sub / "general-x4v3_fp16.onnx").write_bytes(b"ab")
    (tmp_path / "unknown.onnx").write_bytes(b"a")
    rows = {r["name"]: r for r in json.loads(run(capsys, "list", "--folder", str(tmp_path), "--json"))}
    assert list(rows) == sorted(rows) and len(rows) == 5
    assert {n for n, r in rows.items() if r["present"]} == {"x4plus", "animevideov3", "general-x4v3"}
    assert rows["x4plus"]["onnx"].endswith("/x4plus.onnx") and rows["x4plus"]["weights"] is None
    assert rows["general-x4v3"]["onnx"].endswith("_fp16.onnx") and rows["animevideov3"]["weights"].endswith(".pth")
    lines = run(capsys, "list", "--folder", str(tmp_path)).splitlines()
    assert [line[:3] for line in lines] == ["[x]" if rows[n]["present"] else "[ ]" for n in rows]
    assert json.loads(run(capsys, "usage", "--folder", str(tmp_path))) == {"files": 5, "bytes": 21}


def test_empty_folder(spark, tmp_path, capsys):
    assert json.loads(run(capsys, "usage", "--folder", str(tmp_path))) == {"files": 0, "bytes": 0}
    assert not any(r["present"] for r in json.loads(run(capsys, "list", "--folder", str(tmp_path), "--json")))
