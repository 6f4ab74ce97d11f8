"""The command line on a small file."""

import json

from gristmill.__main__ import main, parse, run


def test_parse():
    assert parse(["top", "a.csv", "--keys", "x:desc", "--k=3", "--smallest"]) == (["top", "a.csv"], {"keys": "x:desc", "k": 3, "smallest": True})


def test_verbs(spark, tmp_path, capsys):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("id,v\n1,5\n2,7\n3,9\n")
    b.write_text("id,v\n1,5\n2,8\n4,1\n")
    assert json.loads(run(spark, ["inspect", str(a)], {}))["rows"] == 3
    assert "│ 9" in run(spark, ["top", str(a)], {"keys": "v", "k": 1})
    run(spark, ["run", str(a)], {"filter": "v > 5", "sort": "v:desc", "out": str(tmp_path / "o.csv")})
    assert (tmp_path / "o.csv").read_text() == "id,v\n3,9\n2,7\n"
    assert "removed" in run(spark, ["diff", str(a), str(b)], {"keys": "id"})
    assert "v_right" in run(spark, ["join", str(a), str(b)], {"on": "id", "how": "left"})
    assert "1. filter" in run(spark, ["explain", str(a)], {"filter": "v > 5"})
    assert "│" in run(spark, ["generate", "id:seq,n:name"], {"n": 3})
    assert main(["nope", str(a)]) == 2 and main(["top", str(a), "--wrong", "1"]) == 2
    assert "unknown verb" in capsys.readouterr().err
