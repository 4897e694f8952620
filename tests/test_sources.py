"""Export texts and zip archives on small made-up inputs."""

import json
import zipfile

from ledgerlens.sources.exports import read_exports, write_exports, written_exports
from ledgerlens.sources.zip_json import read_zip_json


def test_exports_shapes_and_errors(spark):
    texts = [
        ("a", json.dumps({"fileName": " f.pdf ", "fields": {"invoice_no": "X1", "o": {"p": 1}, "z": None, "n": 2}})),
        ("b", json.dumps({"documents": ["x", 4, [], None, {"invoices": [{"k": "1"}, 5]}, {"extraction": {"layoutTemplateId": 3}}]})),
        ("g", '{"fileName": 12, "fields": {"a": 1e3, "b": 1e21, "c": 1.50, "d": 2.5e-7, "e": true, "f": 0.0001, "g": 120000000.5, "h": -3.0, "i": 1.5e20}}'),
        ("h", '{"documents": [1, "y"]}'),
        ("c", "[1]"),
        ("d", "{"),
        ("e", None),
        ("f", json.dumps({"invoicesWithSublist": [{"invoice": {"k": "v"}, "sublist": [{"t": 1.5}]}], "fields": {"k": "no"}})),
    ]
    docs, errors = read_exports(spark.createDataFrame(texts, "path string, text string"))
    got = {(r.path, r.doc_pos): r for r in docs.collect()}
    assert sorted(got) == [("a", 0), ("b", 0), ("b", 1), ("f", 0), ("g", 0)]
    assert got["g", 0].file_name == "g"
    assert got["g", 0].invoices[0].header == {"a": "1000", "b": "1e+21", "c": "1.5", "d": "2.5e-7", "e": "true", "f": "0.0001", "g": "120000000.5", "h": "-3", "i": "150000000000000000000"}
    assert got["a", 0].file_name == "f.pdf" and got["a", 0].invoices[0].header == {"invoice_no": "X1", "o": "", "z": "", "n": "2"}
    assert [i.header for i in got["b", 0].invoices] == [{"k": "1"}, {}] and got["b", 0].file_name == "b"
    assert got["b", 1].template_id is None and got["b", 1].invoices == []
    assert got["f", 0].invoices[0].header == {"k": "v"} and got["f", 0].invoices[0].sublist == [{"t": "1.5"}]
    assert sorted(r.path for r in errors.collect()) == ["c", "d", "e"]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for name, text in (("a/b.json", '{"é": 1}'), ("__MACOSX/a.json", "x"), ("b/__MACOSX/a.json", "x"), ("a/.c.json", "x"), ("d.JSON", "{}"), ("empty.json", ""), ("e.txt", "x")):
            z.writestr(name, text)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = {(r.archive.rsplit("/", 1)[1], r.path): r.text for r in read_zip_json(spark, str(tmp_path)).collect()}
    assert got == {("one.zip", "a/b.json"): '{"é": 1}', ("one.zip", "d.JSON"): "{}", ("bad.zip", None): None}


def test_exports_as_files(spark, tmp_path):
    made = [("1", "a b.json", '{"x":\n 1}'), ("1", "c=d/e.json", "{}"), ("2", "a b.json", "é\n\n")]
    docs = spark.createDataFrame(made, "job string, file_name string, text string")
    for _ in range(2):
        write_exports(docs, str(tmp_path / "out"))
    assert sorted(map(tuple, written_exports(spark, str(tmp_path / "out")).collect())) == sorted(made)
