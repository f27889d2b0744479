import json

import pytest

from pairloom import cli
from pairloom.config import Config, Normalization
from pairloom.operators import pairing
from pairloom.plans import sinks
from pairloom.plans.compare import compare
from pairloom.plans.results import summarize
from pairloom.sources.files import list_files, read_table
from test_vectors import xlsx


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    d = tmp_path_factory.mktemp("roots")

    def put(path, data):
        (d / path).parent.mkdir(parents=True, exist_ok=True)
        (d / path).write_bytes(data if isinstance(data, bytes) else data.encode())

    put("a/x.txt", "Hello World\n")
    put("b/x.txt", "Hello Rust\n")
    put("a/t.csv", 'id,v,w\n1,"a, b",1.0\n2,b,2\n2,c,3\n\n')
    put("b/t.csv", 'id,v,w\n1,"a, b",1\n2,b,2.5\n3,d\n')
    put("a/bin.dat", b"\0\1\2")
    put("b/bin.dat", b"\0\1\3")
    put("a/_h.md", "same\n")
    put("b/sub/.h2.md", "same\n")
    put("a/bad.log", b"x\n" * 5000 + b"\xff\n")
    put("b/bad.log", b"x\n" * 5000 + b"\xff\xfe\n")
    put("a/skip/gone.txt", "never")
    xlsx(d / "a/s.xlsx", [["id", "v"], [1, 2], [2, 3.5]])
    xlsx(d / "b/s.xlsx", [["id", "v"], [1, 2.0], [2, 4]])
    put("a/old.xls", b"\xd0\xcf\x11\xe0one")
    put("b/old.xls", b"\xd0\xcf\x11\xe0two")
    return d


def test_folders(spark, roots, tmp_path):
    stages = []
    done = compare(spark, f"{roots}/a", f"{roots}/b", Config(pairing="same-name", exclude=("skip",), output_root=str(tmp_path / "run"), out_csv=str(tmp_path / "r.csv")), stages.append)
    got = {r.file1_path.rpartition("/")[2]: r for r in done.results.collect()}
    assert stages[0] == "index" and stages[-1] == "done"
    assert set(got) == {"x.txt", "t.csv", "bin.dat", "bad.log", "s.xlsx", "old.xls"}
    assert (got["x.txt"].type, got["x.txt"].similarity_score, got["x.txt"].different_positions) == ("Text", 0.0, "0-1")
    t = got["t.csv"]
    assert (t.type, t.common_records, t.only_in_file1, t.only_in_file2, t.total_field_mismatches) == ("Structured", 2, 1, 1, 1)
    assert [(m.column_name, m.sample_mismatches[0][:]) for m in t.field_mismatches] == [("w", ("2", "2", "2.5"))]
    assert (got["bin.dat"].type, got["bin.dat"].identical, got["bad.log"].type, got["old.xls"].type) == ("HashOnly", False, "Error", "Error")
    assert got["s.xlsx"].total_field_mismatches == 1 and got["s.xlsx"].common_records == 2
    assert (done.stats["pairs_compared"], done.stats["error_pairs"], done.stats["total_files_set1"]) == (6, 2, 7)

    to = sinks.save(done, Config(output_root=str(tmp_path / "run"), out_csv=str(tmp_path / "r.csv")))
    lines = [json.loads(x) for x in (tmp_path / "run/results.jsonl").read_text().splitlines()]
    assert len(lines) == 6 and all("type" in x for x in lines) and "detailed_diff" not in next(x for x in lines if x["type"] == "HashOnly")
    again = sinks.load_jsonl(spark, f"{to}/results.jsonl")
    assert summarize(again).first().pairs_compared == 6
    assert len((tmp_path / "r.csv").read_text().splitlines()) == 7
    assert len(list((tmp_path / "run/artifacts/patches").glob("*.diff"))) == 1 and len(list((tmp_path / "run/artifacts/mismatches").glob("*.json"))) == 2
    page = (tmp_path / "run/report.html").read_text()
    assert "Hello Rust" in page and "<script>" in page


def test_all_against_all(spark, roots):
    done = compare(spark, f"{roots}/a", f"{roots}/b", Config(topk=1, exclude=("*.xls*", "bad*", "skip"), algorithm="jaccard", normalization=Normalization(ignore_case=True)))
    got = {r.file1_path.rpartition("/")[2]: r for r in done.results.collect()}
    assert got["_h.md"].identical and got["_h.md"].file2_path.endswith(".h2.md")
    assert got["x.txt"].similarity_score == pytest.approx(1 / 3)


def test_two_files_and_forced_mode(spark, roots):
    r = compare(spark, f"{roots}/a/x.txt", f"{roots}/b/x.txt", Config(mode="structured")).results.first()
    assert r.type == "Error" and r.linked_id.endswith("x.txt")


def test_listing(roots):
    names = [rel for _, rel in list_files(f"{roots}/a", ("skip",))]
    assert "_h.md" in names and not any("gone" in n for n in names) and names == sorted(names)
    with pytest.warns(UserWarning):
        list_files(f"{roots}/a", ("[x",))
    with pytest.raises(FileNotFoundError):
        list_files(f"{roots}/nope")


def test_table_reader(spark, roots):
    rows = read_table(spark, f"{roots}/b/t.csv").orderBy("_ord").collect()
    assert [tuple(r)[:3] for r in rows] == [("1", "a, b", "1"), ("2", "b", "2.5"), ("3", "d", "")]


def files(spark, *rows):
    full = [(p, p, p, size, kind, "txt", h, s, None) for p, size, kind, h, s in rows]
    return spark.createDataFrame(full, "path string, rel_path string, name string, size long, file_type string, extension string, content_hash string, simhash long, schema_signature string")


def test_crossed_exact_pairs_and_topk(spark):
    a = files(spark, ("a1", 10, "Text", "h1", 0), ("a2", 10, "Text", "h2", 0))
    b = files(spark, ("b1", 10, "Text", "h2", 0), ("b2", 10, "Text", "h1", 0), ("b3", 10, "Text", "h1", 0))
    assert {(r.path1, r.path2) for r in pairing.match_exact(a, b).collect()} == {("a1", "b2"), ("a2", "b1")}
    assert pairing.match_similar(a, b, 2).count() == 4
    assert pairing.match_all(a, b).count() == 2


def test_command_line(spark, roots, tmp_path, capsys):
    assert cli.main(["compare", f"{roots}/a/x.txt", f"{roots}/b/x.txt", "-o", str(tmp_path / "o"), "--similarity", "n-gram"]) == 0
    assert "pairs_compared" in capsys.readouterr().out
    assert cli.main(["report", "-i", str(tmp_path / "o/results.jsonl"), "--html", str(tmp_path / "again.html")]) == 0
    assert (tmp_path / "again.html").exists()
