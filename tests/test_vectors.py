"""Published examples and definitions of the small functions."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pairloom.config import Config, Normalization, checked_path, line_filter
from pairloom.functions import fingerprint as fp
from pairloom.functions import sequence as sq
from pairloom.functions.normalize import split_lines, text_lines
from pairloom.functions.values import values_equal
from pairloom.operators.pairing import extension_group, sizes_compatible
from pairloom.plans.report import bar, cut_path, cut_value, format_bytes
from pairloom.plans.sinks import sanitize
from pairloom.sources.detect import detect, extension, parse_header, sniff
from pairloom.sources.spreadsheet import Unsupported, number_text, read_sheet


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first()


def test_headers(spark):
    a, b, c, d = one(spark, parse_header(F.lit("id,name, value "), ","), sniff(F.lit("a,b,c"), ","), sniff(F.lit("single_column"), ","), sniff(F.lit("a,,c"), ","))
    assert (a, b, c, d) == (["id", "name", "value"], ["a", "b", "c"], None, None)
    assert one(spark, sniff(F.lit("a\tb"), "\t"), sniff(F.lit("a," + "x" * 100), ","))[:] == (["a", "b"], None)


def test_hashes(spark):
    pairs = [(0, 0, 0), (0, 1, 1), (15, 0, 4), (0, -1, 64)]
    for x, y, d in pairs:
        got = one(spark, fp.hamming(F.lit(x).cast("long"), F.lit(y).cast("long")), fp.simhash_similarity(F.lit(x).cast("long"), F.lit(y).cast("long")))
        assert got[0] == d and got[1] == 1 - d / 64
    sig = [one(spark, fp.schema_signature(F.array(*map(F.lit, c))))[0] for c in ("abc", "cba", "abd")]
    assert sig[0] == sig[1] != sig[2] and len(sig[0]) == 16


def test_simhash_by_hand(spark):
    text = "one two three\nfour five\nsix"
    df = spark.createDataFrame([(1, text), (2, "")], "id int, t string").select("id", fp.shingles(split_lines(F.col("t"))).alias("g"))
    got = {r.id: r.simhash for r in fp.simhash(df, ["id"], F.col("g")).collect()}
    grams = ["one two three", "two three four", "three four five", "four five six", text]
    hashes = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    want = sum((sum(1 if h >> i & 1 else -1 for h in hashes) > 0) << i for i in range(64))
    assert got == {1: want - (1 << 64) if want >> 63 else want, 2: 0}


@pytest.mark.parametrize("a,b,same", [("csv", "csv", 1), ("csv", "tsv", 1), ("rs", "py", 1), ("csv", "py", 0), ("txt", "", 1), ("xla", "xlsx", 0), ("foo", "foo", 1)])
def test_extensions(spark, a, b, same):
    x, y = one(spark, extension_group(F.lit(a)), extension_group(F.lit(b)))
    assert (x == y) == bool(same)


def test_sizes_and_names(spark):
    got = one(spark, *[sizes_compatible(F.lit(a), F.lit(b)) for a, b in ((100, 10000), (100, 1000), (0, 5))], *[extension(F.lit(p)) for p in ("/a/b.TXT", "/a/.hid", "/a.b/c")])
    assert got[:] == (False, True, True, "txt", "", "")


@pytest.mark.parametrize("pos,text", [([1, 2, 3, 5, 7, 8, 9], "1-3,5,7-9"), ([1], "1"), ([], "")])
def test_ranges(pos, text):
    assert sq.encode_ranges(pos) == text


@pytest.mark.parametrize("a,b,same", [
    ("1.0", "1.0001", True), ("100", "100.05", True), ("1.0", "1.1", False), ("abc", "abc", True), ("abc", "abd", False), (" 1", "1", False), ("1d", "1", False),
    ("nan", "NaN", False), ("inf", "Infinity", False), ("1e3", "1000", True), ("5.", "5", True), ("", "0", False), (None, "", True), ("0x1p3", "8", False),
])
def test_values(spark, a, b, same):
    assert one(spark, values_equal(F.lit(a), F.lit(b), 0.001))[0] is same


def test_detection(spark):
    rows = [
        (b"", "txt", "Text", 0), (b"a,b\n1,2\n", "csv", "Csv", 2), (b"a b", "csv", "Text", 1), (b"a\tb\n", "tab", "Tsv", 1), (b"x\0y", "txt", "Binary", 0),
        (b"\xff\xfe", "txt", "Binary", 0), (b"x\n" * 5000 + b"\xff", "txt", "Text", 5001), (b"Dear all, hello", "txt", "Csv", 1), (b"plain\ntext", "", "Text", 2),
    ]
    df = spark.createDataFrame([(i, bytearray(c), e) for i, (c, e, *_) in enumerate(rows)], "i int, c binary, e string")
    got = {r.i: (r.k.file_type, r.k.line_count) for r in df.select("i", detect(F.col("c"), F.col("e")).alias("k")).collect()}
    assert got == {i: (t, n) for i, (_, _, t, n) in enumerate(rows)}


def test_lines(spark):
    text = "A  \r\n\r\nb\rc\n  d  e\n"
    lines = one(spark, split_lines(F.lit(text)), text_lines(F.lit(text), Normalization(ignore_all_ws=True, ignore_case=True, skip_empty_lines=True), "[a-c]"), split_lines(F.lit("")))
    assert lines[:] == (["A  ", "", "b\rc", "  d  e"], ["<IGNORED>", "<IGNORED> <IGNORED>", "d e"], [])


def test_diff_of_three_lines():
    c = sq.compare_lines(["line1", "line2", "line3"], ["line1", "modified", "line3"], "diff", "a", "b", 1 << 20)
    assert c[:3] == (2, 1, 1) and c[3] == "1-2" and c[4] == 2 / 4
    assert sq.compare_lines(["Hello World"], ["Hello Rust"], "diff", "a", "b", 1 << 20)[5] == "--- a\n+++ b\n@@ -1 +1 @@\n-Hello World\n+Hello Rust\n"
    assert sq.unified_diff(["x" * 50] * 3, ["y"], "a", "b", 40)[1]


def brute_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_scripts_are_shortest():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in "ab")
        s = sq.edit_script(a, b)
        assert [a[i] for t, i, _ in s if t != "+"] == a and [b[j] for t, _, j in s if t != "-"] == b
        assert sum(t == "=" for t, *_ in s) == brute_lcs(a, b) == sq.lcs_length(a, b)


def test_edit_distances():
    assert sq.damerau_levenshtein("ca", "abc") == 2 and sq.damerau_levenshtein("ab", "ba") == 1 and sq.damerau_levenshtein("", "xy") == 2
    assert round(sq.jaro_winkler("martha", "marhta"), 4) == 0.9611 and sq.jaro_winkler("", "") == 1 and sq.jaro_winkler("a", "") == 0


def test_long_inputs_fall_back():
    a, b = ["x", "y"] * 1500, ["y", "x"] * 1500
    assert sq.smith_waterman(a, b) == sq.line_ratio(3000, 3000, sq.lcs_length(a, b))
    assert sq.lcs_similarity(["q"] * 5001, ["q"]) == 2 / 5002


def test_filters_and_paths(tmp_path):
    assert line_filter("[0-9]+") == "[0-9]+" and line_filter(None) is None
    for bad in ("(", "(?=x)", r"(a)\1", "x" * 1001):
        with pytest.warns(UserWarning):
            assert line_filter(bad) is None
    assert checked_path(str(tmp_path)) == str(tmp_path.resolve())
    for bad in ("", "/no/such/path", "/proc/self", "x" * 5000):
        with pytest.raises(ValueError):
            checked_path(bad)
    assert Config(numeric_tolerance=7, topk=1000).clamped().topk == 100 and Config(algorithm="tf-idf").algorithm == "tfidf"
    with pytest.raises(ValueError):
        Config(mode="nope")


@pytest.mark.parametrize("value,text", [(42.0, "42"), (3.14, "3.14"), (-1.0, "-1")])
def test_numbers(value, text):
    assert number_text(value) == text


def xlsx(path, rows):
    def cell(x):
        if isinstance(x, bool):
            return f'<c t="b"><v>{int(x)}</v></c>'
        return f'<c t="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else "<c/>" if x is None else f"<c><v>{x}</v></c>"

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")


def test_spreadsheet(tmp_path):
    xlsx(tmp_path / "a.xlsx", [["id", "v", "w"], [1, 42.0, True], [2, 3.14], ["x", None, False]])
    assert read_sheet((tmp_path / "a.xlsx").read_bytes(), "xlsx") == [["id", "v", "w"], ["1", "42", "TRUE"], ["2", "3.14", ""], ["x", "", "FALSE"]]
    with pytest.raises(Unsupported):
        read_sheet(b"\xd0\xcf\x11\xe0", "xls")


def test_presentation():
    assert sanitize("a/b:c|d") == "a_b_c_d" and format_bytes(1536) == "1.5 KB" and cut_path("x" * 50, 10) == "..." + "x" * 7 and cut_value("y" * 50, 10) == "y" * 7 + "..." and bar(0.5) == "█████░░░░░"


def test_sizes_end_with_gb():
    """a terabyte and more is shown in GB, as the SQL of format_sizes has it."""
    assert [format_bytes(x) for x in (1023, 1024, 2.0**20, 2.0**30, 2.0**40, 2.0**50)] == ["1023 B", "1.0 KB", "1.0 MB", "1.0 GB", "1024.0 GB", "1048576.0 GB"]
    assert format_bytes(None) is None
