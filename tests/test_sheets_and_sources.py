"""S2 sheet files through N1-N13, and the other sources/sinks."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import sheets as N
from pacegrid.sources import files as S
from pacegrid.sources import sinks

SHEETS = {
    # layout A: padded, mixed-case headers; two headers equal after folding
    "bank/DSA Practice.csv": [
        ["Problem", " topic ", "DIFFICULTY", "Link", "Due", "Topic"],
        ["Two Sum", "Arrays", "hard", "leetcode.com/x", "2026-03-04", "Hashing"],
        ["nan", "Arrays", "easy", "", "", ""],
        ["  Valid Parens ", "Stack", "must", "//www.geeksforgeeks.org/p", "01/02/2026", ""],
        ["Knapsack", "DP", "whatever", "http://neetcode.io/k", "13/02/2026", "DP2"],
        ["Word Break", "DP", "Medium", "none", "March 5 2026", ""],
        ["Clock", "Math", "easy", "", "Day 1", ""],
    ],
    # layout B: topic list
    "bank/Revision.csv": [["Topic", "Priority", "Ref"], ["Joins", "must", "site.org/j"], ["Views", "optional", ""],
                          ["NONE", "high", "x.y"], ["Triggers", "", "http://w3schools.com/t"]],
    # layout C: day grid (no name alias among the headers)
    "plan/hr round.csv": [["Day", "DSA", "Aptitude", "HR", "Misc"], ["1", "Stack", "", "intro", "nan"],
                          ["", "Queue", "ratios", "", ""], ["Day 2", "Heap", "nan", "", "notes"]],
    # layout D: unknown headers
    "misc/Sheet1.csv": [["c1", "c2", "c3"], ["Graphs", "BFS", "http://x.y"], ["nan", "", ""], ["Trees", "nan", "ok"]],
    # empty sheet: header row only
    "misc/Empty.csv": [["Problem", "Topic"]],
}


@pytest.fixture(scope="module")
def sheet_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("sheets")
    import csv
    for name, rows in SHEETS.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", newline="") as f:
            csv.writer(f).writerows(rows)
    return str(root)


def test_sheets_normalise_every_layout(spark, sheet_dir):
    cells = S.read_sheets(spark, f"{sheet_dir}/*/*.csv")
    tasks = {(r.sheet, r.name): r for r in N.normalise(cells).collect()}
    a = tasks[("DSA Practice", "Two Sum")]
    assert (a.topic, a.difficulty, a.problem_link, a.platform, a.scheduled_date, a.category) == (
        "Hashing", "Hard", "https://leetcode.com/x", "LeetCode", dt.date(2026, 3, 4), "DSA")
    vp = tasks[("DSA Practice", "Valid Parens")]
    assert (vp.difficulty, vp.problem_link, vp.platform, vp.scheduled_date) == (
        "High", "https://www.geeksforgeeks.org/p", "GFG", dt.date(2026, 1, 2))
    assert tasks[("DSA Practice", "Knapsack")].scheduled_date == dt.date(2026, 2, 13)
    assert tasks[("DSA Practice", "Knapsack")].difficulty == "Medium"
    assert tasks[("DSA Practice", "Word Break")].scheduled_date == dt.date(2026, 3, 5)
    assert tasks[("DSA Practice", "Word Break")].problem_link == ""
    assert tasks[("DSA Practice", "Clock")].scheduled_date is None
    assert ("DSA Practice", "nan") not in tasks
    # layout B
    j = tasks[("Revision", "Joins")]
    assert (j.topic, j.difficulty, j.problem_link, j.resource_link) == (
        "Joins", "High", "https://site.org/j", "https://site.org/j")
    assert tasks[("Revision", "Views")].difficulty == "Low"
    assert tasks[("Revision", "Triggers")].platform == "W3Schools"
    assert ("Revision", "NONE") not in tasks
    # layout C: blank day rows and blank cells dropped; category by header
    grid = {(r.name, r.topic, r.category) for r in N.normalise(cells).filter(F.col("sheet") == "hr round").collect()}
    assert grid == {("Stack", "DSA", "DSA"), ("intro", "HR", "Verbal"), ("Heap", "DSA", "DSA"),
                    ("notes", "Misc", "DSA")}   # N7 runs on the header text, not the sheet name
    # layout D
    g = tasks[("Sheet1", "Graphs")]
    assert (g.topic, g.problem_link, g.category) == ("BFS", "http://x.y", "DSA")
    assert tasks[("Sheet1", "Trees")].topic == "ok"


def test_layouts_and_header_map(spark, sheet_dir):
    h = N.sheet_headers(S.read_sheets(spark, f"{sheet_dir}/*/*.csv"))
    lay = {r.sheet: r.layout for r in N.sheet_layouts(h).collect()}
    assert lay == {"DSA Practice": "A", "Revision": "B", "hr round": "C", "Sheet1": "D"}
    m = {(r.sheet, r.field): r.header for r in N.header_map(h).collect()}
    assert m[("DSA Practice", "topic")] == "Topic"          # last of the folded duplicates
    assert m[("DSA Practice", "difficulty")] == "DIFFICULTY"


def test_corrupt_file_policy(spark, sheet_dir, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b"\xff\xfe\x00broken")
    good = tmp_path / "good.csv"
    good.write_text("Problem,Topic\nA,B\n")
    with pytest.raises(Exception):
        S.read_sheets(spark, f"{tmp_path}/*.csv").collect()
    ok = S.read_sheets(spark, f"{tmp_path}/*.csv", on_error="skip").collect()
    assert {r.source_file.rsplit("/", 1)[1] for r in ok} == {"good.csv"}
    report = {(r.sheet, r.error) for r in S.sheet_report(spark, f"{tmp_path}/*.csv").collect()}
    assert report == {("good", None), ("bad", "not UTF-8 text")}


CSV_TRAPS = [
    ["Name", 'Topic "x"', " Link "], ["plain", "a,b", 'say ""hi""'], ["", "", ""], ['5" disk', 'mid"quote', "end"],
    ["short"], ["one", "two", "three", "four"], ["line one\nline, two\n\nline four", 'q"\n"q', "z"], ["ünï", "日本", "x\ty"],
    ['"', '""', '","'], [",", ",,", "\n"], ["last", "", "no newline"]]


def _written(rows, path, **how):
    import csv
    import io
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", **how).writerows(rows)
    path.write_bytes(out.getvalue().rstrip("\n").encode())
    return list(csv.reader(io.StringIO(out.getvalue())))


@pytest.mark.parametrize("bom", [b"", b"\xef\xbb\xbf"])
@pytest.mark.parametrize("spanning", [False, True])
def test_csv_records_as_the_csv_module_reads_them(spark, tmp_path, spanning, bom):
    import csv
    rows = [r for r in CSV_TRAPS if spanning or not any("\n" in x for x in r)]
    want = _written(rows, tmp_path / "Trap 50%+x.csv", quoting=csv.QUOTE_MINIMAL)
    (tmp_path / "Trap 50%+x.csv").write_bytes(bom + (tmp_path / "Trap 50%+x.csv").read_bytes())
    got = S.read_sheets(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [r["values"] for r in got] == [r or [""] for r in want[1:]]
    assert {tuple(r.headers) for r in got} == {tuple(x.strip() for x in want[0])}
    assert {r.sheet for r in got} == {"Trap 50%+x"} and [r.row_no for r in got] == list(range(1, len(got) + 1))
    assert [r.error for r in S.sheet_report(spark, str(tmp_path)).collect()] == [None]


def test_a_large_csv_file_is_read_by_many_tasks(spark, tmp_path):
    want = _written([["Name", "Topic"]] + [[f"task {k}", f'topic "{k}", {k % 7}'] for k in range(4000)], tmp_path / "big.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = S.read_sheets(spark, str(tmp_path / "big.csv"))
        assert S._file_lines(spark, str(tmp_path / "big.csv")).select("block").distinct().count() > 10
        got = rows.orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["values"] for r in got] == want[1:]
    assert len({r.row_no for r in got}) == len(got)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_normalisation_neither_explodes_nor_gathers_cells(spark):
    rows = spark.createDataFrame([("f", "s", 1, ["Name"], ["x"])], S.ROWS_SCHEMA)
    plan = N.normalise(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect" not in plan
    assert plan.count("Generate") == 1      # the tasks of a row


def test_cells_and_rows_give_the_same_tasks(spark, sheet_dir):
    rows = S.read_sheets(spark, f"{sheet_dir}/*/*.csv")
    cells = rows.select("source_file", "sheet", "row_no", F.posexplode(F.arrays_zip("headers", "values")).alias("k", "c")).select(
        "source_file", "sheet", "row_no", (F.col("k") + 1).alias("col_no"), F.col("c.headers").alias("header"), F.col("c.values").alias("value"))
    assert sorted(map(str, N.normalise(cells).collect())) == sorted(map(str, N.normalise(rows).collect()))


def test_task_lists_json(spark, tmp_path):
    p = tmp_path / "req.json"
    p.write_text(json.dumps({"user_id": 7, "mode": "add", "filename": "f.xlsx",
                             "tasks": [{"name": " A ", "topic": "t"}, {"name": "B", "scheduled_date": "2026-01-02"}]}))
    rows = S.read_task_lists(spark, str(p)).orderBy("pos").collect()
    assert [(r.user_id, r.pos, r.name, r.scheduled_date) for r in rows] == [
        (7, 0, " A ", None), (7, 1, "B", dt.date(2026, 1, 2))]


def test_rss_and_json_feeds(spark, tmp_path):
    rss = tmp_path / "feed.xml"
    rss.write_text("<rss><channel><item><title>T1</title><link>http://a</link></item>"
                   "<item><title>GPU news</title><link>http://b</link></item></channel></rss>")
    got = [(r.title, r.url) for r in S.read_rss(spark, str(rss), "rss").orderBy("seq").collect()]
    assert got == [("T1", "http://a"), ("GPU news", "http://b")]
    js = tmp_path / "items.json"
    js.write_text(json.dumps([{"id": 1, "title": "x", "url": "u", "score": 30}]))
    assert S.read_json_feed(spark, str(js), "hn").first().score == 30


def test_json_columns(spark):
    df = spark.createDataFrame([("[{\"title\":\"a\",\"url\":\"u\",\"source\":\"s\",\"score\":3,\"tag\":\"t\"}]",),
                                ("not json",)], "j string")
    sizes = [r[0] for r in df.select(F.size(S.decode_articles("j"))).collect()]
    assert sizes == [1, 0]
    txt = spark.createDataFrame([('Sure! {"youtube": "y", "article": "a",\n "practice": "p"} and {"x": 1}',),
                                 ("no block",)], "t string")
    got = [r[0] for r in txt.select(S.first_json_block("t")).collect()]
    assert got[0].youtube == "y" and got[0].practice == "p"
    assert got[1] is None
    assert json.loads(S.rows_as_json(spark.createDataFrame([(1, "a")], "x int, y string")).first().json) == {
        "x": 1, "y": "a"}


def test_daily_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert sinks.read_daily_cache(spark, path, "2024-01-20") is None
    sinks.write_daily_cache(spark.createDataFrame([("a", 1)], "title string, score int"), path, "2024-01-19")
    sinks.write_daily_cache(spark.createDataFrame([("b", 2)], "title string, score int"), path, "2024-01-20")
    today = sinks.read_daily_cache(spark, path, "2024-01-20")
    assert [r.title for r in today.collect()] == ["b"]
    assert sinks.read_daily_cache(spark, path, "2024-01-19") is None      # other days expired
    assert [d for d in os.listdir(path) if d.startswith("cache_date=")] == ["cache_date=2024-01-20"]
