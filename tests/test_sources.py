"""Sources and sinks: round trips and broken files."""

import gzip
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.sources import files as L
from tallyloom.sources import rest as R
from tallyloom.sources import sinks as K
from tallyloom.sources import zst as Z

LINES = [
    json.dumps({"id": "c1", "author": "ann", "body": "one two three four five six seven eight nine ten", "created_utc": 5}),
    "",
    "{broken",
    json.dumps({"name": "t3_p", "author": "bob", "title": "a title", "selftext": "and a text of more than ten words in all it is"}),
    json.dumps({"author": "[deleted]", "body": "x " * 20, "score": 7}),
    json.dumps({"author": "é", "body": "fewer words"}, ensure_ascii=False),
]


def archive(path, text, window=None, level=3):
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=window, enable_ldm=bool(window)) if window else None
    c = zstandard.ZstdCompressor(compression_params=params) if params else zstandard.ZstdCompressor(level=level)
    with open(path, "wb") as f, c.stream_writer(f) as w:
        w.write(text.encode())


def test_json_lines(spark, tmp_path):
    (tmp_path / "RC_2019-01.jsonl").write_text("\n".join(LINES) + "\n")
    with gzip.open(tmp_path / "more.jsonl.gz", "wt") as f:
        f.write(LINES[0] + "\n")
    rows = L.read_jsonl(spark, [str(tmp_path / "RC_2019-01.jsonl")], numbers=True).orderBy("line_no").collect()
    assert [r["post_id"] for r in rows] == ["c1", "t3_p", "row_5", "row_6"] and rows[3]["raw"] == LINES[5]
    assert L.read_jsonl(spark, str(tmp_path / "more.jsonl.gz")).count() == 1
    c = L.malformed_count(spark, str(tmp_path / "RC_2019-01.jsonl")).first()
    assert (c["lines"], c["blank"], c["malformed"]) == (6, 1, 1)
    with pytest.raises(Exception):
        L.read_jsonl(spark, str(tmp_path / "RC_2019-01.jsonl"), mode="FAILFAST").collect()
    p = {r["author"]: r for r in L.posts(L.read_jsonl(spark, str(tmp_path / "RC_2019-01.jsonl"))).collect()}
    assert set(p) == {"ann", "bob"} and p["bob"]["post_type"] == "submission" and p["bob"]["text"].startswith("a title and")


def test_files_by_name(tmp_path):
    for n in ("RC_2018-12.zst", "RS_2019-01.zst", "notes.txt"):
        (tmp_path / n).write_text("x")
    found = L.discover([str(tmp_path), str(tmp_path / "*.txt")])
    assert len(found) == 3 and found == sorted(found)
    assert L.period_of("RC_2018-12.zst") == (2018, 12) and L.period_of("a_2019.csv") == (2019, None) and L.period_of("x12345") == (None, None)
    assert [p[-14:] for p in L.within_years(found, 2019, 2020)] == ["RS_2019-01.zst"]


def test_paths_and_prefix(spark):
    df = spark.createDataFrame([("/d/RC_2019-01.zst",), ("/d/submissions.zst",), ("/d/x",), ("/a/my_town_comments.jsonl.gz",)], "p string")
    assert [r[0] for r in df.select(L.kind_of(F.col("p"))).collect()] == ["comments", "submissions", "unknown", "comments"]
    assert df.select(L.community_of_file(F.col("p"))).collect()[3][0] == "my_town"
    line = spark.createDataFrame([('{"author": "ann", "x": 1}',), ('{"x": 1}',)], "v string")
    assert [r[0] for r in line.select(L.prefix_author(F.col("v"))).collect()] == ["ann", ""]


def test_lists_tables_and_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" ann \n\nbob\nann\n")
    assert sorted(r[0] for r in L.read_list(spark, str(tmp_path / "a.txt")).collect()) == ["ann", "bob"]
    (tmp_path / "t.csv").write_text("text_a,text_b,label\na,b,1\nc,d,0\n")
    pairs = L.read_table(spark, str(tmp_path / "t.csv"), ("text_a", "label")).withColumn("label", F.col("label").cast("int"))
    assert L.check_pairs(pairs).count() == 2
    with pytest.raises(ValueError):
        L.check_pairs(pairs.withColumn("label", F.lit(2)))
    with pytest.raises(ValueError, match="missing_one"):
        L.read_table(spark, str(tmp_path / "t.csv"), ("missing_one",))
    (tmp_path / "ragged.csv").write_text("text,topic\nhello, world,3,,\nx,-1\nno number\n\"q\", 12 ,\n")
    assert [tuple(r) for r in L.tail_numbers(spark, str(tmp_path / "ragged.csv")).orderBy("line_no").collect()] == [(2, 3), (3, -1), (5, 12)]
    assert [r["value"] for r in L.head_in_order(spark, str(tmp_path / "ragged.csv"), 2).orderBy("line_no").collect()] == ["hello, world,3,,", "x,-1"]
    zipped = L.zip_by_place(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "o int, x string"), spark.createDataFrame([(5, "p"), (6, "q")], "o int, y string"), "o")
    assert {(r["x"], r["y"]) for r in zipped.collect()} == {("a", "p"), ("b", "q")}


def test_archives(spark, tmp_path):
    good, wide, cut, wrong = (str(tmp_path / n) for n in ("good.zst", "wide.zst", "cut.zst", "wrong.zst"))
    text = "\n".join(LINES) + "\n"
    archive(good, text)
    archive(wide, text * 50, window=31)
    import random

    archive(cut, "\n".join(f"line {i} {random.Random(i).random()}" for i in range(50_000)) + "\n")
    data = open(cut, "rb").read()
    open(cut, "wb").write(data[: len(data) // 2])
    open(wrong, "wb").write(b"not an archive at all")
    rows = Z.read_zst(spark, [good, wide, cut, wrong])
    by = {r["file"]: (r["n"], r["errors"]) for r in rows.groupBy("file").agg(F.count("value").alias("n"), F.count("error").alias("errors")).collect()}
    assert by[good] == (6, 0) and by[wide] == (300, 0) and by[wrong] == (0, 1) and 0 < by[cut][0] < 50_000
    lines = L.parse_lines(rows.where(F.col("file") == good).select("file", "line_no", "value"))
    assert lines.count() == 4
    head = {r["file"]: r["status"] for r in Z.check_archives(spark, [good, wide, cut, wrong]).collect()}
    assert head == {good: "VALID", wide: "VALID", cut: "VALID", wrong: "BAD_HEADER"}
    whole = {r["file"]: r["status"] for r in Z.check_archives(spark, [good, wide, cut, wrong], whole=True).collect()}
    assert whole == {good: "OK", wide: "OK", cut: "CORRUPTED", wrong: "CORRUPTED"}
    archive(str(tmp_path / "one.zst"), "single\n")
    assert Z.check_head(str(tmp_path / "one.zst"))[0] == "SHORT_OK"


def test_polite_client_and_pages(spark):
    waits, seen = [], []

    def transport(url):
        seen.append(url)
        if len(seen) == 1:
            return R.Reply(429, "", {"Retry-After": "3"})
        if len(seen) == 2:
            return R.Reply(503, "")
        if len(seen) == 3:
            return R.Reply(422, "")
        after = int(url.rsplit("after=", 1)[1])
        rows = [{"id": f"i{t}", "created_utc": t} for t in (10, 20, 30, 31) if t >= after][:2]
        return R.Reply(200, json.dumps({"data": rows}), {"X-RateLimit-Remaining": "1", "X-RateLimit-Reset": "9"} if len(seen) == 4 else {})

    client = R.Client(transport, waits.append)
    assert [r["id"] for r in R.author_pages("u", "ann", client, size=2)] == ["i10", "i20", "i30", "i31"]
    assert waits == [3.0, 2.0, 4.0, 9.0]
    with pytest.raises(RuntimeError):
        R.Client(lambda u: R.Reply(500, ""), lambda s: None).get("u")
    with pytest.raises(RuntimeError):
        R.Client(lambda u: R.Reply(404, ""), lambda s: None).get("u")


def test_sources_by_author_and_id(spark):
    def transport(url):
        if "ids=" in url:
            ids = url.split("ids=")[1].split("&")[0].split("%2C")
            return R.Reply(200, json.dumps({"data": [{"id": i, "x": 1} for i in ids]}))
        return R.Reply(200, json.dumps({"data": [{"id": "a", "created_utc": 1}]}))

    source = R.author_source("u", ["ann", "bob"], R.Client(transport))
    spark.dataSource.register(source)
    assert sorted(r["author"] for r in spark.read.format("author_pages").load().collect()) == ["ann", "bob"]
    ids = spark.createDataFrame([(f"i{k}",) for k in range(7)], "id string")
    assert R.fetch_ids(ids, "u", (" x", "id"), R.Client(transport)).count() == 7


def test_html_table(spark):
    html = "<table><tr><th>Rank</th><th>Bot Name</th><th>Karma</th></tr><tr><td>1</td><td> a <b>b</b></td><td>1,234</td></tr><tr><td>2</td><td>c</td><td>n/a</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page int, html string")
    rows = R.table_rows(pages, {"bot name": "bot_name", "karma": "karma"}).withColumn("karma", R.number("karma")).orderBy("place").collect()
    assert [(r["bot_name"], r["karma"]) for r in rows] == [("a b", 1234), ("c", None)]


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    rows = spark.createDataFrame([('{"a":"é","n":1}', "ann", "x", 3), ('{"a":2}', "ann", "y", 1), ('{"a":3}', 'b"ob', "x", 2)], "raw string, author string, kind string, o int")
    K.write_lines(rows, d + "/lines", gzip=True)
    assert sorted(r[0] for r in spark.read.text(d + "/lines").collect()) == sorted(r["raw"] for r in rows.collect())
    K.write_table(rows, d + "/t", ["o", "author"])
    assert spark.read.parquet(d + "/t").columns == ["o", "author"]
    K.write_table(rows, d + "/csv", ["author", "raw"], "csv")
    assert sorted(r["author"] for r in spark.read.option("header", True).option("escape", '"').csv(d + "/csv").collect()) == ["ann", "ann", 'b"ob']
    K.write_by(rows, d + "/by", ["kind"])
    assert spark.read.json(d + "/by").where("kind = 'x'").count() == 2
    nested = {json.loads(r["value"])["author"]: json.loads(r["value"])["comments"] for r in K.nested_lines(rows, "comments", order="o").collect()}
    assert nested == {"ann": [{"a": 2}, {"a": "é", "n": 1}], 'b"ob': [{"a": 3}]}
    K.write_lines(K.nested_lines(rows, "comments"), d + "/nested", "value")
    flat = L.nested(spark, d + "/nested", "comments", S._struct("a string, n bigint"))
    assert flat.count() == 3
    K.write_sorted_list(rows, d + "/list")
    assert [r[0] for r in spark.read.text(d + "/list").collect()] == ["ann", 'b"ob']
    assert K.write_summary(rows, d + "/s.json", n=F.count("raw"))["n"] == 3 and json.load(open(d + "/s.json"))["n"] == 3
    assert K.append_new(rows.where("o > 1"), d + "/app", "raw") == 2 and K.append_new(rows, d + "/app", "raw") == 1 and K.append_new(rows, d + "/app", "raw") == 0
    h = K.histogram(rows, "o", 2).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in h] == [(0, 1), (1, 2)]
    pairs = spark.createDataFrame([("ann", "bob", 0.9, 2), ("ann", "cy", 0.8, 1)], "user_1 string, user_2 string, similarity double, shared int")
    text = K.report(pairs, spark.createDataFrame([("ann", 1.0, "hello  there")], "author string, created_utc double, text string"))
    assert text.startswith("## ann") and "bob: 0.9000, 2 shared" in text and "> hello there" in text
