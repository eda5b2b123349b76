"""Column functions against small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import dates, scores, text


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_normalize_name(spark):
    row = one(spark, *[text.normalize_name(F.lit(x)) for x in ("  Foo,  BAR！ ", "a　b", "", "（草稿）x")])
    assert list(row) == ["foo bar", "a b", "", "草稿 x"]
    assert one(spark, text.normalize_name(F.lit(None).cast("string")))[0] == ""


def test_terms(spark):
    got = one(spark, text.terms(F.lit("睡眠a负债 Deep-work x")))[0]
    assert got == ["睡", "眠", "负", "债", "睡眠", "眠负", "负债", "deep-work"]
    assert one(spark, text.terms(F.lit(None).cast("string")))[0] == []


@pytest.mark.parametrize(
    ("name", "trivial"),
    [("今天", True), ("22:00", True), ("8月15日", True), ("第三章", True), ("100元", True), ("", True), ("x", True), ("...", True), ("周一上午9点开会", True), ("睡眠债", False), ("deep work", False), ("间隔重复", False), ("家", True)],
)
def test_trivial_names(spark, name, trivial):
    assert one(spark, text.is_trivial_name(F.lit(name)))[0] is trivial


def test_trivial_names_without_latin(spark):
    assert one(spark, text.is_trivial_name(F.lit("deep work"), latin=False))[0] is True


@pytest.mark.parametrize(
    ("title", "content", "tags", "noise"),
    [("测试一下", "x" * 40, ["a"], True), ("标题", "今天天气不错", None, True), ("标题", "今天天气不错", ["天气"], False), ("IMG_1234", "y" * 40, ["a"], True), ("", None, None, True), ("扫描", "文件名：a.pdf\n文件类型：pdf\n文件大小：3KB", ["a"], True), ("关于睡眠的记录", "午睡时间控制在三十分钟以内效果最好", [], False)],
)
def test_noise(spark, title, content, tags, noise):
    df = spark.createDataFrame([(title, None, content, tags)], "title string, summary string, content string, tags array<string>")
    assert df.select(text.is_noise_capture("title", "summary", "content", "tags")).head()[0] is noise


def test_files(spark):
    assert list(one(spark, *[text.mime_of(F.lit(n)) for n in ("a.PDF", "b.docx", "c.md", "d.txt", "e.png", "")])) == [text.DOCUMENT_TYPES["pdf"], text.DOCUMENT_TYPES["docx"], "text/markdown", "text/plain", "", ""]
    got = one(spark, *[text.is_supported_file(F.lit(m), F.lit(t), F.lit(n)) for m, t, n in (("photo", "image/png", "x"), ("photo", "text/plain", "x"), ("import", "", "a.md"), ("import", "", "a.exe"), ("text", "image/png", "a.md"))])
    assert list(got) == [True, False, True, False, False]
    assert list(one(spark, *[text.size_text(F.lit(n)) for n in (0, 1023, 1536, 5 * 1024**2)])) == ["0 B", "1023 B", "1.5 KB", "5.0 MB"]


def test_days_ago(spark):
    now = F.lit("2025-01-10 12:00:00").cast("timestamp")
    got = one(spark, *[text.days_ago_text(F.lit(t).cast("timestamp"), now) for t in ("2025-01-10 11:00:00", "2025-01-09 12:00:00", "2025-01-01 12:00:00", None)])
    assert list(got) == ["today", "yesterday", "9 days ago", ""]


def test_repair_json():
    assert text.repair_json('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert text.repair_json('so: {"a": "he said "hi" to me", "b": [1, 2') == '{"a": "he said \\"hi\\" to me", "b": [1, 2]}'
    assert text.repair_json('{"a": {"b": "open') == '{"a": {"b": "open"}}'
    assert text.repair_json("none") is None and text.repair_json(None) is None


def test_parsed_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('talk {"a": 2} talk',), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(text.parsed_json("t", "struct<a:int>")["a"]).collect()] == [1, 2, None, None]


def test_json_slices(spark):
    assert one(spark, text.json_array_in(F.lit("x [1, [2]] y")), text.json_object_in(F.lit("no")))[:] == ("[1, [2]]", None)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(scores.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0, None]
    assert one(spark, scores.parse_vector(F.lit("[1, 2.5]")), scores.parse_vector(F.lit("x")))[:] == ([1.0, 2.5], None)


@pytest.mark.parametrize(("recent", "older", "want"), [(2, 0, "new"), (0, 2, "down"), (3, 2, "up"), (2, 3, "down"), (2, 2, "stable"), (4, 3, "stable"), (0, 0, "stable")])
def test_direction(spark, recent, older, want):
    assert one(spark, scores.direction(F.lit(recent), F.lit(older)))[0] == want


def test_changes(spark):
    assert one(spark, scores.percent_change(F.lit(3), F.lit(2)), scores.percent_change(F.lit(1), F.lit(0)))[:] == (50, None)
    got = one(spark, *[scores.evolution(F.lit(n), F.lit(r), F.lit(o)) for n, r, o in ((4, 3, 1), (5, 0, 5), (4, 2, 2), (1, 0, 1))])
    assert list(got) == ["growing", "shrinking", "stable", "stable"]
    assert list(one(spark, *[scores.clamp_score(F.lit(x)) for x in (-3.0, 7.5, 12.0)])) == [0, 8, 10]


def test_dates(spark):
    got = one(spark, dates.day_start(F.lit("2024-02-29")), dates.day_end(F.lit("2024-02-29")), dates.day_start(F.lit("nonsense")))
    assert got[0] == datetime.datetime(2024, 2, 29) and got[1] == datetime.datetime(2024, 2, 29, 23, 59, 59, 999000) and got[2] is None
    make = lambda y, m, d, **k: dates.assembled_date(F.lit(y), F.lit(m), F.lit(d), **k)
    assert list(one(spark, make("2024", "2", "29"), make("2023", "2", "29"), make("2024", "13", "1"), make("2024", "5", "6", most="2024-05-05"), make("24", "1", "1"))) == ["2024-02-29", None, None, None, None]


def test_unique_strings(spark):
    df = spark.createDataFrame([([" a", "a ", "", None, "b"],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(text.unique_strings("x")).collect()] == [["a", "b"], []]
