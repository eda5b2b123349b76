"""Names learned in large tables, and learned names too many to broadcast."""

import math

import pytest
from pyspark.sql import functions as F

from loamgraph.llm import personal


def seeds(spark):
    return spark.createDataFrame([("Anna", "given", "en")], "name string, name_part string, lang string")


def test_rare_name_in_a_large_table(spark):
    many = spark.range(70_000).select(F.concat(F.lit("Robert Sur"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    rare = spark.createDataFrame([(f"Zorvane {s}",) for s in ("Miller", "Baker", "Cooper")], "text string")
    names = personal.learn_names(many.unionByName(rare), seeds(spark))
    assert names.is_given("Zorvane")


def test_names_joined_instead_of_broadcast(spark, monkeypatch):
    rows = [(i, f"We met {g} {s} and rang +49 30 1234567.", f"{s}, {g} was there; Robert {s} too") for i, (g, s) in enumerate((g, s) for g in ("Zorvane", "Quillon", "Anne-Brix") for s in ("Miller", "Baker", "Cooper", "Mason"))]
    df = spark.createDataFrame([*rows, (99, None, ""), (0, *rows[0][1:])], "id int, a string, b string")
    texts = df.where("id < 99").select(F.col("a").alias("text"))
    seen = {}
    for least in (200_000, 1):
        monkeypatch.setattr(personal, "BROADCAST_WORDS", least)
        names = personal.learn_names(texts, seeds(spark))
        assert (names.more is None) == (least > 1)
        found, clean = personal.personal_entities(df, "id", ["a", "b"], names), personal.sanitised(df, ["a", "b"], names)
        assert clean.schema == df.schema
        seen[least] = sorted(map(tuple, found.collect())), sorted(map(str, clean.collect()))
    assert seen[1] == seen[200_000] and any(r[2] == "name" and r[1] == "a" for r in seen[1][0])


def test_quick_looks_miss_nothing():
    assert [k for *_, k in personal.shapes("Son numéro 2 85 07 2A 123 456 suffit.")[0]] == ["id_number"]
    for at in ("at", "At", "aT", "AT"):
        assert [k for *_, k in personal.shapes(f"Write to jo.doe[{at}]mail.org soon")[0]] == ["email"]


NOBODY = personal.Names(frozenset({"иван", "robert"}), frozenset({"欧阳", "王"}), frozenset("娜芳"))


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("Встреча: Иван Петров придёт", "name", "Иван Петров"), ("今天见了欧阳娜娜。", "name", "欧阳娜娜"), ("王芳来了", "name", "王芳"), ("12 Rue de Rivoli", "address", "12 Rue de Rivoli"), ("Ufficio: Via Roma 12, Milano", "address", "Via Roma 12, Milano"),
        ("12 rue de Rivoli, 75001 Paris", "address", "12 rue de Rivoli, 75001 Paris"),
    ],
)
def test_scripts_and_streets(text, kind, piece):
    assert [(text[a:b], k) for a, b, k in personal.entities(text, NOBODY)] == [(piece, kind)]


def test_words_beside_streets_and_names_are_left_alone():
    for text in ("Via Zoom 3", "route 66 Diner", "Иван пришёл в 5", "Москва Река"):
        assert personal.entities(text, NOBODY) == []


def test_learned_from_more_listed_names_than_are_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([("Robert Sulipo came",), ("Nikola Sulipo came",), (None,), ("",)], "text string")
    seeds = spark.createDataFrame([("Nikola", "given", "xx"), ("Vesna", "given", "xx"), ("欧阳", "family", "zh"), (None, "given", None), ("", "family", None)], "name string, name_part string, lang string")
    few = personal.learn_names(texts, seeds)
    monkeypatch.setattr(personal, "BROADCAST_WORDS", 1)
    many = personal.learn_names(texts, seeds)
    assert few.more is None and many.more is not None and "欧阳" in few.family and "欧阳" in many.family
    df = texts.withColumn("id", F.monotonically_increasing_id())
    found = lambda n: sorted(tuple(r)[1:] for r in personal.personal_entities(df, "id", ["text"], n).collect())
    assert found(few) == found(many) and len(found(few)) == 2


def test_disclosing_terms_against_a_recount(spark):
    names = personal.Names(frozenset({"robert", "maria"}), frozenset(), frozenset())
    rows = [("The violinist Robert Sulipo played",)] * 4 + [("Robert Sulipo ate soup with the others",)] * 2 + [(f"Maria Kovelo{'abcdefgh'[i]}a ate soup with the others",) for i in range(8)] + [("nobody ate soup",)] * 20 + [(None,), ("",)]
    df = spark.createDataFrame(rows, "note string").withColumn("term", F.lit("x"))
    got = {(r["term"], r["pii_type"]): (r["n"], r["n_term"], r["n_entity"], r["bits"]) for r in personal.disclosing_terms(df, ["note"], names, revealing={"name": 2.0}, share=0.8).collect()}
    bits = round(math.log2(4 * 34 / (4 * 6)), 6)
    assert got == {("violinist", "name"): (4, 4, 6, bits), ("played", "name"): (4, 4, 6, bits)}
    told = personal.disclosing_terms(df, ["note"], names, revealing={"name": 2.0}, share=0.8)
    out = [tuple(r) for r in personal.generalised(df, ["note"], names, told).collect()]
    assert out.count(("The [TERM] [NAME] [TERM]", "x")) == 4 and out.count(("[NAME] ate soup with the others", "x")) == 10 and out.count((None, "x")) == 1 and len(out) == len(rows)
    assert personal.disclosing_terms(df.limit(0), ["note"], names).isEmpty()
