"""Steps that ask a service: fallbacks, budgets, the way of a capture through its steps."""

import json
import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from loamgraph.operators import topics
from loamgraph.plans import ingest, recommend
from loamgraph.providers import EchoAnswerer, FirstThatWorks, HashEmbedder, embedded
from loamgraph.schemas import CAPTURES, LINKS, NODES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


class Broken:
    dim = 8

    def embed(self, texts):
        raise ValueError("down")


class Partial(HashEmbedder):
    def embed(self, texts):
        return [v if i % 2 else [1.0] for i, v in enumerate(super().embed(texts))]


class Slow(HashEmbedder):
    def embed(self, texts):
        time.sleep(0.3)
        return super().embed(texts)


def test_next_provider_is_asked_for_what_is_missing(spark):
    df = spark.createDataFrame([(str(i), f"text {i}") for i in range(6)] + [("n", None)], "id string, t string")
    got = embedded(df, "t", FirstThatWorks(Broken(), Partial(8), HashEmbedder(8)), attempts=1).collect()
    assert len(got) == 7 and all(len(r["embedding"]) == 8 and r["error"] is None for r in got)
    bad = embedded(df, "t", FirstThatWorks(Broken(), Broken()), attempts=1).collect()
    assert all(r["embedding"] is None and "down" in r["error"] for r in bad)


def test_budget_keeps_what_is_done(spark):
    df = spark.createDataFrame([(str(i), "x") for i in range(10)], "id string, t string").coalesce(1)
    got = embedded(df, "t", Slow(4), budget=0.5, at_once=2).collect()
    late = [r for r in got if r["error"] == "out of time"]
    assert len(got) == 10 and 0 < len(late) < 10 and all(r["embedding"] for r in got if r["error"] is None)


def test_rewording_keeps_the_reason_unless_the_answer_fits(spark):
    df = spark.createDataFrame([("a", "short"), ("b", "long"), ("c", "lines"), ("d", "nothing")], "id string, reason string")
    said = {"short": " Said well ", "long": "x" * 81, "lines": "one\ntwo", "nothing": ""}
    got = {r["id"]: r["reason"] for r in recommend.reworded(df, EchoAnswerer(said.get)).collect()}
    assert got == {"a": "Said well", "b": "long", "c": "lines", "d": "nothing"}


def test_way_of_a_capture_and_its_retry(spark):
    rows = [("1", "Ada met Bo in Berlin", "pending", "pending", "pending"), ("2", "fail", "failed", "pending", "pending"), ("3", "done", "completed", "completed", "completed"), ("4", "Ada again", "completed", "failed", "completed")]
    caps = spark.createDataFrame(rows, "id string, content string, processing_status string, graph_status string, embedding_status string")
    caps = spark.createDataFrame([], CAPTURES).unionByName(caps, allowMissingColumns=True).withColumn("scope_id", F.lit("s"))
    nodes = spark.createDataFrame([], NODES)
    links = spark.createDataFrame([], LINKS)

    def analyse(p):
        if "fail" in p:
            raise ValueError("no answer")
        return json.dumps({"title": "T " + p.strip()[:3], "summary": "sum", "keywords": ["k1", "k1", "k2"]})

    def extract(p):
        names = [w for w in ("Ada", "Bo", "Berlin") if w in p]
        return json.dumps({"nodes": [{"id": str(i), "name": n, "kind": "person"} for i, n in enumerate(names)], "links": [{"source": "0", "target": str(i), "type": "related_to"} for i in range(1, len(names))]})

    one = lambda f: EchoAnswererPerRow(f)
    asof = F.lit("2025-01-01 00:00:00").cast("timestamp")
    out, merged, linked = ingest.processed(caps.repartition(4), nodes, links, one(analyse), one(extract), HashEmbedder(8), asof)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 4 and got["1"]["title"] == "T Ada" and got["1"]["tags"] == ["k1", "k2"]
    assert [got[i][c] for i in "1234" for c in ("processing_status", "graph_status", "embedding_status")] == ["completed"] * 3 + ["failed", "pending", "pending"] + ["completed"] * 6
    assert "no answer" in got["2"]["processing_error"] and len(got["1"]["embedding"]) == 8 and got["2"]["embedding"] is None
    assert sorted(r["name"] for r in merged.collect()) == ["Ada", "Berlin", "Bo"] and linked.count() == 2
    again, merged2, _ = ingest.processed(out, merged, linked_as_stored(linked), one(lambda p: analyse(p.replace("fail", ""))), one(extract), HashEmbedder(8), asof)
    assert {r["processing_status"] for r in again.collect()} == {"completed"} and merged2.count() == 3


class EchoAnswererPerRow(EchoAnswerer):
    def answer(self, prompts):
        out = []
        for p in prompts:
            try:
                out.append(self.f(p))
            except ValueError:
                if len(prompts) == 1:
                    raise
                out.append(None)
        return out


def linked_as_stored(linked):
    return linked.select(F.lit(None).cast("string").alias("id"), F.lit("s").alias("user_id"), "source", "target", "relation_type", F.col("evidence").alias("evidence_captured_ids"), "confidence", "created_at", "updated_at")


def test_answers_by_number_name_or_id(spark):
    asked = spark.createDataFrame([("b", 0, "i0", "Sleep"), ("b", 1, "i1", "Plan"), ("b", 2, "i2", "1"), ("b", 3, "i3", "Ada"), ("c", 0, "j0", "Other")], "batch string, pos int, id string, name string")
    answers = spark.createDataFrame([("b", 'Well: {"0": "A", " plan ": " B ", "1": "C", "i3": "A", "ADA": "B", "9": "A", "i2": "nope"} ok'), ("c", "none"), ("d", None)], "batch string, answer string")
    got = {r["id"]: r["topic"] for r in topics.resolved_answers(answers, asked, ["A", "B", "C"]).collect()}
    assert got == {"i0": "A", "i1": "B", "i3": "A"}
