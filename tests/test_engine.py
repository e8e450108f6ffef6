"""The engine object end to end, streams, sources and keywords."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Engine
from palimpsest.functions import text as T
from palimpsest.operators import bm25, layers
from palimpsest.operators.dense import embed, hashing_embedder
from palimpsest.operators.gate import has_noun
from palimpsest.params import DEFAULT
from palimpsest.sources import files
from palimpsest.streaming import daily_batch, incremental_index, index_documents

NOW = datetime(2024, 1, 31)
P = DEFAULT.with_(vec_floor=0.1, bm25_floor=0.1, rerank_floor=0.1, upper_floor=0.1, resolve_floor=0.0)


def payload(scene: str, summary: str, names: list[str], title: str = "") -> str:
    entities = [{"name": n, "label": "Person"} for n in names]
    ko = {"type": "fact", "summary": summary, "entities": entities, "relations": [{"subject": names[0], "predicate": "knows", "object": names[-1]}], "tags": ["t"], "importance": 0.6}
    return json.dumps({"l0": {"scene_summary": scene, "source": "s"}, "l1": {"kos": [ko]}, "l2": {"scenario": {"title": title, "summary": summary, "entities": entities}} if title else None, "l3": {"persona": [{"summary": names[0] + " likes walks"}]}})


@pytest.fixture
def engine(spark, tmp_path):
    model = lambda texts: embed(texts, "text", hashing_embedder())
    return Engine(spark, str(tmp_path / "store"), model, P)


def test_engine(engine):
    one, two = payload("a chat about hills", "Ann climbs steep hills with Ben", ["Ann", "Ben"], "hills"), payload("a chat about boats", "Cid rows wooden boats alone", ["Cid", "Dora"])
    three = payload("a chat about trains", "Fay waits for late trains", ["Fay", "Gus"])
    assert engine.ingest([one, two, three], NOW) == {"create": 3, "update": 0, "override": 0, "skipped": 0, "errors": 0}
    before = sorted(map(str, engine.store.read("memories").collect()))
    assert engine.ingest([one, two, three], NOW)["skipped"] == 3
    assert sorted(map(str, engine.store.read("memories").collect())) == before, "a second write of the same changes nothing"
    layers_ = {r.layer: r.n for r in engine.store.read("memories").groupBy("layer").agg(F.count("*").alias("n")).collect()}
    assert layers_ == {"L0": 3, "L1": 3, "L2": 1, "L3": 3}
    assert {(r.rel, r.dst_layer) for r in engine.store.read("links").collect()} == {("L0_GENERATED", "L1"), ("GENERATED", "entity"), ("BELONGS_TO", "L2"), ("INVOLVES", "entity"), ("DESCRIBES", "L3")}
    assert {(r.subj, r.pred, r.obj) for r in engine.store.read("edges").collect()} == {("Ann", "KNOWS", "Ben"), ("Cid", "KNOWS", "Dora"), ("Fay", "KNOWS", "Gus")}

    found = engine.recall(["who climbs steep hills"]).collect()
    assert [r.summary for r in found if r.layer == "L1"][0].startswith("Ann climbs") and any(r.layer == "L0" for r in found)
    assert engine.recall(["ok"]).count() == 0

    pid = engine.update("who rows wooden boats", json.dumps([{"type": "fact", "summary": "Cid now rows with Eve", "entities": [{"name": "Eve", "label": "Person"}]}]), NOW)
    row = engine.store.read("memories").filter(F.col("pid") == pid).first()
    assert row.summary == "Cid rows wooden boats alone | Cid now rows with Eve" and row.entities == ["Cid", "Dora", "Eve"]

    token = engine.delete("who climbs steep hills", NOW)
    assert engine.confirm(token, now=NOW + timedelta(hours=1)) == 0, "expired"
    gone = engine.store.read("memories").filter("summary like 'Ann climbs%' and layer = 'L1'").first().pid
    assert engine.confirm(token, [gone], NOW) == 4, "the record with its conversation, scenario and persona"
    assert not [r for r in engine.recall(["who climbs steep hills"]).collect() if r.summary.startswith("Ann")]
    assert engine.fusion("rrf")[0] == "rrf" and engine.fusion("arithmetic")[0] == "arithmetic"


def test_runtime_state(engine):
    doc = lambda s: json.dumps({"_meta": {"current_task_id": "t1"}, "l0": {"scene_summary": s}, "l1": {"kos": [{"type": "fact", "summary": s, "entities": [{"name": "Ann"}]}]}})
    assert engine.runtime_state("a", "ongoing", doc("first part"), NOW)["parts"] == ["first part"]
    assert engine.runtime_state("a", "stalled", doc("first part"), NOW)["parts"] == ["first part"]
    out = engine.runtime_state("a", "completed", doc("second part"), NOW + timedelta(hours=2))
    assert out["action"] == "ingested" and out["parts"] == ["first part", "second part"] and out["from_iso"] == NOW.isoformat() and out["report"]["create"] == 1
    assert engine.runtime_state("a", "ongoing", doc("third"), NOW + timedelta(hours=3))["from_iso"] == (NOW + timedelta(hours=2)).isoformat()


def test_daily_batch_sees_a_file_once(engine, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(payload("scene a", "Ann climbs steep hills with Ben", ["Ann", "Ben"]))
    for k, expected in enumerate((1, 2, 2)):
        daily_batch(engine.spark, str(folder), engine.write, str(tmp_path / "cp"), NOW).awaitTermination()
        assert engine.store.read("memories").filter("layer = 'L1'").count() == expected
        if k == 0:
            (folder / "b.json").write_text(payload("scene b", "Cid rows wooden boats alone", ["Cid", "Dora"]))


def test_incremental_index(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("pid string, summary string").json(str(source))
    for rows in ([("1", "red apples"), ("2", "green pears")], [("2", "green plums"), ("3", "red wine")]):
        spark.createDataFrame(rows, "pid string, summary string").coalesce(1).write.mode("append").json(str(source))
        incremental_index(stream, str(tmp_path / "index"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    index = bm25.Index.of(index_documents(spark, str(tmp_path / "index")))
    whole = bm25.build(spark.createDataFrame([("1", "red apples"), ("2", "green plums"), ("3", "red wine")], "pid string, summary string"))
    q = spark.createDataFrame([(1, "red plums")], "query_id long, text string")
    assert sorted(bm25.search(q, index).collect()) == sorted(bm25.search(q, whole).collect()) != []
    index.write(str(tmp_path / "kept"))
    assert sorted(bm25.search(q, bm25.Index.read(spark, str(tmp_path / "kept"))).collect()) == sorted(bm25.search(q, whole).collect())


def test_dream_files(spark, tmp_path):
    for kind, date in (("light", "2024-01-30"), ("rem", "2024-01-30"), ("light", "2024-01-31"), ("deep", "2024-01-30")):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{date}.md").write_text(f"{kind} {date}")
    got = lambda **k: sorted(r.text for r in files.chosen_dreams(spark, str(tmp_path), "2024-01-31", **k).collect())
    assert got() == ["light 2024-01-31"] and got(date="yesterday") == ["light 2024-01-30", "rem 2024-01-30"]
    assert got(date="2024-01-30", kind="deep") == ["deep 2024-01-30"] and got(file=str(tmp_path / "rem" / "2024-01-30.md")) == ["rem 2024-01-30"]


def test_keywords_and_taggers(spark):
    tagger = lambda c: F.transform(F.split(c, "/"), lambda w: F.struct(F.element_at(F.split(w, ":"), 1).alias("word"), F.element_at(F.split(w, ":"), 2).alias("kind")))
    df = spark.createDataFrame([("小明:nr/爬山:v/做:v/饮食习惯:n/密码:n/的:uj/Memory:eng/开心:v",)], "t string")
    r = df.select(T.query_keywords(F.col("t"), tagger).alias("k"), has_noun(F.col("t"), tagger).alias("n")).first()
    assert r.k.intent == ["爬山", "饮食习惯", "密码"] and r.k.entity == ["小明", "memory"] and r.n
    plain = spark.createDataFrame([("what about Memory-OS",), ("?!",)], "t string").select(T.query_keywords(F.col("t")).alias("k"), has_noun(F.col("t"), T.plain_tagger).alias("n")).collect()
    assert plain[0].k.entity == ["what", "about", "memory-os"] and plain[0].n and not plain[1].n
    v = spark.createDataFrame([("a plain long text",)], "t string")
    assert v.select(T.vague(F.col("t"), lambda s: F.lit(False))).first()[0] and not v.select(T.vague(F.col("t"))).first()[0]


def test_judges_and_replies(spark):
    new = spark.createDataFrame([("a", "Same Text"), ("b", "other"), ("c", None), ("d", "  ")], "key string, text string")
    old = spark.createDataFrame([("1", "nothing like it")], "pid string, summary string")
    few = spark.createDataFrame([("a", "9", "same   text"), ("b", "8", "third")], "key string, pid string, summary string")
    got = {r.key: (r.action, r.match_pid) for r in layers.literal_decisions(new, old, few).collect()}
    assert got == {"a": ("SKIP", "9"), "b": ("CREATE", None)}
    rows = spark.createDataFrame([("a", "uncertain", [1.0, 0.0]), ("b", None, [0.0, 1.0])], "key string, state string, embedding array<double>")
    held = spark.createDataFrame([("9", [1.0, 0.1])], "pid string, embedding array<double>")
    replies = spark.createDataFrame([("b", '{"action": "SKIP"}'), ("a", "what?")], "key string, reply string")
    said = {r.key: r.action for r in layers.judged_decisions(rows, held, replies).collect()}
    assert said == {"a": "INVALIDATE", "b": "SKIP"}
    state = spark.createDataFrame([("9", "active", None)], "pid string, state string, recorded_at timestamp")
    assert layers.invalidated(state, layers.judged_decisions(rows, held, replies), NOW).first().state == "uncertain"


def test_relation_times(spark):
    et, vt = "struct<start:string,end:string,expression:string,precision:string>", "struct<start:string,end:string,end_type:string>"
    df = spark.createDataFrame([((None, None), ("a", "b", None, ""), ("c", None, None))], f"rel struct<event_time:{et},valid_time:{vt}>, e {et}, v {vt}")
    r = df.select(layers.relation_times(F.col("rel"), F.col("e"), F.col("v")).alias("t")).first().t
    assert tuple(r) == ("a", "b", "", "unknown", "c", None, "open")


def test_logs(spark, tmp_path):
    df = spark.createDataFrame([(NOW, "e", {"a": "1", "b": "x\ny"})], "at timestamp, event string, f map<string,string>")
    block = df.select(layers.event_block(F.col("at"), F.col("event"), F.col("f")).alias("b")).first().b
    assert block == "### 00:00:00 e\n\n- **a**: 1\n\n- **b**:\n\n```\nx\ny\n```\n\n\n"
    log = spark.createDataFrame([(NOW, "SKIP", "r", "s", 1)], "at timestamp, action string, reason string, summary string, n_candidates long")
    layers.append(log, str(tmp_path / "log"))
    layers.append(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
