"""Scalar rules and formulas on hand-computed cases."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring as X
from palimpsest.functions import text as T
from palimpsest.operators.gate import gate, gate_reason
from palimpsest.params import DEFAULT, Params, env_list


def one(spark, column, **values):
    df = spark.range(1)
    for k, (v, t) in values.items():
        df = df.withColumn(k, F.lit(v).cast(t) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast(t))
    return df.select(column.alias("x")).first().x


GATE = [
    ("嗯", "too_short"), ("好的", "too_short"), ("run", "too_short"), (" \n ", "empty"), (None, "empty"), ("今天好累。", "emotional_vent"), ("啊啊啊啊啊", "emotional_vent"),
    ("你他妈有病吧", ""), ("查一下 Qdrant 怎么用", ""), ("小时候在老家玩的那段日子", ""), ("show all tables", ""), ("hello", "filler"), ("hello!!", "filler_with_punct"), ("okay.", "filler_with_punct"),
    ("what the fuck is it", "swear"), ("show tables", "pure_command"), ("哈哈哈哈哈哈哈", "repeated_chars"), ("x" * 301, "too_long"),
]


def test_gate(spark):
    df = spark.createDataFrame(GATE, "text string, want string")
    assert all(r.reason == r.want for r in gate(df).collect()), [tuple(r) for r in gate(df).collect() if r.reason != r.want]
    assert df.select(gate_reason(F.col("text")).isNull().alias("n")).filter("n").count() == 0


def test_pids(spark):
    rel = F.array(F.struct(F.lit("Alice").alias("subject"), F.lit("KNOWS").alias("predicate"), F.lit("Bob").alias("object")))
    for names in (["Bob", "Alice"], ["Alice", "Bob"]):
        pid = T.fact_pid(T.fact_fingerprint(F.array(*map(F.lit, names)), rel))
        assert one(spark, pid) == "9411318344370176320"
        assert one(spark, T.fact_fingerprint(F.array(*map(F.lit, names)), rel)) == "Alice::Bob||Alice|KNOWS|Bob"
    assert one(spark, T.layer_pid(F.lit("L2"), F.lit("Trip"))) == "724316930121025259"
    assert one(spark, T.relation_pid(F.lit("9411318344370176320"), F.lit("Alice KNOWS Bob"))).startswith("rel_")
    assert one(spark, T.query_hash(F.lit(" hi \n"))) == hashlib.md5(b"hi").hexdigest()


@pytest.mark.parametrize(("raw", "clean"), [("knows", "KNOWS"), ("Loves", "LOVES"), ("likes ", "LIKES"), ("喜欢", "MENTIONED_IN"), ("works at", "MENTIONED_IN"), ("FLIES", "MENTIONED_IN"), ("", "MENTIONED_IN"), (None, "MENTIONED_IN")])
def test_predicates(spark, raw, clean):
    assert one(spark, T.sanitize_predicate(F.lit(raw).cast("string"))) == clean


def test_formulas(spark):
    now = DEFAULT.now
    d = lambda v: F.lit(v).cast("double")
    ts = lambda days: F.lit(None if days is None else now - timedelta(days=days)).cast("timestamp")
    assert [one(spark, X.depth_score(d(1.0), F.lit(k))) for k in (1, 2, 3)] == [1.0, 0.5, 0.3333]
    assert one(spark, X.association_score(d(1), F.lit(1), d(0.5), ts(None))) == 0.9
    assert one(spark, X.association_score(d(0.5), F.lit(2), d(0.8), ts(270))) == 0.56
    assert one(spark, X.association_score(d(0), F.lit(1), d(0.5), ts(1000))) == 0.425
    assert not one(spark, X.activated(d(0), F.lit(2)))
    assert one(spark, X.kg_score(d(0.8), d(0.75))) == 0.7695
    assert one(spark, X.time_decay(X.importance_weight(d(0.56), d(0.5)), ts(270))) == 0.49
    assert one(spark, X.time_decay(d(0.123456), ts(None))) == 0.123456
    assert one(spark, X.cosine(F.array(d(1), d(0)), F.array(d(1), d(1)))) == 0.7071
    assert one(spark, X.rank_score(F.lit(9))) == 0.1 and one(spark, X.final_mix(d(0.5), d(1))) == 0.7


DECISIONS = [("uncertain", None, "DISCARD"), ("uncertain", 0.1, "INVALIDATE"), ("active", None, "CREATE"), ("historical", 0.1, "UPDATE"), ("active", 0.82, "SKIP"), ("active", 0.80, "UPDATE"), ("active", 0.79, "CREATE"), ("historical", None, "CREATE")]


def test_decisions(spark):
    df = spark.createDataFrame(DECISIONS, "state string, best double, want string")
    assert all(r[0] == r[1] for r in df.select(X.dedup_action(F.col("state"), F.col("best")), "want").collect())
    got = [r[0] for r in df.select(X.dedup_fallback(F.col("state"), F.col("best").isNotNull())).collect()]
    assert got == ["DISCARD", "INVALIDATE"] + ["CREATE"] * 6


def test_text_rules(spark):
    s = lambda v: F.lit(v).cast("string")
    assert one(spark, T.fusion_key(s("\n a" + "b" * 70))) == "a" + "b" * 57
    assert one(spark, T.tokens(s("The the a_1 of naïve x 12"))) == ["The", "a_1", "naïve", "12"]
    assert one(spark, T.tokens(s("喜欢爬山 ok"), cjk=True)) == ["ok", "喜欢", "欢爬", "爬山"]
    assert [one(spark, T.dirty_entity(s(v))) for v in ("Bob", "", "x" * 13, "myNeo4J", None)] == [False, True, True, True, True]
    assert [one(spark, T.discardable(s(v))) for v in ("abc", "well damn it", "没什么!", "a fine day")] == [True, True, True, False]
    assert [one(spark, T.vague(s(v))) for v in ("abc", "童年充满了快乐", "我们昨天去爬山了")] == [True, True, False]
    assert one(spark, T.infer_time(s("met 2024-3-5"), F.lit(datetime(2024, 1, 31)).cast("timestamp"))).start == "2024-03-05T00:00:00+08:00"
    assert one(spark, T.scenario_ids(s("a"), s("a"))) == ["a"] and one(spark, T.scenario_ids(s(None), s("t"))) == ["t"]
    assert [one(spark, T.decision_action(s(v))) for v in ('{"action":"skip"}', '```json\n{"action":"CREATE"}\n```', 'x {"action": "UPDATE"} y', "none", None)] == ["SKIP", "CREATE", "UPDATE", None, None]
    assert [one(spark, T.model_backend(s(v), ["openrouter"])) for v in ("openrouter/m", "other/m", "m")] == ["openrouter", "api", "api"]
    assert one(spark, T.parse_ts(s("2024-01-01T08:00:00+08:00"))) == datetime(2024, 1, 1) and one(spark, T.parse_ts(s("2024-01-01T08:00:00+08:00"), offsets=False)) is None


def test_params():
    p = Params.from_env({"PALIMPSEST_RRF_K": "10", "PALIMPSEST_NOW": "2024-02-01"})
    assert p.rrf_k == 10 and p.now == datetime(2024, 2, 1) and '"rrf_k": 10' in p.to_json()
    assert env_list("a, b", []) == ["a", "b"] and env_list("a,b\nc", []) == ["a,b", "c"] and env_list(" ", ["d"]) == ["d"]
