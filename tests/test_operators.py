"""Operators on small tables: fusion, writes, graph, clusters, sources, streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest import streaming
from palimpsest.operators import bm25, clusters, dense, fusion, graph, writes
from palimpsest.params import DEFAULT
from palimpsest.plans import recall
from palimpsest.sources import files

NOW = DEFAULT.now
CH = "query_id int, pid string, summary string, importance double, ts timestamp, entities array<string>, score double, rank int"


def channels(spark):
    ago = lambda d: None if d is None else NOW - timedelta(days=d)
    vec = [(1, "A", "sum A", 1.0, ago(0), ["x"], 0.9, 1), (1, "B", "sum B", 0.5, ago(270), [], 0.8, 2), (1, "C", "sum C", 0.0, None, [], 0.7, 3)]
    lex = [(1, "A", "sum A", 1.0, ago(0), ["x"], 1.0, 1), (1, "D", "sum D", 0.5, ago(1000), [], 0.8, 2), (1, "C", "sum C", 0.0, None, [], 0.5, 3)]
    return spark.createDataFrame(vec, CH), spark.createDataFrame(lex, CH)


def test_arithmetic_fusion(spark):
    out = fusion.arithmetic(*channels(spark))
    got = {r.pid: (r.channels, r.fused, r.sort_key) for r in out.collect()}
    assert got == {"A": ("vec,bm25", 1.7076, 2.1345), "B": ("vec", 0.56, 0.49), "C": ("vec", 0.49, 0.3675), "D": ("bm25", 0.56, 0.42)}
    assert [r.pid for r in fusion.top(out, 15).orderBy("rank").collect()] == ["A", "B", "D", "C"]
    vec, lex = channels(spark)
    shuffled = fusion.arithmetic(vec.orderBy(F.desc("pid")), lex.repartition(3))
    assert sorted(map(tuple, shuffled.select("pid", "sort_key").collect())) == sorted((k, v[2]) for k, v in got.items())


def test_rrf(spark):
    got = {r.pid: (r.fused, r.sort_key) for r in fusion.rrf(*channels(spark)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"A": 3.278689, "B": 1.612903, "C": 1.587302, "D": 1.612903}
    assert got["A"][1] == 3.2787 and got["B"][1] == 1.4113 and got["C"][1] == 1.587302 and got["D"][1] == 1.2097
    names = spark.createDataFrame([(1, ["X"])], "query_id int, names array<string>")
    hit = {r.pid: r.sort_key for r in fusion.rrf(*channels(spark), spark.createDataFrame([(1, ["x"])], "query_id int, names array<string>")).collect()}
    assert hit["A"] == 3.7705 and names.count() == 1


def test_registry():
    assert fusion.algorithms() == ["arithmetic", "rrf"] and fusion.switch("rrf") == "rrf" == fusion.current()
    with pytest.raises(ValueError):
        fusion.switch("none")
    assert fusion.reset() == "arithmetic" == fusion.reset({"PALIMPSEST_FUSION": "arithmetic"})


def test_recall_gates_and_degrades(spark):
    v = lambda *x: [float(i) for i in x]
    mem = spark.createDataFrame([("1", "L1", "walks in the park", 0.5, None, ["a"], v(1, 0)), ("2", "L1", "talks about rivers", 0.5, None, ["b"], v(0, 1)), ("3", "L2", "no vector here", 0.5, None, [], None)], "pid string, layer string, summary string, importance double, ts timestamp, entities array<string>, embedding array<float>")
    q = spark.createDataFrame([(1, "who walks in the park", v(1, 0)), (2, "ok", v(0, 1))], "query_id int, text string, embedding array<float>")
    got = recall.recall(q, mem, p=DEFAULT.with_(rerank_floor=0.1)).collect()
    assert {r.query_id for r in got} == {1} and got[0].pid == "1"
    assert recall.recall(q, mem, p=DEFAULT.with_(rerank_floor=0.1), layers=("L2",)).filter("channels = 'vec'").count() == 0


def test_chinese_queries_meet_chinese_records(spark):
    texts = {"1": "我们在北京的家里吃饭", "2": "使用Qdrant向量数据库检索记忆", "3": "walks in the park", "4": "周末去爬山看日出", "5": "talks about rivers"}
    mem = spark.createDataFrame([(k, "L1", v, 0.5, None, [], None) for k, v in texts.items()], "pid string, layer string, summary string, importance double, ts timestamp, entities array<string>, embedding array<float>")
    q = spark.createDataFrame([(1, "上次在北京吃饭是什么时候", [1.0]), (2, "Qdrant是什么", [1.0]), (3, "检索数据库的记忆", [1.0]), (4, "who walks there", [1.0])], "query_id int, text string, embedding array<float>")
    assert {(r.query_id, r.pid) for r in bm25.search(q, bm25.build(mem)).collect()} == {(1, "1"), (2, "2"), (3, "2"), (4, "3")}
    assert {(r.query_id, r.pid) for r in recall.recall(q, mem, p=DEFAULT.with_(rerank_floor=0.0)).collect()} >= {(1, "1"), (3, "2"), (4, "3")}
    nodes = spark.createDataFrame([("北京大学", "Place"), ("Qdrant数据库", "Tool"), ("上海", "Place"), ("Berlin", "Place")], "name string, label string")
    assert {(r.query_id, r.name) for r in graph.entity_search(q, nodes).collect()} == {(1, "北京大学"), (2, "Qdrant数据库"), (3, "Qdrant数据库")}
    whole = lambda runs: F.filter(F.array(F.lit("北京"), F.lit("吃饭")), lambda w: F.exists(runs, lambda r: F.contains(r, w)))
    assert {r.term for r in bm25.build(mem, segment=whole).terms.collect()} >= {"北京", "吃饭", "Qdrant"} and not bm25.build(mem, segment=whole).terms.filter("term = '数据'").count()
    assert {(r.query_id, r.pid) for r in bm25.search(q, bm25.build(mem, segment=whole), segment=whole).collect()} == {(1, "1"), (2, "2"), (4, "3")}


def test_names_meet_inside_words(spark):
    known = ["北京市", "postgresql", "Smithson", "red", "x", "The Red House", "", "...net", "(beta) tool"]
    asked = ["北京", "Postgres", "smith", "shared", "house", "max", "nothing", "中", "(BETA) tool", "Berlin.. ...NET core"]
    low = lambda a, b: 1.0 if a.lower() == b.lower() else 0.7 if b and (a.lower() in b.lower() or b.lower() in a.lower()) else 0.0
    want = {}
    for a in asked:
        best = min(((-low(a, b), b) for b in known if low(a, b) >= 0.7), default=None)
        if len(a) >= 2 and best and best[1] != a:
            want[a] = (best[1], -best[0])
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: (r.alias, r.score) for r in graph.resolve_alias(frame(asked), frame(known)).collect()} == want and len(want) == 8
    edges = spark.createDataFrame([(n, "KNOWS", "zzz", None, f"about {n}") for n in known if n], "subj string, pred string, obj string, status string, ko_summary string")
    texts = ["我住在北京市", "use Postgresql16 (beta) tools", "the ...net core", "nothing"]
    got = {r.text for r in recall.prf_expanded(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), edges).collect()}
    assert got == {"我住在北京市 about 北京市", "use Postgresql16 (beta) tools about (beta) tool about postgresql", "the ...net core about ...net", "nothing"}


def test_dense_exactness_and_blocks(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8))
    df = spark.createDataFrame([(str(i), str(i % 3), list(map(float, v))) for i, v in enumerate(x)], "pid string, grp_ string, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(i, list(map(float, x[i]))) for i in range(7)], "query_id int, embedding array<float>")
    monkeypatch.setattr(dense, "BLOCK", 3)
    got = {(a.query_id, a.pid): a.sim for a in dense.dense_top_k(q, df, 5, -1.0).collect()}
    f = x.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1)[:, None]
    sim = u @ u[:7].T
    want = {(k, str(i)) for k in range(7) for i in np.argsort(-sim[:, k])[:5]}
    assert set(got) == want and all(abs(s - sim[int(p), k]) < 1e-4 for (k, p), s in got.items())
    pairs = {(a.a, a.b) for a in dense.similar_pairs(df, 0.5, block=16).collect()}
    assert pairs == {tuple(sorted((str(i), str(j)))) for i in range(60) for j in range(i) if (u[i] @ u[j]) >= 0.5}
    empty = spark.createDataFrame([], "query_id int, embedding array<float>")
    assert dense.dense_top_k(empty, df, 5, 0.0).collect() == []


def test_merge_and_idempotence(spark):
    s = "pid string, summary string, entities array<string>, tags array<string>, evidence string"
    old, new = spark.createDataFrame([("1", "a", ["x", "y"], ["t"], "e1")], s), spark.createDataFrame([("1", "b", ["y", "z"], [], None), ("2", "n", None, None, "")], s)
    got = {r.pid: r for r in writes.merge_update(old, new).collect()}
    assert got["1"].summary == "a | b" and got["1"].entities == ["x", "y", "z"] and got["1"].merged_from == "a" and got["2"].action == "create"
    same = writes.merge_update(old, old).first()
    assert (same.summary, same.entities, same.tags) == ("a", ["x", "y"], ["t"])


def test_edges(spark):
    s = "eid string, subj string, pred string, obj string, status string, updated timestamp, superseded_by string, ko_summary string"
    e = spark.createDataFrame([("1", "a", "KNOWS", "b", None, datetime(2024, 1, 1), None, "full"), ("2", "a", "KNOWS", "b", "active", datetime(2024, 1, 2), None, ""), ("3", "a", "KNOWS", "b", "superseded", datetime(2024, 1, 3), None, None)], s)
    assert [r.eid for r in writes.keep_latest_edges(e).collect()] == ["3"]
    got = {r.eid: (r.status, r.superseded_by) for r in writes.supersede_duplicates(e).collect()}
    assert got == {"1": (None, None), "2": ("superseded", "full"), "3": ("superseded", None)}
    loops = e.union(spark.createDataFrame([("4", "b", "KNOWS", "b", None, None, None, None), ("5", "b", "LIKES", "c", None, None, None, None)], s))
    paths = {(r.name, r.hop): r.path for r in graph.expand_paths(spark.createDataFrame([(1, "a")], "query_id int, name string"), loops).collect()}
    assert paths == {("a", 0): ["a"], ("b", 1): ["a", "b"], ("c", 2): ["a", "b", "c"]}


def test_cascade_leaves_no_dangling_link(spark):
    m = spark.createDataFrame([("1", "L1", []), ("2", "L1", None), ("s", "L2", ["1", "2"]), ("p", "L3", ["2"]), ("c", "L0", None)], "pid string, layer string, linked_l1_pids array<string>")
    out = writes.cascade_delete(m, spark.createDataFrame([("1",)], "pid string"))
    assert {r.pid for r in out.collect()} == {"2", "p", "c"}


def test_tokens_expire(spark):
    c = spark.createDataFrame([(1, 1, "7", "L1", "s")], "query_id int, rank int, pid string, layer string, summary string")
    t = writes.issue_tokens(c, "delete", NOW)
    token = t.first().token
    assert [r.pid for r in writes.confirm(t, token, NOW + timedelta(seconds=299)).collect()] == ["7"]
    assert writes.confirm(t, token, NOW + timedelta(seconds=300)).collect() == []


def test_greedy_groups_follow_the_sequential_rule(spark):
    pairs = [("1", "2"), ("2", "3"), ("3", "4"), ("5", "6")]
    order = spark.createDataFrame([(str(i), i) for i in range(1, 8)], "pid string, pos int")
    got = {r.pid: r.seed for r in clusters.greedy_groups(spark.createDataFrame(pairs, "a string, b string"), order).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "3", "5": "5", "6": "5", "7": "7"}
    comp = {r.pid: r.label for r in clusters.connected(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert comp == {"1": "1", "2": "1", "3": "1", "4": "1", "5": "5", "6": "5"}


def test_sources(spark, tmp_path):
    shapes = ['{"l0":{"scene_summary":"s"},"l1":{"summary":"a"},"l3":{"persona":[{"summary":"p"}]}}', '[{"summary":"a"},{"summary":"b"}]', '{"kos":[{"summary":"a"}]}', '{"l1":{"kos":[]},"l2":{"scenario":{"title":"t"}}}', "broken", '{"l1":null}']
    got = files.four_layers(spark.createDataFrame([(x,) for x in shapes], "value string")).collect()
    assert [[k.summary for k in r.kos] for r in got] == [["a"], ["a", "b"], ["a"], [], [], []]
    assert got[0].l0.scene_summary == "s" and got[0].persona[0].summary == "p" and got[3].scenario.title == "t"
    (tmp_path / "light").mkdir()
    (tmp_path / "light/2024-01-02.md").write_text("dream")
    assert [tuple(r) for r in files.dream_files(spark, str(tmp_path), date="2024-01-02").collect()] == [("light", "2024-01-02", "dream")]
    (tmp_path / "log.md").write_text("# log\n### 10:00:00 recall_skipped\n- **reason**: too_short\n\n### 2024-01-02T11:00:00 injection_committed\n- **anchors**:\n```json\n[1]\n```\n")
    log = files.read_event_log(spark, str(tmp_path / "log.md"), "2024-01-02").filter("ts is not null").orderBy("ts").collect()
    assert [(r.event, r.fields) for r in log] == [("recall_skipped", {"reason": "too_short"}), ("injection_committed", {"anchors": "[1]"})]


def test_streams_equal_batch(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("s", t(0), 1, "hello there"), ("s", t(5), 2, " hello there"), ("s", t(300), 3, "again"), ("u", t(6), 4, "hello there")]
    df = spark.createDataFrame(rows, "session_key string, ts timestamp, seq int, text string")
    batch = sorted(r.seq for r in streaming.session_dedup(df).collect())
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.session_dedup_stream(src).writeStream.format("memory").queryName("dedup").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert batch == [1, 3, 4] and len(spark.sql("select * from dedup").collect()) == 3
    assert [r.is_repeat for r in streaming.rapid_repeats(df.withColumn("text", F.trim("text"))).orderBy("seq").collect()] == [False, True, False, False]
    ev = df.select("ts", F.lit("e").alias("event"), F.lit(1.0).alias("value"), "session_key")
    assert sorted(r.n for r in streaming.sessions(ev).collect()) == [1, 1, 2]
    assert streaming.since(ev, 1e6).count() == 4 and streaming.windowed_stats(ev).count() == 1


def test_runtime_state_stream(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("a", t(0), "ongoing", "T", "one"), ("a", t(1), "stalled", None, "one"), ("a", t(2), "completed", None, "two"), ("b", t(3), "ongoing", "U", "x")]
    df = spark.createDataFrame(rows, "agent_id string, ts timestamp, status string, task string, summary string")
    df.write.parquet(str(tmp_path / "in"))
    q = streaming.runtime_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from states").collect()
    assert [(r.agent_id, r.task, r.parts, r.from_iso) for r in got] == [("a", "T", ["one", "two"], "2024-01-01T00:00:00")]


def test_registered_queries_have_sql():
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) >= 90 and set(s) <= set(q)
    missing = [n for n in q if n not in s and not n.startswith("op") and n != "pipeline"]
    assert missing == []


def test_lsh_pairs_recall(spark):
    """The form for large tables: verified pairs only, and nine of ten of the exact ones at least."""
    import random

    r = random.Random(1)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(120)]
    rows = [(str(k), [x + r.gauss(0, 0.15) for x in base[k % 120]]) for k in range(360)]
    v = spark.createDataFrame(rows, "pid string, embedding array<double>")
    exact = {(x.a, x.b) for x in dense.similar_pairs(v, 0.9).collect()}
    near = {(x.a, x.b): x.sim for x in dense.lsh_pairs(v, 0.9).collect()}
    assert len(exact) > 200 and len(exact & set(near)) >= 0.9 * len(exact) and min(near.values()) >= 0.899
