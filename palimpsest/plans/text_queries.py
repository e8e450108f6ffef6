"""Queries over texts: gate, identities, sanitisers, times, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schemas as S
from palimpsest.functions import scoring as X
from palimpsest.functions import text as T
from palimpsest.operators import writes
from palimpsest.operators.gate import gate_reason
from palimpsest.plans import recall as R
from palimpsest.plans import sql as Q
from palimpsest.plans.catalog import query
from palimpsest.sources import adapters as A

B = r"[^\p{L}\p{N}_]"
FILLERS = Q.values(sorted({f.lower() for f in S.FILLERS} | set(S.FILLERS)))
HAN = "[\\x{4e00}-\\x{9fff}]"
REASON = f"""CASE WHEN s = '' THEN 'empty' WHEN length(s) < 5 THEN 'too_short' WHEN length(s) > 300 THEN 'too_long' WHEN lower(s) IN ({FILLERS}) THEN 'filler'
  WHEN lower(rtrim(s, '!.。?？,，~～ ')) IN ({FILLERS}) THEN 'filler_with_punct' WHEN regexp_matches(s, '(^|{B}){S.SWEAR}({B}|$)') THEN 'swear' WHEN regexp_matches(s, '{S.VENT}') THEN 'emotional_vent'
  WHEN NOT regexp_matches(s, '{HAN}') AND len(regexp_extract_all(s, '\\S+')) < 3 THEN 'pure_command'
  WHEN len(list_distinct(string_split(replace(s, ' ', ''), ''))) <= 2 AND length(s) > 6 THEN 'repeated_chars' ELSE '' END"""
GATED = f"WITH {Q.MESSAGES}, gated AS (SELECT conv_id, turn, line, {REASON} AS reason FROM (SELECT conv_id, turn, line, {Q.strip('message')} AS s FROM messages))"


@query(f"{GATED} SELECT conv_id, turn, line, reason, reason <> '' AS skip FROM gated")
def gate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return A.messages(spark, sf).withColumn("reason", gate_reason(F.col("message"))).select("conv_id", "turn", "line", "reason", (F.col("reason") != "").alias("skip"))


@query(f"{GATED} SELECT reason, count(*) AS n FROM gated GROUP BY reason")
def gate_skip_hist(spark: SparkSession, sf: str) -> DataFrame:
    return A.messages(spark, sf).groupBy(gate_reason(F.col("message")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, md5({Q.strip('text')}) AS qhash FROM conversations")
def query_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "conversations").select("conv_id", "turn", T.query_hash(F.col("text")).alias("qhash"))


@query(f"SELECT doc_id, {Q.fkey('text')} AS fkey, len({Q.tokens('text')}) AS n_tokens FROM documents")
def fusion_keys(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", T.fusion_key(F.col("text")).alias("fkey"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))


@query(r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2))), ' ') AS words FROM benchmark")
def graph_token_sets(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "benchmark").select("item_id", F.array_join(T.graph_tokens(F.col("text")), " ").alias("words"))


@query("SELECT doc_id, len(list_filter([lang, source, 'the', 'la'], lambda w: contains(text, w))) AS hits, len(list_filter([lang, source, 'the', 'la'], lambda w: contains(text, w[1]))) AS prefix_hits FROM documents")
def keyword_hit_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(F.col("lang"), F.col("source"), F.lit("the"), F.lit("la"))
    return A.table(spark, sf, "documents").select("doc_id", T.keyword_hits(F.col("text"), words).alias("hits"), T.keyword_hits(F.col("text"), words, prefix=True).alias("prefix_hits"))


@query(
    f"""WITH {Q.MESSAGES}, s AS (SELECT conv_id, turn, line, {Q.strip("message")} AS s FROM messages)
  SELECT conv_id, turn, line, length(s) < 4 OR regexp_matches(s, '(^|{B}){S.SWEAR_RECORD}({B}|$)') OR regexp_matches(s, '{S.VENT}') AS discard,
  length(s) < 6 OR {" OR ".join(f"regexp_matches(s, '{v}')" for v in S.VAGUE)} AS vague FROM s"""
)
def record_filters(spark: SparkSession, sf: str) -> DataFrame:
    return A.messages(spark, sf).select("conv_id", "turn", "line", T.discardable(F.col("message")).alias("discard"), T.vague(F.col("message")).alias("vague"))


FACT = "('0x' || substr(md5('qdrant-v6|' || array_to_string(list_sort([lang, source]), '::') || '||' || lang || '|FROM|' || source), 1, 16))::UBIGINT::VARCHAR"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    rel = F.array(F.struct(F.col("lang").alias("subject"), F.lit("FROM").alias("predicate"), F.col("source").alias("object"), F.lit("active").alias("status")))
    d = A.table(spark, sf, "documents").withColumn("relations", rel).withColumn("entities", F.array("lang", "source"))
    return d.withColumn("pid", T.fact_pid(T.fact_fingerprint(F.col("entities"), F.col("relations"))))


@query(f"SELECT doc_id, {FACT} AS pid FROM documents")
def fact_pids(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("doc_id", "pid")


@query(f"SELECT doc_id, 'rel_' || substr(md5({FACT} || '||' || lang || ' FROM ' || source), 1, 20) AS rel_pid FROM documents")
def relation_pids(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("doc_id", T.relation_pid(F.col("pid"), T.relation_text(F.col("relations"))).alias("rel_pid"))


@query("SELECT conv_id, turn, ('0x' || substr(md5('4layer|L2|' || text), 1, 15))::UBIGINT::VARCHAR AS pid FROM conversations")
def layer_pids(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "conversations").select("conv_id", "turn", T.layer_pid(F.lit("L2"), F.col("text")).alias("pid"))


@query("SELECT doc_id, text || ' ' || lang || ' ' || source || ' ' || lang || ' FROM ' || source AS vtext FROM documents")
def vector_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("doc_id", T.vector_text(F.col("text"), F.col("entities"), F.col("relations")).alias("vtext"))


PREDS = "SELECT p_type AS pred FROM part UNION ALL SELECT event_type FROM events UNION ALL SELECT CASE event_id % 4 WHEN 0 THEN 'knows' WHEN 1 THEN 'works at' WHEN 2 THEN ' Likes ' ELSE '喜欢' END FROM events"


@query(
    f"""SELECT pred, count(*) AS n, CASE WHEN pred IS NULL OR pred = '' OR NOT regexp_matches(pred, '^[\\x00-\\x7F]*$') OR regexp_matches({Q.strip("pred")}, '\\s') OR upper({Q.strip("pred")}) NOT IN ({Q.values(S.PREDICATES)})
  THEN 'MENTIONED_IN' ELSE upper({Q.strip("pred")}) END AS clean FROM ({PREDS}) GROUP BY pred"""
)
def sanitize_predicate(spark: SparkSession, sf: str) -> DataFrame:
    e, p = A.table(spark, sf, "events"), A.table(spark, sf, "part")
    made = F.when(F.col("event_id") % 4 == 0, "knows").when(F.col("event_id") % 4 == 1, "works at").when(F.col("event_id") % 4 == 2, " Likes ").otherwise("喜欢")
    every = p.select(F.col("p_type").alias("pred")).unionByName(e.select(F.col("event_type").alias("pred"))).unionByName(e.select(made.alias("pred")))
    return every.groupBy("pred").agg(F.count("*").alias("n")).withColumn("clean", T.sanitize_predicate(F.col("pred")))


@query(f"WITH {Q.NODES} SELECT label, CASE WHEN label IN ({Q.values(S.LABELS)}) THEN label ELSE 'Concept' END AS clean, count(*) AS n FROM nodes GROUP BY label")
def sanitize_label(spark: SparkSession, sf: str) -> DataFrame:
    return A.nodes(spark, sf).groupBy("label").agg(F.count("*").alias("n")).select("label", T.sanitize_label(F.col("label")).alias("clean"), "n")


def _dirty(x: str) -> str:
    words = sorted({w.lower() for w in S.TOOL_WORDS})
    return f"({x} IS NULL OR {Q.strip(x)} = '' OR length({x}) > 12 OR {' OR '.join(f'contains(lower({x}), {Q.values([w])})' for w in words)})"


HEAD = "split_part(text, ' ', 1)"


@query(
    f"""SELECT doc_id, array_to_string(list_filter([lang, source, w], lambda x: NOT {_dirty("x")}), '|') AS names, CASE WHEN {_dirty("w")} THEN 1 ELSE 2 END::BIGINT AS n_relations
  FROM (SELECT *, {HEAD} AS w FROM documents) WHERE {Q.strip("text")} <> ''"""
)
def clean_ko(spark: SparkSession, sf: str) -> DataFrame:
    w = F.substring_index("text", " ", 1)
    e = lambda c: F.struct(c.alias("name"), F.lit("Concept").alias("label"))
    r = lambda s, o: F.struct(s.alias("subject"), F.lit("FROM").alias("predicate"), o.alias("object"), F.lit("active").alias("status"))
    kos = A.table(spark, sf, "documents").select("doc_id", F.col("text").alias("summary"), F.array(e(F.col("lang")), e(F.col("source")), e(w)).alias("entities"), F.array(r(F.col("lang"), F.col("source")), r(F.col("source"), w)).alias("relations"))
    out = writes.clean_kos(kos)
    return out.select("doc_id", F.array_join(F.transform("entities", lambda x: x["name"]), "|").alias("names"), F.size("relations").alias("n_relations"))


@query(
    """SELECT event_id, strftime(CASE WHEN event_id % 4 = 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS parsed,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(CASE WHEN event_id % 4 = 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS strict FROM events"""
)
def parse_ts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return A.hook_events(spark, sf).select("event_id", show(T.parse_ts(text)).alias("parsed"), show(T.parse_ts(text, offsets=False)).alias("strict"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'file' WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') || 'T23:59:59+08:00' ELSE '2024-01-31T00:00:00+08:00' END AS source_time FROM events")
def normalize_times(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 3
    source = F.when(kind == 1, F.concat(F.lit("dream:light:"), F.date_format("ts", "yyyy-MM-dd"))).otherwise("chat")
    return A.hook_events(spark, sf).select("event_id", T.source_time(source, F.when(kind == 0, "file"), F.lit("2024-01-31T00:00:00+08:00")).alias("source_time"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') || 'T00:00:00+08:00' WHEN 1 THEN '2024-01-28T00:00:00' WHEN 2 THEN '2024-01-31T00:00:00' END AS start,
  CASE event_id % 5 WHEN 0 THEN 'explicit' WHEN 1 THEN 'recent' WHEN 2 THEN 'today' WHEN 3 THEN 'childhood' END AS expression, CASE event_id % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'day' WHEN 2 THEN 'day' WHEN 3 THEN 'vague' END AS precision FROM events"""
)
def infer_time(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 5
    said = F.when(kind == 0, F.concat(F.col("event"), F.lit(" "), F.date_format("ts", "yyyy/M/d"))).when(kind == 1, "前几天爬山").when(kind == 2, "今日下雨").when(kind == 3, "小时候在老家").otherwise(F.col("event"))
    t = T.infer_time(said, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return A.hook_events(spark, sf).select("event_id", t["start"].alias("start"), t["expression"].alias("expression"), t["precision"].alias("precision"))


@query(
    f"""WITH {Q.MEMORIES} SELECT pid, CASE WHEN coalesce(summary, '') = '' THEN '' ELSE concat_ws(' ', CASE WHEN ts IS NOT NULL THEN '[发生: ' || strftime(ts, '%Y-%m-%d') || ']' END,
  CASE WHEN importance = 0 THEN '[状态: 已失效 2024-02-01]' WHEN importance = 1 THEN '[状态: 至今有效]' END, summary) END AS said FROM memories"""
)
def format_memory(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    et = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("start"), none.alias("expression"))
    vt = F.struct(F.when(F.col("importance") == 0, "2024-02-01").alias("end"), F.when(F.col("importance") == 1, "until_revoked").otherwise("open").alias("end_type"))
    return A.memories(spark, sf).withColumns({"et": et, "vt": vt}).select("pid", T.format_memory(F.col("summary"), F.col("et"), F.col("vt")).alias("said"))


@query("SELECT conv_id AS query_id, '[memories]' || chr(10) || string_agg(text, chr(10) ORDER BY turn, text) AS block FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def injection_block(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("summary"))
    return R.injection(c)


@query(f"WITH {Q.MEMORIES} SELECT pid, len(list_intersect(['en', 'src1'], entities)) / 2.0 AS overlap FROM memories")
def entity_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return A.memories(spark, sf).select("pid", X.overlap_ratio(F.array(F.lit(" EN "), F.lit("src1"), F.lit("x"), F.lit("en")), F.col("entities")).alias("overlap"))


@query("SELECT CAST(doc_id AS VARCHAR) AS pid FROM documents WHERE lang IN ('en', 'fr')")
def tag_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return R.tag_prefilter(A.memories(spark, sf), F.array(F.lit("EN"), F.lit("fr"))).select("pid")


@query("SELECT CAST(doc_id AS VARCHAR) AS pid FROM documents WHERE lang = 'de' OR source = 'src3' OR source = 'src7'")
def payload_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = A.memories(spark, sf).withColumns({"scenario_id": F.col("collection"), "title": F.col("memory_type")})
    return R.payload_filter(m, F.array(F.lit("de"), F.lit("src3")), ["src7"]).select("pid")


@query(
    """WITH s AS (SELECT conv_id, conv_id % 11 AS k, CAST(conv_id AS VARCHAR) AS c FROM (SELECT DISTINCT conv_id FROM conversations))
  SELECT conv_id, CASE k WHEN 0 THEN 'wechat_u_' || c WHEN 1 THEN 'qq_unknown' WHEN 2 THEN 'telegram' WHEN 3 THEN 'wechat_w' || c WHEN 4 THEN 'wechat_o' || c || '_x' WHEN 5 THEN 'qq_' || c WHEN 6 THEN 'feishu'
  WHEN 7 THEN 'qq_' || c WHEN 8 THEN 'tool_' || c WHEN 9 THEN 'main' ELSE 'default' END AS agent FROM s"""
)
def agent_ids(spark: SparkSession, sf: str) -> DataFrame:
    c, k = F.col("conv_id").cast("string"), F.col("conv_id") % 11
    channel = F.when(k == 0, "Weixin").when(k == 1, "qqbot").when(k == 2, "telegram")
    sender = F.when(k == 0, F.concat(F.lit("u "), c))
    key = (
        F.when(k == 3, F.concat(F.lit("agent:main:openclaw-weixin:direct:w"), c, F.lit("@im.wechat")))
        .when(k == 4, F.concat(F.lit("weixin:o"), c, F.lit("/x")))
        .when(k == 5, F.concat(F.lit("agent:main:qqbot:direct:c2c:"), c))
        .when(k == 6, "feishubot:group:1")
        .when(k == 7, F.concat(F.lit("agent:main:openclaw-qqbot:"), c))
        .when(k == 8, F.concat(F.lit("agent:main:tool/"), c))
        .when(k == 9, "agent:main")
        .otherwise("default")
    )
    return A.table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", T.agent_id(key, channel, sender).alias("agent"))
