"""The engine as one object over a folder of tables: ingest, recall, delete, update, fusion, runtime state.

Tables are Parquet versions below the root; a write makes a new version and readers take the newest whole one, so a job that dies leaves the old state.
One writer at a time. Everything heavy is a plan of `operators` and `plans`; this module only joins them.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import fusion, layers, writes
from palimpsest.params import DEFAULT, Params
from palimpsest.plans import recall as R
from palimpsest.sources.files import four_layers
from palimpsest.streaming import state_step

MEMORY = "bundle_id string, layer string, pid string, collection string, memory_type string, summary string, title string, scenario_id string, state string, importance double, entities array<string>, tags array<string>, linked_l1_pids array<string>, vector_text string, recorded_at string, evidence string, status string, ts timestamp, embedding array<float>"
SCHEMAS = {
    "memories": MEMORY,
    "nodes": "name string, label string, updated timestamp",
    "edges": "subj string, pred string, obj string, status string, source string, ko_summary string, created timestamp, updated timestamp",
    "links": "src_layer string, src_id string, rel string, dst_layer string, dst_id string, status string",
    "decisions": "at timestamp, action string, reason string, summary string, n_candidates long",
    "tokens": "token string, action string, query_id long, candidates array<struct<rank:int,pid:string,layer:string,summary:string>>, expires_at timestamp",
    "states": "agent_id string, task string, parts array<string>, from_iso string",
}


class Store:
    """Versioned tables below a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        """Whole versions in order."""
        fs, p = self._fs(f"{self.root}/{name}")
        found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x.getName()[1:]) for x in found if x.getName().startswith("v") and fs.exists(self._fs(f"{x.toString()}/_SUCCESS")[1]))

    def read(self, name: str) -> DataFrame:
        old = self.versions(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{old[-1]}") if old else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame) -> None:
        """A new version with the table's columns (null where df lacks one)."""
        old = self.versions(name)
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
        df.select(*cols).write.mode("overwrite").parquet(f"{self.root}/{name}/v{(old or [0])[-1] + 1}")
        for v in old[: max(0, len(old) + 1 - self.keep)]:
            fs, p = self._fs(f"{self.root}/{name}/v{v}")
            fs.delete(p, True)


class Engine:
    """model: embeds texts; reranker, judge: other injected models, with deterministic stand-ins by default."""

    def __init__(self, spark: SparkSession, root: str, model: R.TextModel, p: Params = DEFAULT, reranker: R.Reranker | None = R.overlap_reranker, judge: layers.Judge | None = None, algorithm: str | None = None):
        self.spark, self.store, self.model, self.p = spark, Store(spark, root), model, p
        self.reranker, self.judge, self.algorithm = reranker, judge, algorithm

    def ingest(self, payloads: list[str], now: datetime | None = None) -> dict[str, int]:
        """Writes four-layer JSON documents; counts by action."""
        now = now or self.p.now
        docs = self.spark.createDataFrame([(f"{now:%Y%m%d%H%M%S}-{k:06d}", x) for k, x in enumerate(payloads)], "bundle_id string, value string")
        return self.write(four_layers(docs), now)

    def write(self, docs: DataFrame, now: datetime) -> dict[str, int]:
        """The write of parsed documents (bundle_id, l0, kos, scenario, persona), as `sources.files.four_layers` gives them."""
        none = F.array().cast("array<string>")
        l0 = docs.select("bundle_id", F.col("l0.scene_summary").alias("scene_summary"), F.col("l0.source").alias("source")).filter("scene_summary is not null")
        kos = docs.select("bundle_id", F.posexplode("kos").alias("pos", "k")).select("bundle_id", "pos", "k.*")
        scenarios = docs.filter("scenario is not null").select("bundle_id", *[F.col(f"scenario.{c}").alias(c) for c in ("title", "summary", "type", "state", "importance", "tags", "entities")])
        personas = docs.select("bundle_id", F.explode("persona").alias("s")).select("bundle_id", "s.summary", "s.type", "s.state", "s.importance", none.alias("tags"))
        held = self.store.read("memories")
        w = layers.write_layers(l0, kos, scenarios, personas, held, now, self.p, judge=self.judge)
        stamp = F.lit(now).cast("timestamp")
        records = w.records.withColumns({"ts": stamp, "status": F.lit("active")})
        vectors = self.model(records.select(F.col("vector_text").alias("text")).distinct()).select(F.col("text").alias("vector_text"), "embedding")
        fresh = records.join(vectors, "vector_text", "left")
        same = writes.newest(fresh, ["collection", "pid"], [F.desc_nulls_last("bundle_id")])
        self._save(w, held, same, stamp, now)
        return {r.action: r.n for r in w.report.collect()}

    def _save(self, w: layers.Written, held: DataFrame, fresh: DataFrame, stamp, now: datetime) -> None:
        """All tables of one write; the memories last, so that a write that dies can run again."""
        nodes, edges = layers.upsert_graph(self.store.read("nodes"), self.store.read("edges"), w.nodes, w.edges.withColumn("source", F.lit("")), now)
        said = w.edges.groupBy("subj", "pred", "obj").agg(F.max("ko_summary").alias("_s"))
        edges = edges.join(said, ["subj", "pred", "obj"], "left").withColumn("ko_summary", F.coalesce("_s", "ko_summary")).drop("_s")
        links = self.store.read("links").unionByName(w.links.withColumn("status", F.lit("active"))).dropDuplicates(list(layers.LINK))
        texts = w.records.filter("layer = 'L0'").select(F.col("bundle_id").alias("key"), "summary")
        log = self.store.read("decisions").unionByName(layers.decision_log(w.decisions, texts, now))
        for name, df in (("nodes", nodes), ("edges", edges), ("links", links), ("decisions", log)):
            self.store.write(name, df)
        self.store.write("memories", writes.upsert(held, fresh, version="ts"))

    def _asked(self, texts: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        return R.embedded(asked, self.model)

    def recall(self, texts: list[str], layer_names: tuple[str, ...] = ("L3", "L2", "L1", "L0")) -> DataFrame:
        """query_id, layer, rank, pid, summary, score: L1 by the whole recall (through upper layers if asked for), L0 by lexical rank."""
        asked, held = self._asked(texts), self.store.read("memories").filter("status = 'active'")
        l1 = held.filter("layer = 'L1'")
        uppers = held.filter(F.col("layer").isin([x for x in layer_names if x in ("L2", "L3")]) & F.col("embedding").isNotNull())
        out = None
        if "L1" in layer_names:
            hits = R.recall(asked, l1, self.store.read("nodes"), self.store.read("edges"), self.p, self.algorithm, self.reranker, uppers=uppers)
            out = hits.select("query_id", F.lit("L1").alias("layer"), "rank", "pid", F.col("rerank_score").alias("score"))
        if "L0" in layer_names:
            low = R.lexical_upper(R.gated(asked, self.p), held.filter("layer = 'L0'"), self.p.rerank_top_k, self.p).select("query_id", F.lit("L0").alias("layer"), "rank", "pid", "score")
            out = low if out is None else out.unionByName(low)
        out = out if out is not None else self.spark.createDataFrame([], "query_id long, layer string, rank int, pid string, score double")
        return out.join(held.select("pid", "layer", "summary"), ["pid", "layer"]).select("query_id", "layer", "rank", "pid", "summary", "score")

    def delete(self, text: str, now: datetime | None = None) -> str | None:
        """First phase: a token for the records that the query finds; None where it finds none."""
        hits = self.recall([text], ("L1",)).select("query_id", "rank", "pid", "layer", "summary")
        issued = writes.issue_tokens(hits, "delete", now or self.p.now, self.p)
        rows = issued.collect()
        if not rows:
            return None
        self.store.write("tokens", self.store.read("tokens").unionByName(self.spark.createDataFrame(rows, issued.schema)))
        return rows[0].token

    def confirm(self, token: str, pids: list[str] | None = None, now: datetime | None = None) -> int:
        """Second phase: deletes the token's records (or those of them that are listed) with all that links to them; how many records went."""
        found = writes.confirm(self.store.read("tokens"), token, now or self.p.now).select("pid")
        found = found.filter(F.col("pid").isin(pids)) if pids is not None else found
        held = self.store.read("memories")
        kept, edges = writes.delete_by_pids(held, self.store.read("edges"), found)
        gone = writes.cascade_delete(held, found)
        left = kept.join(gone.select("pid").distinct(), "pid", "left_semi")
        n = held.count() - left.count()
        self.store.write("edges", edges)
        self.store.write("memories", left)
        return n

    def update(self, text: str, ko: str, now: datetime | None = None) -> str | None:
        """Merges a record (JSON) into the one that the query finds; its pid, or None."""
        now = now or self.p.now
        hits = self.recall([text], ("L1",)).select("query_id", "rank", "pid", "summary")
        target = layers.target_of(hits).first()
        if target is None:
            return None
        k = four_layers(self.spark.createDataFrame([(ko,)], "value string")).select(F.explode("kos").alias("k")).select("k.summary", F.transform("k.entities", lambda e: e["name"]).alias("entities"), "k.tags").limit(1)
        held = self.store.read("memories")
        new = k.select(F.lit(target.pid).alias("pid"), "summary", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.lit("").alias("evidence"))
        merged = writes.merge_update(held.filter(F.col("pid") == target.pid).select("pid", "summary", "entities", "tags", "evidence"), new).select("pid", *[F.col(c).alias(f"_{c}") for c in ("summary", "entities", "tags", "evidence")])
        out = held.join(merged, "pid", "left")
        for c in ("summary", "entities", "tags", "evidence"):
            out = out.withColumn(c, F.coalesce(f"_{c}", c))
        out = out.withColumn("ts", F.when(F.col("_summary").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("ts")))
        changed = out.filter("_summary is not null").select(T.strip(F.concat_ws(" ", "summary", F.array_join("entities", " "))).alias("text"))
        vectors = self.model(changed).select(F.lit(target.pid).alias("pid"), F.col("embedding").alias("_e"))
        out = out.join(F.broadcast(vectors), "pid", "left").withColumn("embedding", F.coalesce("_e", "embedding"))  # one row
        self.store.write("memories", out)
        return target.pid

    def fusion(self, name: str | None = None) -> list[str]:
        """The known algorithms, the current one first; with a name, switches to it."""
        if name:
            self.algorithm = fusion.switch(name)
        now = self.algorithm or fusion.current()
        return [now, *[x for x in fusion.algorithms() if x != now]]

    def runtime_state(self, agent_id: str, status: str, payload: str, now: datetime | None = None) -> dict:
        """Merges an agent's running task; completed work is ingested and clears the state."""
        now = now or self.p.now
        doc = json.loads(payload)
        task = (doc.get("_meta") or {}).get("current_task_id")
        said = [k["summary"].strip() for k in ((doc.get("l1") or {}).get("kos") or []) if (k.get("summary") or "").strip()]
        states = self.store.read("states")
        row = states.filter(F.col("agent_id") == agent_id).first()
        state = (row.task, tuple(row.parts or ()), row.from_iso) if row else None
        done = None
        for summary in said or [None]:
            state, _ = state_step(state, ("ongoing", task, summary, now.isoformat()))
        if status == "completed":
            state, done = state_step(state, (status, task, None, now.isoformat()))
        fresh = self.spark.createDataFrame([(agent_id, state[0], list(state[1]), state[2])], SCHEMAS["states"])
        self.store.write("states", states.filter(F.col("agent_id") != agent_id).unionByName(fresh))
        if done is None:
            return {"action": "state", "task": state[0], "parts": list(state[1]), "from_iso": state[2]}
        return {"action": "ingested", "task": done[0], "parts": list(done[1]), "from_iso": done[2], "report": self.ingest([payload], now)}
