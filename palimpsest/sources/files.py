"""File sources: four-layer JSON, model replies, daily text files, Markdown event logs, runtime states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import strip
from palimpsest.schemas import KO, PERSONA, SCENARIO


def four_layers(raw: DataFrame, column: str = "value") -> DataFrame:
    """Each JSON document (string column) as l0, kos, scenario, persona, whatever its shape.

    l1 may be one record, a list, or {kos: [...]}; the whole document may be a list of records or {kos: [...]} itself. Broken JSON gives empty
    layers.
    """
    v = F.col(column)
    get = lambda path: F.get_json_object(v, path)
    kos_of = lambda c: F.when(strip(c).startswith("["), F.from_json(c, f"array<{KO}>")).when(F.get_json_object(c, "$.kos").isNotNull(), F.from_json(F.get_json_object(c, "$.kos"), f"array<{KO}>")).when(F.get_json_object(c, "$.summary").isNotNull(), F.array(F.from_json(c, KO)))
    l1 = F.coalesce(get("$.l1"), F.when(get("$.kos").isNotNull() | strip(v).startswith("["), v))
    scenario = F.coalesce(get("$.l2.scenario"), F.when(get("$.l2.summary").isNotNull(), get("$.l2")))
    return raw.withColumns(
        {
            "l0": F.from_json(get("$.l0"), "struct<scene_summary:string,source:string>"),
            "kos": F.coalesce(kos_of(l1), F.array().cast(f"array<{KO}>")),
            "scenario": F.from_json(scenario, SCENARIO),
            "persona": F.coalesce(F.from_json(get("$.l3.persona"), f"array<{PERSONA}>"), F.array().cast(f"array<{PERSONA}>")),
        }
    )


def read_four_layers(spark: SparkSession, path: str) -> DataFrame:
    return four_layers(spark.read.text(path, wholetext=True))


def salvage_kos(reply: Column) -> Column:
    """Records out of a model's reply: without thoughts and fences, from the first [ to the last ], else its flat objects; summaries to 200."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    listed = F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), f"array<{KO}>")
    flat = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: F.from_json(o, KO)), lambda k: k["summary"].isNotNull())
    found = F.coalesce(F.filter(listed, lambda k: k.isNotNull() & k["summary"].isNotNull()), flat)
    return F.transform(found, lambda k: k.withField("summary", F.substring(k["summary"], 1, 200)))


def dream_files(spark: SparkSession, root: str, date: str | None = None, kind: str | None = None) -> DataFrame:
    """kind, date, text of files <root>/<kind>/<date>.md, both read off the path."""
    f = spark.read.text(f"{root}/*/*.md", wholetext=True).withColumn("file", F.input_file_name())
    f = f.select(F.regexp_extract("file", r"([^/]+)/[^/]+\.md$", 1).alias("kind"), F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})\.md$", 1).alias("date"), F.col("value").alias("text"))
    f = f.filter(F.col("date") == date) if date else f
    return f.filter(F.col("kind") == kind) if kind else f


def chosen_dreams(spark: SparkSession, root: str, today: str, file: str | None = None, date: str | None = None, kind: str | None = None) -> DataFrame:
    """kind, date, text: of one given file; else of a date and kind; else of today's light files; the date 'yesterday' takes light and rem."""
    from datetime import datetime, timedelta

    if file:
        f = spark.read.text(file, wholetext=True)
        return f.select(F.lit(kind).cast("string").alias("kind"), F.lit(date).cast("string").alias("date"), F.col("value").alias("text"))
    if date == "yesterday":
        before = (datetime.strptime(today, "%Y-%m-%d") - timedelta(days=1)).strftime("%Y-%m-%d")
        return dream_files(spark, root, before).filter(F.col("kind").isin("light", "rem"))
    return dream_files(spark, root, date or today, kind or "light")


def event_log(lines: DataFrame, day: str | None = None, column: str = "value") -> DataFrame:
    """ts, event, fields of Markdown blocks (one block a row: header, '- **key**: value' lines, fenced JSON).

    A header time without a date takes `day`. Blocks without a header go.
    """
    v = F.col(column)
    head = r"(?s)^\s*(?:###\s+)?(\S+)[ \t]+(\S+)[ \t]*(?:\n|$)"
    stamp = F.regexp_extract(v, head, 1)
    ts = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(F.concat(F.lit((day or "1970-01-01") + "T"), stamp), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    keys = F.regexp_extract_all(v, F.lit(r"(?m)^- \*\*([^*]+)\*\*: ?(.*)$"), F.lit(1))
    values = F.regexp_extract_all(v, F.lit(r"(?m)^- \*\*([^*]+)\*\*: ?(.*)$"), F.lit(2))
    fence = r"(?s)- \*\*([^*]+)\*\*:\s*\n\s*```(?:json)?\s*\n(.*?)\n\s*```"
    fenced = F.map_from_arrays(F.regexp_extract_all(v, F.lit(fence), F.lit(1)), F.regexp_extract_all(v, F.lit(fence), F.lit(2)))
    plain = F.map_filter(F.map_from_entries(F.array_distinct(F.arrays_zip(keys, values))), lambda k, x: (x != "") & ~F.map_contains_key(fenced, k))
    return lines.select(ts.alias("ts"), F.regexp_extract(v, head, 2).alias("event"), F.map_concat(plain, fenced).alias("fields")).filter("event <> ''")


def read_event_log(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    return event_log(spark.read.option("lineSep", "\n### ").text(path), day)


def runtime_states(spark: SparkSession, path: str) -> DataFrame:
    """Each agent's state document; a corrupt one gives nulls."""
    meta = "struct<agent_id:string,session_key:string,updated_at:string,prev_to_iso:string,current_task_id:string>"
    f = four_layers(spark.read.text(path, wholetext=True))
    return f.withColumn("_meta", F.from_json(F.get_json_object("value", "$._meta"), meta)).withColumn("agent_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
