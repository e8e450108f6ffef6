"""Command line: python -m palimpsest <root> ingest FILE | recall TEXT | delete TEXT | confirm TOKEN | update TEXT FILE | fusion [NAME] | daily FOLDER."""

from __future__ import annotations

import json
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.engine import Engine
from palimpsest.operators.dense import embed, hashing_embedder
from palimpsest.params import Params


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    root, action, *rest = args
    import os

    spark = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    model = lambda texts: embed(texts, "text", hashing_embedder())
    engine = Engine(spark, root, model, Params.from_env(dict(os.environ)).with_(now=datetime.now()))
    if action == "ingest":
        out = engine.ingest([Path(rest[0]).read_text()])
    elif action == "recall":
        out = [r.asDict() for r in engine.recall(rest).orderBy("query_id", F.desc("layer"), "rank").collect()]  # at most rerank_top_k a layer and query
    elif action == "delete":
        out = {"token": engine.delete(rest[0])}
    elif action == "confirm":
        out = {"deleted": engine.confirm(rest[0])}
    elif action == "update":
        out = {"pid": engine.update(rest[0], Path(rest[1]).read_text())}
    elif action == "fusion":
        out = engine.fusion(*rest[:1])
    elif action == "daily":
        from palimpsest.streaming import daily_batch

        query = daily_batch(spark, rest[0], engine.write, f"{root}/daily")
        query.awaitTermination()
        out = {"batches": query.lastProgress["batchId"] + 1 if query.lastProgress else 0}
    else:
        print(__doc__)
        return 2
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
