"""URL filters: rules first, then link-graph propagation over host edges.

Rules name a host (with all subdomains) and a path prefix; the longest fitting rule gives a page's verdict. Other pages take their host's:
trust flows from hosts along links by personalised PageRank, seeded with the share of each host's pages that rules allow; distrust flows
against links (who links to a blocked host is suspect), seeded with the share that rules block. A host is blocked where distrust exceeds
trust by `margin`.

A null URL or one without :// has an empty host and path; such pages fit no rule, send no links and take the verdict of the empty host (allow:
it has no seeds). Null HTML has no links; HTML of any length is read whole. Links of a host to itself count for nothing. Repeated rows count as pages of their own. Empty tables
give empty results. Extra columns pass through `judge`; input columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, col_or_null, spare_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: Fixed values.
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null where none fits; equally long rules go by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, from the pages' absolute and scheme-relative references."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(ws: Workspace, seeds: DataFrame, edges: DataFrame, damping: float, rounds: int, epsilon: float) -> DataFrame:
    """host, score: personalised PageRank by power iteration, scaled so that a host without links keeps its seed. Each round is written.

    Rounds go on until no score moves by epsilon; that it still does after `rounds` of them is an error.
    """
    share = edges.groupBy("src").agg(F.sum("n").alias("out"))
    edges = ws.stage(edges.join(share, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("p")), "edges")
    now = seeds
    for _ in range(rounds):
        flow = edges.join(now, edges.src == now.host).groupBy("dst").agg(F.sum(F.col("p") * F.col("score")).alias("flow"))
        both = seeds.select("host", F.col("score").alias("seed"), F.lit(0.0).alias("flow")).unionByName(flow.select(F.col("dst").alias("host"), F.lit(0.0).alias("seed"), "flow"))
        later = both.groupBy("host").agg((F.sum("seed") + damping * F.sum("flow")).alias("score"))
        later = ws.stage(later, "scores")
        moved = later.alias("a").join(now.alias("b"), "host", "left").agg(F.max(F.abs(F.col("a.score") - F.coalesce("b.score", F.lit(0.0))))).first()[0]
        if now is not seeds:
            ws.drop(now)
        now = later
        if (moved or 0) < epsilon:
            ws.drop(edges)
            return now
    raise RuntimeError(f"scores still move by {moved} after {rounds} rounds")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, rounds: int = 1_000, epsilon: float = 1e-6, margin: float = 0.5) -> DataFrame:
    """pages with host, path, rule, trust, distrust and verdict."""
    ws, fit = Workspace(pages.sparkSession), spare_name(pages, "_rule")
    host, path = split_url(col_or_null(pages, "url", "string"))
    own = pages.withColumns({"host": host, "path": path}).withColumn(fit, longest_rule(F.col("host"), F.col("path"), rules))
    small = own.select("host", F.col(f"{fit}.verdict").alias("v"))
    seeds = ws.stage(
        small.filter("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("v") == "allow", 1.0).otherwise(0.0)).alias("trusted"), F.avg(F.when(F.col("v") == "block", 1.0).otherwise(0.0)).alias("blocked")),
        "seeds",
    )
    edges = ws.stage(host_edges(pages.select(host.alias("host"), col_or_null(pages, "html", "string").alias("html"))), "links")
    trust = spread(ws, seeds.select("host", F.col("trusted").alias("score")), edges, damping, rounds, epsilon)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(ws, seeds.select("host", F.col("blocked").alias("score")), back, damping, rounds, epsilon)
    scores = trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full")
    own = own.drop("trust", "distrust").join(ws.stage(scores, "hosts"), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce(F.col(f"{fit}.verdict"), F.when(distrust - trust > margin, "block").otherwise("allow"))
    out = own.withColumns({"trust": trust, "distrust": distrust, "rule": F.col(f"{fit}.rule"), "verdict": verdict})
    added = ["host", "path", "rule", "trust", "distrust", "verdict"]
    return out.select(*[f"`{c}`" for c in pages.columns if c not in added], *added)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
