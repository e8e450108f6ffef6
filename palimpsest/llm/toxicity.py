"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon mined from labelled training texts (words and word beginnings that training documents marked toxic use
far more often), those words' distance to second-person words, capitals, punctuation and obfuscation rates. Labels reach nothing but the
lexicon, the trees and the calibration; label, language, source and doc_id are never inputs of a score.

Training rows are bounded: at most `max_train` labelled rows, those with the smallest hash of doc_id, none of them held out (crc32 of the
doc_id as text, modulo 5, equal to 0). Everything else runs over all rows.

Null and empty texts score like any text without words; texts of any length are read whole. A doc_id that is null is never a training row and counts as held out by the crc32
of an empty string. Repeated rows score alike; labels that repeat or disagree count once for each joined row. Without labels of both kinds
the score is the mean label (0 where there is none). Extra columns pass through; `score` replaces
input columns named like its outputs, `drop_toxic` leaves all columns as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, col_or_null, raw, schema_with, slices, with_columns

BEGINNING = 5
#: Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
FEATURES = ("word_hits", "word_rate", "word_max", "begin_hits", "begin_rate", "begin_max", "near_second", "second_rate", "capitals", "shouted", "punctuation", "bangs", "symbols", "leet", "spaced", "repeats", "distinct", "n_words", "word_length")
LEET = bytes.maketrans(b"013457@$", b"oieastas")
SPACED = re.compile(rb"(?:\b[a-zA-Z][ .*_-]){3,}")


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, lower case."""
    return re.findall(r"[^\W_]+", text.lower())


class Lexicon:
    """Words and word beginnings with their weights (smoothed log odds of a toxic document)."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings

    def features(self, data: bytes) -> list[float]:
        text = data.decode("utf-8", "replace")
        ws = tokens(text)
        n, size = max(1, len(ws)), max(1, len(data))
        words, beginnings = self.words, self.beginnings
        counts: dict[str, int] = {}
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
        hit = {w: words[w] for w in counts if w in words}
        begin = {w: beginnings[w[:BEGINNING]] for w in counts if w[:BEGINNING] in beginnings}
        second = [i for i, w in enumerate(ws) if w in SECOND_PERSON] if not SECOND_PERSON.isdisjoint(counts) else []
        near = 0.0
        if second and hit:
            at = np.array(second)
            spots = np.array([i for i, w in enumerate(ws) if w in hit])
            k = np.searchsorted(at, spots)
            gap = np.minimum(np.abs(spots - at[np.minimum(k, len(at) - 1)]), np.abs(spots - at[np.maximum(k - 1, 0)]))
            near = float((1 / (1 + gap)).sum()) / len(spots)
        leet = 0
        if b"$" in data or b"@" in data or any(c in data for c in b"013457"):
            leet = sum(w.translate(LEET).decode("utf-8", "replace") in words for w in set(re.findall(rb"[a-z]*[013457@$][a-z013457@$]*", data.lower())))
        raw_words = data.split()
        upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = len(data) - len(data.translate(None, b".,;:!?"))
        return [
            float(sum(counts[w] for w in hit)),
            sum(counts[w] * v for w, v in hit.items()) / n,
            max(hit.values(), default=0.0),
            float(len(begin)),
            sum(counts[w] * v for w, v in begin.items()) / n,
            max(begin.values(), default=0.0),
            near,
            len(second) / n,
            upper / size,
            sum(w.isupper() for w in raw_words) / max(1, len(raw_words)),
            marks / n,
            data.count(b"!") / n,
            (len(data) - len(data.translate(None, b"#$%&*+/<=>@\\^_|~"))) / size,
            float(leet),
            float(len(SPACED.findall(data))),
            _tripled(data) / n,
            len(counts) / n,
            float(len(ws)),
            sum(map(len, ws)) / n,
        ]


def _tripled(data: bytes) -> int:
    """Places where a byte stands three times."""
    a = np.frombuffer(data, np.uint8)
    return int(((a[1:-1] == a[:-2]) & (a[1:-1] == a[2:])).sum()) if len(a) > 2 else 0


class BoostedTrees:
    """Histogram gradient boosting for the logistic loss. Trees of a fixed depth, as arrays; scoring is vectorised over rows."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
        # A rare but telling value must have a bin of its own, or quantiles of mostly zeros hide it.
        edges = [np.unique(np.concatenate((e, np.quantile(c[c > 0], np.linspace(0, 1, self.bins)) if (c > 0).any() else [], [0.0]))) for e, c in zip(edges, x.T, strict=True)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        width = max(len(e) for e in edges) + 1
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-9)
                for j in range(x.shape[1]):
                    key = (node - first) * width + binned[:, j]
                    gs = np.bincount(key, g, many * width).reshape(many, width).cumsum(1)
                    hs = np.bincount(key, h, many * width).reshape(many, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    gain[:, len(edges[j]) :] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(many), k]
                    for i in np.flatnonzero(top > best):
                        best[i], feature[first + i], cut[first + i] = top[i], j, edges[j][k[i]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.penalty)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += value[node - (2**self.depth - 1)]
        return f


class Isotonic:
    """Pool-adjacent-violators fit of probability on margin; linear between block means, clamped outside."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        blocks: list[list[float]] = []
        for m, t in sorted(zip(margin.tolist(), y.tolist(), strict=True)):
            blocks.append([m, t, 1.0])
            while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][0] == blocks[-1][0]):
                b, a = blocks.pop(), blocks.pop()
                n = a[2] + b[2]
                blocks.append([(a[0] * a[2] + b[0] * b[2]) / n, (a[1] * a[2] + b[1] * b[2]) / n, n])
        self.x, self.y = np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        # A small slope keeps the order of margins within a block.
        return np.clip(np.interp(margin, self.x, self.y) * 0.998 + 0.002 / (1 + np.exp(-margin)), 0, 1)


class Model:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, calibration: Isotonic | None, mean: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.mean = lexicon, trees, calibration, mean

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.mean)
        x = np.array([self.lexicon.features(t or b"") for t in texts]).reshape(len(texts), len(FEATURES))
        return self.calibration(self.trees.margin(x))


def fold(df: DataFrame) -> DataFrame:
    """Adds _fold: crc32 of the doc_id as text, modulo 5."""
    return df.withColumn("_fold", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5)


def _mined(counts: DataFrame, n0: int, n1: int, least_g: float, most: int) -> list[tuple[str, str, float]]:
    """kind, term, weight of terms that toxic documents use more often, by the likelihood-ratio statistic, at most `most` of each kind."""
    total, base = n0 + n1, n1 / (n0 + n1)
    a, df = F.col("a"), F.col("a") + F.col("b")
    xlog = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = 2 * (xlog(a, df * base) + xlog(F.col("b"), df * (1 - base)) + xlog(n1 - a, (total - df) * base) + xlog(n0 - F.col("b"), (total - df) * (1 - base)))
    weight = F.log((a + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    scored = counts.withColumn("g", g).withColumn("w", weight).filter(F.col("w") > 1.0).filter(F.col("g") > least_g)
    tops = [scored.filter(F.col("kind") == k).orderBy(F.desc("g"), "term").limit(most) for k in ("w", "b")]
    return [(r.kind, r.term, r.w) for r in tops[0].unionByName(tops[1]).collect()]


def train(docs: DataFrame, labels: DataFrame, max_train: int = 40_000, max_terms: int = 2_000, least_g: float = 20.0) -> Model:
    """Lexicon, trees and calibration from at most max_train labelled rows that are not held out; the driver holds their features only."""
    spark = docs.sparkSession
    usable = fold(labels.select("doc_id", F.col("toxic").cast("int").alias("_y"))).filter("doc_id is not null and _y in (0, 1) and _fold <> 0")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_train)
    chosen = spark.createDataFrame([(r.doc_id, r._y, r._fold) for r in chosen.collect()], "doc_id long, _y int, _fold long")  # bounded by max_train
    ws = Workspace(spark)
    sample = ws.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("_y", "_fold", "text"), "sample")
    n = {r._y: r.n for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        ws.close()
        return Model(Lexicon({}, {}), None, None, float(n.get(1, 0) > 0))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            seen: dict[tuple[str, str], list[int]] = {}
            for y, t in zip(b.column(0).to_pylist(), raw(b.column(2)), strict=True):
                ws = set(tokens((t or b"").decode("utf-8", "replace")))
                for kind, own in (("w", ws), ("b", {w[:BEGINNING] for w in ws if len(w) > BEGINNING})):
                    for w in own:
                        seen.setdefault((kind, w), [0, 0])[y] += 1
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in seen], "term": [w for _, w in seen], "a": pa.array([v[1] for v in seen.values()], pa.int64()), "b": pa.array([v[0] for v in seen.values()], pa.int64())})

    counts = sample.mapInArrow(terms, "kind string, term string, a long, b long").groupBy("kind", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a >= 3")
    mined = _mined(counts, n[0], n[1], least_g, max_terms)
    lexicon = Lexicon({t: w for k, t, w in mined if k == "w"}, {t: w for k, t, w in mined if k == "b"})
    shared = spark.sparkContext.broadcast(lexicon)  # at most 2 * max_terms entries

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            x = [shared.value.features(t or b"") for t in raw(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["_y", "_fold", "x"])

    rows = sorted(sample.mapInArrow(features, "_y int, _fold long, x array<double>").collect())
    ws.close()
    y, x, folds = np.array([r._y for r in rows], float), np.array([r.x for r in rows]), np.array([r._fold for r in rows])
    # Out-of-fold margins calibrate; the trees that score see all training rows.
    margin = np.zeros(len(y))
    for k in (1, 2, 3, 4):
        out = folds == k
        if out.any():
            margin[out] = BoostedTrees().fit(x[~out], y[~out]).margin(x[out]) if 0 < y[~out].sum() < (~out).sum() else 0.0
    return Model(lexicon, BoostedTrees().fit(x, y), Isotonic(margin, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double and predicted int."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            p = shared.value.score(raw(b.column(b.schema.names.index("text"))))
            yield with_columns(b, {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, schema_with(docs, score="double", predicted="int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return fold(score(docs, model)).select("doc_id", (F.col("_fold") == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the model does not reject; all columns stay as they are, those named like a score too."""
    held = docs.select(col_or_null(docs, "doc_id", "long").alias("doc_id"), col_or_null(docs, "text", "string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(held, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            yield b.filter(pa.array(shared.value.score(raw(b.column(b.schema.names.index("text")))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
