"""Quality classifier from weak labels.

Ten overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of all vote patterns
(at most 3**10, whatever the corpus) estimates how often each labeller votes what on good and on bad documents, and gives every pattern its
posterior. The posteriors of a bounded, documented sample train a hashed linear scorer, which then scores all documents. No human label is used.

Null and empty texts get no votes, the prior as posterior and score 0. Texts of any length are read whole. Repeated rows score alike. An empty table gives an empty result. Extra
columns pass through; input columns named like an output are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import col_or_null, raw, schema_with, slices, with_columns

SIZE = 2048
#: Frequent function words of four languages.
FUNCTION_WORDS = frozenset(b"the of and to in a is that it for was on are as with be by this from at or an have not der die und das den von zu mit ist im ein eine auf f\xc3\xbcr nicht la le les de et des en un une du que est dans pour qui pas el los las y se del por con para una no su al".split())
#: Statistic -> (bad below, good from, good to, bad above); None where a side says nothing.
LABELLERS: dict[str, tuple[float | None, float, float, float | None]] = {
    "symbols": (None, 0.0, 0.004, 0.02),
    "capitals": (None, 0.0, 0.06, 0.25),
    "distinct": (0.45, 0.6, 2.0, None),
    "word_length": (3.2, 4.3, 6.8, 8.5),
    "top_word": (None, 0.0, 0.12, 0.3),
    "bars": (None, 2.0, 3.0, 0.03),
    "bangs": (None, 0.0, 0.02, 0.2),
    "stops": (0.01, 0.04, 0.35, 0.7),
    "repeats": (None, 0.0, 0.08, 0.3),
    "function_words": (0.02, 0.12, 0.6, None),
}


def statistics(words: list[bytes], counts: Counter, data: bytes) -> list[float]:
    n, size = len(words), len(data)
    letters = size - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    capitals = size - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    pairs = len(set(zip(words, words[1:], words[2:], strict=False)))  # noqa: B905
    return [
        (size - len(data.translate(None, b"#$%&*+<=>@\\^_|~{}[]"))) / size,
        capitals / max(1, letters),
        len(counts) / n**0.9 if n >= 15 else 0.5,
        sum(map(len, words)) / n,
        max(counts.values()) / n if n >= 15 else 0.2,
        counts[b"|"] / n,
        data.count(b"!") / n,
        (data.count(b".") + data.count(b"?") + data.count(b"!")) / n,
        1 - pairs / max(1, n - 2) if n >= 15 else 0.2,
        sum(counts[w] for w in FUNCTION_WORDS if w in counts) / n,
    ]


def votes(values: list[float]) -> str:
    """One character a labeller: + good, - bad, 0 nothing."""
    out = []
    for v, (low, good, to, high) in zip(values, LABELLERS.values(), strict=True):
        out.append("-" if (low is not None and v < low) or (high is not None and v > high) else "+" if good <= v <= to else "0")
    return "".join(out)


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good documents, vote probabilities (labeller, class, vote), and each pattern's posterior of good.

    Starts from the belief that labellers are right more often than not, which settles which class is the good one.
    """
    names = sorted(patterns)
    if not names:
        return 0.5, np.empty((0, 2, 3)), {}
    v = np.array([["-0+".index(c) for c in p] for p in names])
    weight = np.array([patterns[p] for p in names], float)
    good = 1 / (1 + np.exp(-1.5 * ((v == 2).sum(1) - 2.5 * (v == 0).sum(1))))
    for _ in range(rounds):
        prior = float((good * weight).sum() / weight.sum())
        table = np.empty((v.shape[1], 2, 3))
        for c, p in ((0, 1 - good), (1, good)):
            for k in range(3):
                table[:, c, k] = ((v == k) * (p * weight)[:, None]).sum(0) + 0.5
        table /= table.sum(2, keepdims=True)
        logit = np.log(max(prior, 1e-9)) - np.log(max(1 - prior, 1e-9)) + sum(np.log(table[j, 1, v[:, j]]) - np.log(table[j, 0, v[:, j]]) for j in range(v.shape[1]))
        later = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(later - good).max() < 1e-9
        good = later
        if done:
            break
    return prior, table, dict(zip(names, good.tolist(), strict=True))


class Slots(dict):
    """Hashed feature slots of a word: its shape, length and end. Bounded in number and length of words."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) >= 300_000:
            self.clear()
        shape = bytes(dict.fromkeys(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 117 if c > 127 else c for c in word))
        out = tuple(1 + zlib.crc32(x) % (SIZE - 1) for x in (b"s" + shape, b"l%d" % min(len(word), 20), b"e" + word[-2:].lower()))
        if len(word) <= 64:
            self[word] = out
        return out


_slots = Slots()


def vector(text: bytes | None) -> tuple[str | None, list[int], list[float]]:
    """Votes, slots and values of a text."""
    data = text or b""
    words = data.split()
    if not words:
        return None, [], []
    counts = Counter(words)
    values = statistics(words, counts, data)
    sums: dict[int, float] = {0: 1.0}
    for w, k in counts.items():
        for s in _slots[w]:
            sums[s] = sums.get(s, 0.0) + k / len(words)
    for name, v in zip(LABELLERS, values, strict=True):
        s = 1 + zlib.crc32(b"%s:%d" % (name.encode(), min(40, int(v * 50) if v < 1 else 40 + int(v)))) % (SIZE - 1)
        sums[s] = sums.get(s, 0.0) + 1.0
    return votes(values), list(sums), [x**0.5 for x in sums.values()]


def _patterns(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen: Counter = Counter()
            for t in raw(b.column(0)):
                words = (t or b"").split()
                if words:
                    seen[votes(statistics(words, Counter(words), t))] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    return docs.select("text").mapInArrow(run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def fit(rows: list[tuple[list[int], list[float]]], target: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft targets, full-batch Adagrad."""
    x = np.zeros((len(rows), SIZE), np.float32)
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
    w, seen = np.zeros(SIZE, np.float32), np.full(SIZE, 1e-8, np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target).astype(np.float32) / len(rows) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def train(docs: DataFrame, max_train: int = 12_000) -> tuple[dict[str, float], float, np.ndarray]:
    """Posterior of each vote pattern (from all documents), prior, and the scorer's weights (from the max_train texts of least hash)."""
    counts = {r.votes: r.n for r in _patterns(docs).collect()}
    prior, _, posterior = estimate(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [vector(t) for t in raw(b.column(0))]
            out = [o for o in out if o[0]]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.float32()))], names=["votes", "at", "v"])

    # Texts of least hash: first the hashes alone, each once however many copies there are, then the few texts below the last of them.
    hashed = docs.select(F.xxhash64("text").alias("h")).distinct()
    last = hashed.orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if last is None:
        return posterior, prior, np.zeros(SIZE, np.float32)
    sample = docs.filter(F.xxhash64("text") <= last).dropDuplicates(["text"]).limit(max_train)
    table = sample.select("text").mapInArrow(run, "votes string, at array<int>, v array<float>").toArrow()
    table = table.sort_by("votes")
    target = np.array([posterior[p] for p in table.column("votes").to_pylist()])
    weights = fit(list(zip(table.column("at").to_pylist(), table.column("v").to_pylist(), strict=True)), target) if len(target) else np.zeros(SIZE, np.float32)
    return posterior, prior, weights


def score(docs: DataFrame, model: tuple[dict[str, float], float, np.ndarray]) -> DataFrame:
    """docs with votes, posterior (of good), score (0 to 1, higher: better) and kept (score of 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 3**10 patterns and SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, prior, weights = shared.value
        for b in slices(batches):
            pattern, weak, p = [], [], []
            for t in raw(b.column(b.schema.names.index("text"))):
                v, at, x = vector(t)
                pattern.append(v)
                weak.append(posterior.get(v, prior) if v else prior)
                p.append(float(1 / (1 + np.exp(-np.clip(weights[at] @ np.array(x, np.float32), -30, 30)))) if v else 0.0)
            yield with_columns(b, {"votes": pa.array(pattern, pa.string()), "posterior": pa.array(weak, pa.float64()), "score": pa.array(p, pa.float64()), "kept": pa.array([s >= 0.5 for s in p])})

    return docs.mapInArrow(run, schema_with(docs, votes="string", posterior="double", score="double", kept="boolean"))


def classify(docs: DataFrame, max_train: int = 12_000) -> DataFrame:
    return score(docs, train(docs.select(col_or_null(docs, "text", "string").alias("text")), max_train))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "votes", "posterior", "score", "kept")
