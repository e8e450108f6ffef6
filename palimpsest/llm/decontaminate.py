"""Benchmark decontamination by a generalised suffix automaton over normalised test items.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Training words stream through the
automaton of all items, which tracks the longest suffix that occurs in any item; every occurrence of a window (10 consecutive words of an
item, or a whole shorter item) is a hit. Every span of hits is removed, those of short items included; a document whose hit share is over
`max_coverage` goes as a whole.

Null or empty texts have no words and no hits. Items without words have no window. Items with equal texts all count; repeated rows are
judged each on its own; a null item_id counts as 'null'. Texts of any length are read whole. Empty tables give empty results or no hits. Extra
columns pass through: `match` replaces input columns named like its outputs, `decontaminate` leaves all but text as they are.

A benchmark of more than `block_words` words is met in several automata, one after another: each pass writes the hits of one automaton, which is
then dropped, and the hits of all passes meet by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, raw, schema_with, slices, small_batches, spare_name, with_columns

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BITMAP = 1 << 22


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over the items' word ids."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ids = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in items if ws]
        for _, seq in ids:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, seq in ids:
            if len(seq) < window:
                self.short.setdefault(self._state(seq), []).append((len(seq), name))
            else:
                for _, state, length in self.stream(seq):
                    if length >= window:
                        self.windows.setdefault(self._at(state, window), set()).add(name)
        self.least = min((min(len(seq), window) for _, seq in ids), default=0)
        self.pairs = np.zeros(BITMAP, bool)
        for _, seq in ids:
            a = np.array(seq, np.int64)
            self.pairs[self.code(a[:-1], a[1:])] = True
        self.chain = self._chains()

    @staticmethod
    def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & (BITMAP - 1)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the string of p followed by c, cut out of the state that it shares with longer strings."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        cur = self._new(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, c)
        return cur

    def _state(self, seq: list[int]) -> int:
        s = 0
        for c in seq:
            s = self.next[s][c]
        return s

    def _at(self, state: int, length: int) -> int:
        """The state whose strings include the suffix of that length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _chains(self) -> list[int]:
        """For each state the nearest proper suffix state that ends a short item, or -1."""
        out = [-1] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[s]
            out[s] = up if up in self.short else out[up] if up > 0 else -1
        return out

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and length of the longest suffix that occurs in any item."""
        s, length = 0, 0
        for i, c in enumerate(seq):
            while s and c not in self.next[s]:
                s = self.link[s]
                length = self.len[s]
            if c in self.next[s]:
                s = self.next[s][c]
                length += 1
            else:
                length = 0
            yield i, s, length

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that can hold a whole window: known words with known pairs only."""
        if not self.least or len(ids) < self.least:
            return []
        if self.least == 1:
            ok = ids >= 0
            need = 1
        else:
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0) & self.pairs[self.code(ids[:-1], ids[1:])]
            need = self.least - 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= need
        return [(int(a), int(b) + (self.least > 1)) for a, b in zip(starts[keep], ends[keep], strict=True)]

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open spans of hit words, and the items with occurring windows."""
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))
        found: list[tuple[int, int]] = []
        names: set[str] = set()
        for a, b in self.runs(ids):
            for i, s, length in self.stream(ids[a:b].tolist()):
                end = a + i + 1
                if length >= self.window:
                    w = self._at(s, self.window)
                    if w in self.windows:
                        names |= self.windows[w]
                        found.append((end - self.window, end))
                if self.short:
                    u = s
                    while u > 0:
                        for n, name in self.short.get(u, ()):
                            if n <= length:
                                names.add(name)
                                found.append((end - n, end))
                        u = self.chain[u]
        return merged(found), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of a bounded number of words: one automaton is held and broadcast at a time, however large the benchmark."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        ws = words(r.t.encode() if r.t is not None else None)
        if block and held + len(ws) > block_words:
            yield block
            block, held = [], 0
        block.append((r.i, ws))
        held += len(ws)
    yield block


MATCHED = ("n_words", "hit_spans", "hit_items")
TYPES = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))


Then = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000, names: tuple[str, str, str] = MATCHED, then: tuple[Then, str] | None = None) -> DataFrame:
    """docs with n_words long, hit_spans array<int> (starts and ends of merged runs of hit words, in turn), hit_items array<string>.

    then: a function of these batches, and the schema of what it makes, to run in the same worker.
    """
    spark = docs.sparkSession
    small_batches(spark)
    after, schema = then or (iter, schema_with(docs, **dict(zip(names, ("long", "array<int>", "array<string>"), strict=True))))
    blocks = item_blocks(benchmark, block_words)
    items, more = next(blocks), next(blocks, None)
    if more is None:
        shared = spark.sparkContext.broadcast(SuffixAutomaton(items, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                texts = [words(t) for t in raw(b.column(b.schema.names.index("text")))]
                found = [shared.value.scan(ws) for ws in texts]
                new = ([len(ws) for ws in texts], [[x for s in hit for x in s] for hit, _ in found], [sorted(f) for _, f in found])
                yield with_columns(b, {n: pa.array(v, t) for n, v, t in zip(names, new, TYPES, strict=True)})

        return docs.mapInArrow(lambda batches: after(run(batches)), schema)

    ws, rid, at = Workspace(spark), spare_name(docs, "_rid"), spare_name(docs, "_hits")
    rows = ws.stage(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    hits = None
    for block in chain((items, more), blocks):
        one = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
        found = ws.stage(_hits(rows.select(F.col(f"`{rid}`").alias("r"), "text"), one), "hits")
        one.destroy()
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("r").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.join(hits.select(F.col("r").alias(rid), F.struct("spans", "items").alias(at)), rid, "left")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            columns = b.schema.names
            found = b.column(columns.index(at)).to_pylist()
            spans = [merged(list(zip(f["spans"][::2], f["spans"][1::2], strict=True))) if f else [] for f in found]
            new = ([len(words(t)) for t in raw(b.column(columns.index("text")))], [[x for s in hit for x in s] for hit in spans], [f["items"] if f else [] for f in found])
            yield with_columns(b.select([c for c in columns if c not in (rid, at)]), {n: pa.array(v, t) for n, v, t in zip(names, new, TYPES, strict=True)})

    return joined.select(*[f"`{c}`" for c in docs.columns], f"`{rid}`", f"`{at}`").mapInArrow(lambda batches: after(meet(batches)), schema)


def _hits(rows: DataFrame, shared) -> DataFrame:
    """r, spans, items of the rows (r, text) that one automaton hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [(r, [x for s in hit for x in s], sorted(names)) for r, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True) for hit, names in (shared.value.scan(words(t)),) if hit]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*out, strict=True)) or [()] * 3, TYPES, strict=True)], names=["r", "spans", "items"])

    return rows.mapInArrow(run, "r long, spans array<int>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8, block_words: int = 1_000_000) -> DataFrame:
    """docs without the spans of hit words (each holds a window or a whole shorter item), and without documents hit beyond max_coverage.

    A removed span reaches from its first word's first byte to its last word's last byte; the rest of the text stays byte for byte.
    """
    n_words, hit_spans, hit_items = names = tuple(spare_name(docs, n) for n in MATCHED)
    columns = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.names.index
            texts, keep = [], []
            for text, n, spans in zip(raw(b.column(at("text"))), b.column(at(n_words)).to_pylist(), b.column(at(hit_spans)).to_pylist(), strict=True):
                pairs = list(zip(spans[::2], spans[1::2], strict=True))
                keep.append(not pairs or sum(y - x for x, y in pairs) <= max_coverage * n)
                if pairs and keep[-1]:
                    where = [m.span() for m in WORD.finditer(text.lower())]
                    out, last = [], 0
                    for x, y in pairs:
                        out.append(text[last : where[x][0]])
                        last = where[y - 1][1]
                    text = b"".join([*out, text[last:]])
                texts.append(text)
            clean = with_columns(b, {"text": pa.array([t.decode() if t is not None else None for t in texts], pa.string())})
            yield clean.filter(pa.array(keep, pa.bool_())).select(columns)

    return match(docs, benchmark, window, block_words, names, (run, schema_with(docs)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every document against the whole benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, count, spans, items = (b.column(b.schema.names.index(c)) for c in ("doc_id", *MATCHED))
            items = items.to_pylist()
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, count, pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array([h > 0 for h in hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), then=(run, schema))
