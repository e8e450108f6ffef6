"""MinHash near-dedup by the chosen-path set similarity join.

Texts are sets of 5-word shingles. Equal sets are one class from the start. Every class enters 16 independent trees; in each it goes down a
path of chosen minwise tokens, and classes on the same path form a node. A node of more than `small` classes branches on two further minwise
tokens that the node chooses, until its children are small. Where a child keeps at least sqrt(1/2) of its parent, branching saves no
comparisons (two children cost 2 * share ** 2 of the parent), so such a dense node stays as it is; every other level shrinks nodes by that factor,
so that branching ends by itself. Nodes are then compared exhaustively, within a class of pairs that can still change the result:

1. every class against its node's first class, on the full sets: a group of similar texts costs one confirmation for each class;
2. classes that are not connected with their node's first class (the rest) against the whole node, on 128 sketch bytes, in blocks;
3. the classes of blocks with pairs that the sketch cannot rule out meet once more with their texts: all held sets against all others, exactly,
   through the block's inverted index. Only links that join two components leave the task, fewer than the block has classes.

So no step emits pairs within a group; what is shuffled grows with classes and blocks. A tree misses a pair of similarity 0.75 with probability
0.25 where its nodes are small. Where they branch, the pair is lost below a node only if both branches lose it: x = (0.25 + 0.75 x) ** 2 stays
under 1/9 at any depth, so that a tree misses it with at most 1/3 and all 16 with less than 3e-8, however large the nodes are. The sketch filter asks for
73 of 128 equal bytes; a pair of similarity 0.75 has fewer with about 1e-6. tests/llm measures recall against brute force.

Null texts and texts without words have empty sets and are linked with nothing. Texts of any length are read whole; blocks are cut by shingles as
well as by classes, so that a task holds a bounded number of shingles besides its largest text. Repeated doc_ids are documents of their own that
share an id. A null doc_id never is the smallest of a component; a component of null doc_ids only has a null id. Empty tables give empty results.
Extra columns pass through `keep_one`; columns beginning with `_nd_` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, col_or_null, mix64, partitions, raw, runs_of, schema_with, slices, with_columns

WORDS, TREES, COORDINATES, LEAST_EQUAL = 5, 16, 128, 73
#: Bytes of a sketch: one for each coordinate, then four of each tree's first token.
SKETCH = COORDINATES + 4 * TREES
SMALL, DENSE, BLOCK, BLOCK_SHINGLES = 1024, 0.5**0.5, 1024, 1 << 21
_random = np.random.default_rng(20240229)
PLACES = _random.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT_1, SALT_2, LENGTH = (np.uint64(x) for x in _random.integers(0, 1 << 63, 3, dtype=np.uint64))


class WordHashes(dict):
    """xxh64 of words; two generations of a bounded number of words of bounded length are kept."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.old = most, {}

    def __missing__(self, word: bytes) -> int:
        found = self.old.get(word)
        if found is None:
            found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(w) < WORDS:
            return mix64(np.array([(w * PLACES[: len(w)]).sum() + LENGTH * np.uint64(len(w))], np.uint64))
        n = len(w) - WORDS + 1
        h = w[:n] * PLACES[0]
        for k in range(1, WORDS):
            h += w[k : n + k] * PLACES[k]
    return np.unique(mix64(h))


def minima(h: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set under 64 hash orders."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 4096):
            np.minimum(out, (FACTORS[:, None] * h[None, i : i + 4096]).min(axis=1), out=out)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """docs with _nd_id, _nd_n (set size), _nd_f1 and _nd_f2 (128 bits of the set), _nd_top (the trees' first tokens), _nd_bytes (sketch)."""
    added = {"_nd_n": "long", "_nd_f1": "long", "_nd_f2": "long", "_nd_top": "binary", "_nd_bytes": "binary"}
    docs = docs.withColumn("_nd_id", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            n, f1, f2, top, small = [], [], [], [], []
            for text in raw(b.column(b.schema.names.index("text"))):
                h = shingles(text, hashes)
                m = minima(h)
                n.append(len(h))
                f1.append(int(mix64(h ^ SALT_1).sum()) if len(h) else 0)
                f2.append(int(mix64(h ^ SALT_2).sum()) if len(h) else 0)
                top.append(m[:TREES].tobytes())
                mixed = mix64(m)
                small.append(mixed.astype(np.uint8).tobytes() + mixed[:TREES].astype(np.uint32).tobytes())
            new = [pa.array(n, pa.int64()), *(pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)), pa.array(top, pa.binary()), pa.array(small, pa.binary())]
            yield with_columns(b, dict(zip(added, new, strict=True)))

    return docs.mapInArrow(run, schema_with(docs, **added))


def _first_nodes(reps: DataFrame) -> DataFrame:
    """node, cid, tree of each tree's first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = mix64(np.arange(1, TREES + 1, dtype=np.uint64))
        for b in slices(batches, 4096):
            tops = np.frombuffer(b"".join(raw(b.column(1))), np.uint64).reshape(-1, TREES)
            node = mix64(tops ^ tree).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), b.num_rows))], names=["node", "cid", "tree"])

    return reps.select("cid", "top").mapInArrow(run, "node long, cid long, tree int")


def _branches(rows: DataFrame, level: int) -> DataFrame:
    """Child nodes on two further minwise tokens, which the node chooses: parent, parent_n, node, cid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy().view(np.uint64)
            own = np.frombuffer(b"".join(raw(b.column(3))), np.uint8).reshape(-1, SKETCH)
            pick = mix64(node ^ np.uint64(7919 * level))
            first = (pick % np.uint64(COORDINATES)).astype(np.int64)
            # The second coordinate is never the first again, or both branches would lose the same pairs.
            second = (first + 1 + ((pick >> np.uint64(32)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
            for k, j in enumerate((first, second)):
                child = mix64(mix64(pick + np.uint64(k)) ^ own[np.arange(len(j)), j].astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(child), b.column(1)], names=["parent", "parent_n", "node", "cid"])

    return rows.select("node", "cid", "n", "bytes").mapInArrow(run, "parent long, parent_n long, node long, cid long")


def leaves(ws: Workspace, reps: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """The nodes to compare, of two classes at least: node, cid, n (classes in the node), tree (if small from the first level on, else TREES).

    Second, cid and mask: the trees in which the class is in a small node from the first level on.
    """
    first = _first_nodes(reps)
    counts = ws.stage(first.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "nodes")
    live = ws.stage(first.join(counts, "node").select("node", "cid", "n", "tree"), "live")
    done = [counts, live]
    out = live.filter(F.col("n") <= small)
    masks = ws.stage(out.groupBy("cid").agg(F.bit_or(F.expr("shiftleft(1, tree)")).alias("mask")), "masks")
    large, level = live.filter(F.col("n") > small).withColumn("tree", F.lit(TREES)), 2
    while not large.isEmpty():
        child = ws.stage(_branches(large.join(reps.select("cid", "bytes"), "cid"), level), "children")
        sizes = ws.stage(child.groupBy("parent", "parent_n", "node").agg(F.count("*").alias("n")), "sizes")
        dense = sizes.filter(F.col("n") >= DENSE * F.col("parent_n")).select(F.col("parent").alias("node")).distinct()
        go_on = sizes.filter("n > 1").join(dense.withColumnRenamed("node", "parent"), "parent", "left_anti").select("parent", "node", "n")
        rows = ws.stage(child.join(go_on, ["parent", "node"]).select("node", "cid", "n", F.lit(TREES).alias("tree")), "live")
        stay = ws.stage(large.join(dense, "node", "left_semi"), "dense")
        out = out.unionByName(stay).unionByName(rows.filter(F.col("n") <= small))
        large, level = rows.filter(F.col("n") > small), level + 1
        ws.drop(child, sizes)
        done += [rows, stay]
    out = ws.stage(out, "leaves")
    ws.drop(*done)
    return out, masks


def _alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sketches are close enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(raw(b.column(i))), np.uint8).reshape(-1, SKETCH)[:, :COORDINATES] for i in (2, 3))
            yield b.filter(pa.array((x == y).sum(1) >= LEAST_EQUAL)).select(["a", "b"])

    one, two = reps.select(F.col("cid").alias("a"), F.col("bytes").alias("bytes_a")), reps.select(F.col("cid").alias("b"), F.col("bytes").alias("bytes_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "bytes_a", "bytes_b").mapInArrow(run, "a long, b long")


def _stars(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """Each node's first class with every other."""
    pivots = nodes.groupBy("node").agg(F.min("cid").alias("a"))
    return _alike(nodes.select("node", F.col("cid").alias("b")).join(pivots, "node").filter("a <> b").select("a", "b").distinct(), reps)


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*columns).repartition(partitions(rows.sparkSession), "node", "block", "rest_block").sortWithinPartitions("node", "block", "rest_block", "role")


LOW7, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal bytes of x and each row of y (both as 64-bit words)."""
    d = y ^ x
    return 8 * y.shape[1] - np.bitwise_count((((d & LOW7) + LOW7) | d) & HIGH).sum(1, dtype=np.int64)


def _in_doubt(ws: Workspace, nodes: DataFrame, masks: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """node, block, rest_block, role (0: the rest, 1: the whole node), cid, label of classes in pairs of different labels that the sketch cannot rule out.

    The rest are the classes that are not connected with their node's first class; nodes without rest do not take part.
    """
    known = nodes.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = known.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min_by("label", "cid").alias("main")).filter("x <> y").select("node", "main")
    marked = ws.stage(known.join(mixed, "node").withColumn("rest", F.col("label") != F.col("main")).drop("main"), "marked")
    held = marked.filter("rest").join(reps.select("cid", "size"), "cid").groupBy("node").agg(F.count("*").alias("r"), F.sum("size").alias("w"))
    full = marked.join(held, "node").join(reps.select("cid", "bytes"), "cid").join(masks, "cid", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest_blocks = F.greatest(F.ceil(F.col("r") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    spot = F.pmod(F.xxhash64("cid"), F.lit(1 << 30))
    left = full.filter("rest").withColumns({"rest_block": (spot % rest_blocks).cast("int"), "role": F.lit(0)}).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = full.withColumns({"block": (spot % blocks).cast("int"), "role": F.lit(1)}).withColumn("rest_block", F.explode(F.sequence(F.lit(0), rest_blocks - 1)))
    columns = ["node", "block", "rest_block", "role", "cid", "label", "tree", "mask", "bytes"]
    dealt = _dealt(left.select(columns).unionByName(right.select(columns)), columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.int32(1) << np.arange(TREES, dtype=np.int32)
        few = 4
        for key, t in runs_of(batches, 3):
            role, cid, label = (t.column(i).to_numpy() for i in (3, 4, 5))
            k = int((role == 0).sum())
            if not k or k == len(role):
                continue
            tree, mask = t.column(6)[0].as_py(), t.column(7).to_numpy()
            sketch = np.frombuffer(b"".join(raw(t.column(8).combine_chunks())), np.uint8).reshape(-1, SKETCH)
            own, tops = np.ascontiguousarray(sketch[:, :COORDINATES]).view(np.uint64), np.ascontiguousarray(sketch[:, COORDINATES:]).view(np.uint32)
            start, others, other_label = np.ascontiguousarray(own[k:, :few]), own[k:], label[k:]
            seen = np.zeros(len(role), bool)
            for i in range(k):
                # A quarter of the sketch rules most pairs out: 8 of 32 equal bytes, where 0.75 gives 24 (six deviations less).
                hit = np.flatnonzero((equal_bytes(own[i, :few], start) >= 8) & (other_label != label[i]))
                hit = hit[equal_bytes(own[i], others[hit]) >= LEAST_EQUAL]
                if len(hit):
                    # A pair that an earlier small node holds as well is compared there.
                    earlier = (tops[k:][hit, :tree] == tops[i, :tree]) & ((mask[i] & bits[:tree]) != 0)
                    hit = hit[~earlier.any(1)]
                if len(hit):
                    seen[i] = True
                    seen[k + hit] = True
            if at := np.flatnonzero(seen).tolist():
                yield pa.RecordBatch.from_arrays([*(pa.array([int(x)] * len(at), kind) for x, kind in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(role[at]), pa.array(cid[at]), pa.array(label[at])], names=["node", "block", "rest_block", "role", "cid", "label"])

    return dealt.mapInArrow(run, "node long, block int, rest_block int, role int, cid long, label long")


class Held:
    """Sets that are held, by an inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.owner, self.size = owner[order], np.array([len(s) for s in sets])
        self.token, self.start = np.unique(tokens[order], return_index=True)
        self.start = np.append(self.start, len(tokens))

    def shared(self, s: np.ndarray) -> np.ndarray:
        """Size of the intersection of s with each held set."""
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        at = at[self.token[at] == s]
        lo, n = self.start[at], self.start[at + 1] - self.start[at]
        spots = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(at) else np.empty(0, np.int64)
        return np.bincount(self.owner[spots], minlength=len(self.size))


def similar(both: np.ndarray, one: np.ndarray, two: int) -> np.ndarray:
    """100 * |intersection| >= 75 * |union|."""
    return 100 * both >= 75 * (one + two - both)


def _links(doubt: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: labels that a confirmed pair of a block joins, a spanning forest for each block."""
    rows = _dealt(doubt.join(texts, "cid"), ["node", "block", "rest_block", "role", "cid", "label", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        key, held, names, index, up = None, [], [], None, {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for b in slices(batches, 256):
            out: list[tuple[int, int]] = []
            for *k, role, label, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), raw(b.column(6)), strict=True):
                if k != key:
                    key, held, names, index, up = k, [], [], None, {}
                s = shingles(text, hashes)
                if role == 0:
                    held.append(s)
                    names.append(label)
                elif held:
                    if index is None:
                        index, held = Held(held), [True]
                    for i in np.flatnonzero(similar(index.shared(s), index.size, len(s))).tolist():
                        x, y = root(names[i]), root(label)
                        if x != y:
                            up[x] = y
                            out.append((names[i], label))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs a, b that are similar on the full sets."""
    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, 256):
            sets: dict[int, np.ndarray] = {}

            def of(cid: int, text: bytes, sets=sets) -> np.ndarray:
                if cid not in sets:
                    sets[cid] = shingles(text, hashes)
                return sets[cid]

            linked = []
            for a, c, ta, tb in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), raw(b.column(3)), strict=True):
                x, y = of(a, ta), of(c, tb)
                linked.append(bool(similar(len(x) + len(y) - len(np.union1d(x, y)), len(x), len(y))))
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """v, label (the smallest vertex reachable) of all vertices of edges (a, b): minimum labels of neighbours with pointer jumping."""
    both = ws.stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = ws.stage(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).select(F.col("a").alias("v"), "label"), "labels")
    while True:
        near = both.join(labels, both.a == labels.v).select(F.col("b").alias("v"), "label", F.lit(None).cast("long").alias("old"))
        lower = near.unionByName(labels.withColumn("old", F.col("label"))).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("root"))
        later = ws.stage(lower.join(jump, "label").select("v", F.least("root", "label").alias("label"), "old"), "labels")
        ws.drop(labels)
        if later.filter("label <> old").isEmpty():
            ws.drop(both)
            return later.drop("old")
        labels = later


def _texts(ws: Workspace, rows: DataFrame, need: DataFrame) -> DataFrame:
    """cid, text of the classes that are needed."""
    return ws.stage(rows.select(F.col("_nd_id").alias("cid"), "text").join(need.distinct(), "cid", "left_semi"), "texts")


def classes(ws: Workspace, docs: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """The sketched documents and, for each distinct set, f1, f2, cid, label: equal labels mean connected sets.

    The documents are written once, bucketed by row: no later join shuffles their texts.
    """
    rows = ws.bucketed(sketched(docs), "_nd_id")
    sets = ws.stage(rows.filter("_nd_n > 0").groupBy("_nd_f1", "_nd_f2").agg(F.min("_nd_id").alias("cid")), "classes")
    reps = rows.select(F.col("_nd_id").alias("cid"), F.col("_nd_n").alias("size"), F.col("_nd_top").alias("top"), F.col("_nd_bytes").alias("bytes")).join(sets.select("cid"), "cid")
    reps = ws.stage(reps, "reps")
    nodes, masks = leaves(ws, reps, small)

    pairs = ws.stage(_stars(nodes, reps), "pairs")
    texts = _texts(ws, rows, pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))))
    links = ws.stage(_confirmed(pairs, texts), "links")
    ws.drop(pairs, texts)
    labels = ws.stage(components(ws, links).select(F.col("v").alias("cid"), "label"), "labels")

    doubt = ws.stage(_in_doubt(ws, nodes, masks, reps, labels), "doubt")
    ws.drop(nodes, masks, reps, links)
    if not doubt.isEmpty():
        texts = _texts(ws, rows, doubt.select("cid"))
        later = ws.stage(_links(doubt, texts), "links")
        ws.drop(texts)
        new = components(ws, later).select(F.col("v").alias("cid"), "label")
        moved = labels.join(new.select(F.col("cid").alias("label"), F.col("label").alias("to")), "label", "left").select("cid", F.coalesce("to", "label").alias("label"))
        labels = ws.stage(moved.unionByName(new).groupBy("cid").agg(F.min("label").alias("label")), "labels")
        ws.drop(later)
    ws.drop(doubt)
    found = sets.join(labels, "cid", "left").select(F.col("_nd_f1").alias("f1"), F.col("_nd_f2").alias("f2"), "cid", F.coalesce("label", "cid").alias("label"))
    return rows, found


def _members(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketched documents, and _nd_id, doc_id, _nd_n, _nd_label of those with words."""
    rows, sets = classes(ws, docs)
    held = rows.filter("_nd_n > 0").select("_nd_id", "_nd_n", "_nd_f1", "_nd_f2", F.col("doc_id").cast("long").alias("doc_id"))
    member = held.join(sets, (held._nd_f1 == sets.f1) & (held._nd_f2 == sets.f2)).select("_nd_id", "doc_id", "_nd_n", F.col("label").alias("_nd_label"))
    return rows, ws.stage(member, "members")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """_nd_id, doc_id, _nd_n, _nd_label (documents with equal labels are connected; null for empty sets) and component_id of every row."""
    ws = Workspace(docs.sparkSession)
    rows, member = _members(ws, docs)
    least = member.groupBy("_nd_label").agg(F.min("doc_id").alias("component_id"))
    out = member.join(least, "_nd_label").select("_nd_id", "doc_id", "_nd_n", "_nd_label", "component_id")
    doc_id = F.col("doc_id").cast("long")
    out = out.unionByName(rows.filter("_nd_n = 0").select("_nd_id", doc_id.alias("doc_id"), "_nd_n", F.lit(None).cast("long").alias("_nd_label"), doc_id.alias("component_id")))
    out = ws.stage(out, "found")
    ws.drop(rows, member)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, nulls last; documents without words all stay."""
    ws = Workspace(docs.sparkSession)
    columns = list(docs.columns)
    rows, member = _members(ws, docs.withColumn("doc_id", col_or_null(docs, "doc_id", "long")).withColumn("text", col_or_null(docs, "text", "string")))
    chosen = member.groupBy("_nd_label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_nd_id")).alias("k"))
    keep = chosen.select(F.col("k._nd_id").alias("_nd_id")).unionByName(rows.filter("_nd_n = 0").select("_nd_id"))
    keep = ws.stage(keep, "keep")
    ws.drop(member)
    return rows.join(keep, "_nd_id", "left_semi").select(*[f"`{c}`" for c in columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.col("_nd_n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
