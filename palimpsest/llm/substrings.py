"""Suffix-array dedup: every byte covered by a `length`-byte string that also starts anywhere else goes.

Sorting all suffixes of a corpus would move many times its size. Suffixes are sparse here, and still exact: each 200-byte window owns an
anchor, the leftmost 32-byte string of least hash in it. Equal windows have equal anchors at equal distances, so windows need comparing only
within anchors of equal 32 bytes. Consecutive windows with one anchor form a segment (up to 368 bytes).

1. Anchors whose 32 bytes occur once are done: nothing in their windows repeats.
2. A segment that occurs twice repeats as a whole (equal by two 64-bit hashes, of the anchor and of the segment).
3. The other segments, one of each kind, are range-partitioned by their anchors' leading bytes with sampled splitters (eight bytes, then the anchor's
   hash, so that a range never ends within one anchor and neighbouring buckets share no suffix group: nothing is left to compare over a
   boundary). A bucket sorts its windows as suffixes on one 8-byte key after the other, the way multikey quicksort does, all ties of a depth at
   once; ties that reach 200 bytes repeat.
4. An anchor with more kinds of segments than a task should hold (a passage of a third of all documents) is split by more bytes: its segments
   are cut again by longer anchors (each takes half of what is left of the length: 116, 158, ... up to whole windows) and go through steps 1 to 3.
   A segment is cut into a few pieces, not into windows.

Null texts count as empty. Texts shorter than the length stay; texts of any length are read whole, in pieces of 512 KB that overlap. Every row is a
text of its own, whatever its doc_id; matches never cross rows. Empty tables give empty results. `length` is 8 to 4,096. Only doc_id and text are
read by the query; `dedup_substrings` passes extra columns through and replaces columns named like its outputs; columns beginning with `_sd_` are
reserved. Cutting bytes can split a character: `kept` has the exact bytes, `text` drops broken characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, col_or_null, mix64, partitions, raw, runs_of, schema_with, slices, with_columns

HEAD, PIECE, MOST_KINDS = 32, 1 << 19, 512
SPOT = (1 << 12) - 1
_random = np.random.default_rng(20240301)
BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers:
        size = PIECE + 4200
        with np.errstate(over="ignore"):
            for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size + 1, factor, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string of x (at most PIECE + 4,095 bytes)."""
    up, down = powers(len(x))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[x] * up, dtype=np.uint64)))
        return mix64((total[k:] - total[:-k]) * down[: len(x) - k + 1])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    span, m = 1, keys
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(keys) - width + 1], m[width - span : len(keys) - span + 1])


def segments(data: bytes, length: int, head: int = HEAD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each stretch of windows with one anchor of `head` bytes: first and last window start, anchor, hash of the anchor."""
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(data) - length + 1, PIECE):
        x = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        h = rolling(x, head)
        best = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - head + 1)
        where = (best & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1))
        last = np.append(first[1:] - 1, len(where) - 1)
        yield first + at, last + at, where[first] + at, h[where[first]]


def _spot(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First window, count of further windows and the anchor's distance in one number."""
    return (first << 24) | ((last - first) << 12) | (anchor - first)


def _anchors(docs: DataFrame, length: int, head: int) -> DataFrame:
    """head, kind (hash of the whole segment), _sd_id, spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                view = memoryview(text or b"")
                for first, last, anchor, h in segments(text or b"", length, head):
                    out[0].append(h)
                    out[1].append(np.fromiter((xxhash.xxh3_64_intdigest(view[f : z + length]) for f, z in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first)))
                    out[2].append(np.full(len(first), i, np.int64))
                    out[3].append(_spot(first, last, anchor))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in out], names=["head", "kind", "_sd_id", "spot"])

    return docs.select("_sd_id", "text").mapInArrow(run, "head long, kind long, _sd_id long, spot long")


def multikey_ties(rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which rows (n x 8m bytes) equal another row of their group: multikey quicksort, all runs of ties of a depth at once; singles leave."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    tied = np.zeros(len(rows), bool)
    at, rank = np.arange(len(rows)), groups
    for depth in range(words.shape[1] + 1):
        key = words[at, depth - 1] if depth else np.zeros(len(at), np.uint64)
        order = np.lexsort((key, rank))
        at, rank, key = at[order], rank[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])
        single = new & np.append(new[1:], True)
        rank = np.cumsum(new)[~single]
        at = at[~single]
        if not len(at):
            return tied
    tied[at] = True
    return tied


SEGMENT = "lead long, head long, kind long, want int, _sd_id long, spot long, segment binary"


def _lead(segment: bytes, distance: int) -> int:
    """The anchor's first eight bytes, as a number in their order."""
    return int.from_bytes(segment[distance : distance + 8].ljust(8, b"\0"), "big") - (1 << 63)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names=names)


def _occurring(keys: np.ndarray) -> np.ndarray:
    """Places of keys that occur twice at least, in order."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return np.sort(order[np.append(same, False) | np.append(False, same)])


def _within_buckets(texts: DataFrame, length: int) -> DataFrame:
    """_sd_id, lo, hi: wanted segments' repeating stretches. texts: SEGMENT rows, range-partitioned and sorted by lead, head."""
    pad = -length % 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches, 2):
            want, ids, spots = (t.column(c).to_numpy() for c in ("want", "_sd_id", "spot"))
            held = raw(t.column("segment").combine_chunks())
            x, size = np.frombuffer(b"".join(held), np.uint8), np.array([len(s) for s in held])
            many = size - length + 1
            of = np.repeat(np.arange(len(held)), many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            where, distance, start = np.repeat(np.cumsum(size) - size, many) + place, (spots & SPOT)[of] - place, (spots >> 24)[of] + place
            hit = np.zeros(len(of), bool)
            # Equal windows have equal hashes: only those whose hash occurs again at their distance are sorted by their bytes.
            again = np.arange(len(of)) if len(x) > PIECE else _occurring(rolling(x, length)[where] ^ mix64(distance))
            rows = np.lib.stride_tricks.sliding_window_view(x, length)[where[again]]
            rows = np.pad(rows, ((0, 0), (0, pad))) if pad else rows
            hit[again] = multikey_ties(rows, distance[again]) & (want[of[again]] == 1)
            at = np.flatnonzero(hit)
            if len(at):
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) != 1) | (np.diff(of[at]) != 0)
                first, last = at[new], at[np.append(new[1:], True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[of[first]]), pa.array(start[first]), pa.array(start[last] + length)], names=["_sd_id", "lo", "hi"])

    return texts.mapInArrow(run, "_sd_id long, lo long, hi long")


def _cut_out(held: DataFrame, length: int) -> DataFrame:
    """SEGMENT rows of rows (text, list of kinds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            out = []
            for i, text, kinds in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2).to_pylist(), strict=True):
                for k in kinds:
                    lo, more = k["spot"] >> 24, k["spot"] >> 12 & SPOT
                    segment = text[lo : lo + more + length]
                    out.append((_lead(segment, k["spot"] & SPOT), k["head"], k["kind"], k["want"], i, k["spot"], segment))
            yield _rows(out)

    return held.mapInArrow(run, SEGMENT)


def _cut_again(rows: DataFrame, length: int, head: int) -> DataFrame:
    """SEGMENT rows cut into pieces by longer anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            out = []
            for want, i, spot, segment in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("want", "_sd_id", "spot", "segment")), strict=True):
                for first, last, anchor, h in segments(segment, length, head):
                    for f, z, at, code in zip(first.tolist(), last.tolist(), anchor.tolist(), h.view(np.int64).tolist(), strict=True):
                        piece = segment[f : z + length]
                        kind = xxhash.xxh3_64_intdigest(piece) - (1 << 63)
                        out.append((_lead(piece, at - f), code, kind, want, i, ((spot >> 24) + f) << 24 | (z - f) << 12 | (at - f), piece))
            yield _rows(out)

    return rows.mapInArrow(run, SEGMENT)


def _whole(rows: DataFrame, length: int) -> DataFrame:
    """_sd_id, lo, hi of whole segments."""
    lo = F.shiftright("spot", 24)
    return rows.select("_sd_id", lo.alias("lo"), (lo + F.shiftright("spot", 12).bitwiseAND(SPOT) + length).alias("hi"))


def _mixed(kinds: DataFrame) -> DataFrame:
    """head, kinds of anchors with several kinds of segments (head, kind, n), one of them at least that occurs once only."""
    return kinds.groupBy("head").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("head", "kinds")


def repeats(ws: Workspace, docs: DataFrame, length: int) -> DataFrame:
    """_sd_id, lo, hi: byte ranges (overlapping) of docs (_sd_id, text) that are covered by repeating strings."""
    head = min(HEAD, length)
    anchors = ws.stage(_anchors(docs, length, head), "anchors")
    heads = ws.stage(anchors.groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head"), "heads")
    live = ws.stage(anchors.join(heads, "head", "left_semi"), "live")
    ws.drop(anchors, heads)
    kinds = ws.stage(live.groupBy("head", "kind").agg(F.count("*").alias("n"), F.min(F.struct("_sd_id", "spot")).alias("at")), "kinds")
    cover = [ws.stage(_whole(live.join(kinds.filter("n > 1").select("head", "kind"), ["head", "kind"], "left_semi"), length), "whole")]
    ws.drop(live)
    mixed = ws.stage(_mixed(kinds), "mixed")
    chosen = kinds.join(mixed, "head").select(F.col("at._sd_id").alias("_sd_id"), F.struct("head", "kind", (F.col("n") == 1).cast("int").alias("want"), F.col("at.spot").alias("spot")).alias("k"))
    wanted = chosen.groupBy("_sd_id").agg(F.collect_list("k").alias("k"))
    rows = ws.stage(_cut_out(docs.select("_sd_id", "text").join(wanted, "_sd_id").select("_sd_id", "text", "k"), length), "segments")
    ws.drop(kinds)
    while True:
        few = rows.join(mixed.filter(F.col("kinds") <= MOST_KINDS), "head", "left_semi").select(*[c.split()[0] for c in SEGMENT.split(", ")])
        ranged = few.repartitionByRange(partitions(docs.sparkSession), "lead", "head").sortWithinPartitions("lead", "head")
        cover.append(ws.stage(_within_buckets(ranged, length), "within"))
        many = mixed.filter(F.col("kinds") > MOST_KINDS)
        if head == length or many.isEmpty():
            break
        head += max(1, (length - head) // 2)
        pieces = ws.stage(_cut_again(rows.join(many, "head", "left_semi"), length, head), "pieces")
        ws.drop(rows, mixed)
        kinds = ws.stage(pieces.groupBy("head", "kind").agg(F.count("*").alias("n"), F.min(F.struct("_sd_id", "spot")).alias("at")), "kinds")
        cover.append(ws.stage(_whole(pieces.filter("want = 1").join(kinds.filter("n > 1").select("head", "kind"), ["head", "kind"], "left_semi"), length), "whole"))
        mixed = ws.stage(_mixed(kinds), "mixed")
        one = kinds.join(mixed, "head", "left_semi").select("head", "kind", F.col("at._sd_id").alias("_sd_id"), F.col("at.spot").alias("spot"), "n")
        rows = pieces.join(one, ["head", "kind", "_sd_id", "spot"]).withColumn("want", F.when(F.col("n") == 1, F.col("want")).otherwise(0))
        rows = ws.stage(rows.select(*[c.split()[0] for c in SEGMENT.split(", ")]), "segments")
        ws.drop(pieces, kinds)
    ws.drop(rows, mixed)
    out = cover[0]
    for other in cover[1:]:
        out = out.unionByName(other)
    return out


def dedup_substrings(docs: DataFrame, length: int = 200, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary) and the text that is left.

    The documents are written once, bucketed by row: both reads that need texts together with other rows' findings shuffle no text.
    """
    if not 8 <= length <= SPOT + 1:
        raise ValueError(f"length must be 8 to {SPOT + 1}")
    spark = docs.sparkSession
    ws = Workspace(spark)
    held = docs.withColumn("doc_id", col_or_null(docs, "doc_id", "long")).withColumn("text", col_or_null(docs, "text", "string"))
    held = held.withColumn("_sd_id", F.monotonically_increasing_id())
    table = ws.bucketed(held, "_sd_id")
    found = repeats(ws, table, length)
    per_doc = found.groupBy("_sd_id").agg(F.collect_list(F.struct("lo", "hi")).alias("_sd_cover"))
    joined = table.join(per_doc, "_sd_id", "left")
    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept": "binary"} if keep_text else {})
    keep = [c for c in docs.columns if c not in added and (keep_text or c != "text")]
    keep += [c for c in ("doc_id", *(["text"] if keep_text else [])) if c not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            out: list[list] = [[], [], [], [], []]
            for text, cover in zip(raw(b.column(b.schema.names.index("text"))), b.column(b.schema.names.index("_sd_cover")).to_pylist(), strict=True):
                data, left, last, spans = text or b"", [], 0, 0
                edges = sorted((c["lo"], c["hi"]) for c in cover or ())
                end = -1
                for lo, hi in edges:
                    if lo > end:
                        spans += 1
                        left.append(data[last:lo])
                    end = max(end, hi)
                    last = end
                kept = b"".join([*left, data[last:]])
                for column, v in zip(out, (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(v)
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            new = {k: pa.array(v, t) for k, v, t in zip(added, out, types, strict=False)}
            if keep_text:
                new["text"] = pa.array([k.decode("utf-8", "ignore") for k in out[4]], pa.string())
            yield with_columns(b.select(keep), new)

    out = joined.mapInArrow(run, schema_with(joined.select(*[f"`{c}`" for c in keep]), **added))
    if not keep_text:
        out = ws.stage(out, "digests")
        ws.drop(table)
    return out


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeating 200-byte strings of every document."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
