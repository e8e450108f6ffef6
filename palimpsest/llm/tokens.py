"""Token-ID / binary output: fixed-width bit packing.

Each id takes the minimum number of bits that hold the vocabulary. A file holds blocks of `block` ids, then a footer with the documents'
ids and starts and the byte offset of every block, so that numpy unpacks whole blocks at once and any document or range is read alone.

Null texts count as empty: their document is the end id only. Documents stand in ascending doc_id order over all files, null doc_ids first;
repeated doc_ids stand next to each other, in the order of their ids' bytes (of their texts' crc32 first, where a doc_id or null has rows for more
than one file). Texts of any length are encoded whole. An empty table gives no file and no rows. Only doc_id and text are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, col_or_null, partitions, raw, slices

MAGIC, TRAILER = b"PALTOK1\n", struct.Struct("<QQQQB3xI8s")
NO_ID = -(1 << 63)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Big-endian bit string of the ids; the last byte is filled with zeros."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> shifts) & 1).tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", count).astype(np.uint32)
    places = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return places @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


class PackedWriter:
    """Writes one file as it goes; holds one block of ids and the footer."""

    def __init__(self, stream, bits: int, block: int = 65_536):
        if block % 8:
            raise ValueError("a block must be a multiple of 8 ids")
        self.stream, self.bits, self.block = stream, bits, block
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.offsets: list[int] = []
        self.held: list[np.ndarray] = []
        self.n, self.waiting, self.at = 0, 0, len(MAGIC)
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if ids.size and int(ids.max()) >> self.bits:
            raise ValueError("an id is beyond the vocabulary")
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.starts.append(self.n)
        self.n += ids.size
        self.held.append(ids)
        self.waiting += ids.size
        if self.waiting >= self.block:
            self._flush(self.waiting // self.block * self.block)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for i in range(0, count, self.block):
            data = pack(ids[i : min(i + self.block, count)], self.bits)
            self.offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.held, self.waiting = [ids[count:]], ids.size - count

    def close(self) -> None:
        self._flush(self.waiting)
        footer = np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes()
        self.stream.write(footer)
        self.stream.write(TRAILER.pack(self.at, len(self.docs), self.n, self.block, self.bits, zlib.crc32(footer), MAGIC))
        self.stream.close()


class PackedReader:
    """Random access to a file (any object with seek and read)."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        end = stream.tell()
        stream.seek(end - TRAILER.size)
        at, docs, self.n, self.block, self.bits, crc, magic = TRAILER.unpack(stream.read(TRAILER.size))
        stream.seek(at)
        footer = stream.read(end - TRAILER.size - at)
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError("not a packed token file, or a damaged one")
        self.docs = np.frombuffer(footer, "<i8", docs)
        self.starts = np.append(np.frombuffer(footer, "<u8", docs, 8 * docs), self.n).astype(np.int64)
        self.offsets = np.append(np.frombuffer(footer, "<u8", offset=16 * docs), at).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.stream.seek(int(self.offsets[first]))
        data = self.stream.read(int(self.offsets[last + 1] - self.offsets[first]))
        count = min((last + 1) * self.block, self.n) - first * self.block
        return unpack(data, count, self.bits)[start - first * self.block : stop - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def all_docs(self, blocks: int = 64) -> Iterator[tuple[int | None, np.ndarray]]:
        """Every document, reading up to `blocks` blocks at once."""
        lo, hi, ids = 0, 0, np.empty(0, np.uint32)
        for i, d in enumerate(self.docs.tolist()):
            a, b = int(self.starts[i]), int(self.starts[i + 1])
            if b > hi:
                lo, hi = a, min(self.n, max(b, a + blocks * self.block))
                ids = self.ids(lo, hi)
            yield (None if d == NO_ID else d), ids[a - lo : b - lo]


#: The form of tokenizer for which chunks without white space encode alone as they do in their text.
BY_CHUNKS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def by_chunks(tokenizer) -> bool:
    """Whether the tokenizer has that form, a BPE model without random dropout, no truncation, no padding and no added token with white space."""
    form = json.loads(tokenizer.to_str())
    same = all(form[k] == v for k, v in BY_CHUNKS.items()) and form["model"]["type"] == "BPE" and not form["model"]["dropout"]
    return same and not form["truncation"] and not form["padding"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in form["added_tokens"])


class Encoder(dict):
    """Texts to their ids' bytes, through the tokenizers library.

    A tokenizer of the form BY_CHUNKS never joins anything over ASCII white space, so chunks encode alone as they do in their text; two generations of
    known chunks, of a bounded size, are kept. A tail of plain punctuation after a letter is a token group of its own and is looked up apart.
    Texts of any other tokenizer go to the library whole.
    """

    TAIL, LONGEST = b".,;:!?", 64

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        self.chunks = by_chunks(self.tokenizer)
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        #: The byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on.
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - plain))}
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            core = chunk.rstrip(self.TAIL)
            if core and len(core) < len(chunk) and core[-1:].isalpha():
                found = self[core] + self[chunk[len(core) :]]
            elif chunk.isalpha() and not chunk.islower():
                found = self[chunk.lower()]
            else:
                found = array("I", self._ids(chunk.decode())).tobytes()  # little-endian here, as on all machines that Spark supports
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def _ids(self, text: str) -> list[int]:
        """A word of Latin letters is one pre-token, so the library's model takes it at once; anything else goes the whole way."""
        if text.isalpha() and max(text) < "\u0250":
            lower = "".join(c.lower() for c in text)
            if lower.isalpha() and max(lower) < "\u0250":
                return [t.id for t in self.tokenizer.model.tokenize(lower.encode().decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: bytes | None) -> bytes:
        if not self.chunks:
            return array("I", self.tokenizer.encode((text or b"").decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, (text or b"").split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker process's encoder: its chunks stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Parts:
    """The file of each document: by doc_id, below bounds (quantiles of the doc_ids, in order). A doc_id that several bounds equal, and null, have rows for several files and are dealt by the text's crc32."""

    def __init__(self, bounds: list[int], nulls: int):
        self.bounds, self.nulls = bounds, nulls

    def of(self, doc_id: int | None, text: bytes | None) -> tuple[int, int]:
        """The file, and the text's crc32 where it decides (else 0)."""
        if doc_id is None:
            first, many = 0, self.nulls
        else:
            lo, hi = bisect_left(self.bounds, doc_id), bisect_right(self.bounds, doc_id)
            first, many = self.nulls + (lo + 1 if hi > lo else lo), hi - lo
        if many < 2:
            return first, 0
        crc = zlib.crc32(text or b"")
        return first + (crc * many >> 32), crc


def encoded(docs: DataFrame, tokenizer: str, end_id: int, parts: Parts) -> DataFrame:
    """part int, doc_id long, crc long, ids binary (little-endian unsigned, 16 bits where all ids fit, else 32; with the end id)."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in slices(batches):
            texts = raw(b.column(1))
            part = [parts.of(i, t) for i, t in zip(b.column(0).to_pylist(), texts, strict=True)]
            ids = [np.frombuffer(encode(t) + end, "<u4").astype("<u2").tobytes() if encode.bits <= 16 else encode(t) + end for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.int32()), b.column(0), pa.array([c for _, c in part], pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "crc", "ids"])

    return docs.select(col_or_null(docs, "doc_id", "long").alias("doc_id"), col_or_null(docs, "text", "string").alias("text")).mapInArrow(run, "part int, doc_id long, crc long, ids binary")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, docs_per_file: int = 4096, folder: str | None = None) -> list[tuple[str, int, int]]:
    """Writes the files and returns, for each in order: its URI, documents, ids.

    The driver and each task hold one entry for each file: one for docs_per_file documents, but no more than 16 for each shuffle partition. A file is written under a name of its task attempt and then moved into place, so a lost executor's task can run again.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    bits = max(1, (Tokenizer.from_file(tokenizer).get_vocab_size() - 1).bit_length())
    unit = "<u2" if bits <= 16 else "<u4"
    folder = folder or Workspace(spark).path("tokens")
    ids = docs.select(col_or_null(docs, "doc_id", "long").alias("d"))
    rows, nulls = ids.agg(F.count("*"), F.count_if(F.col("d").isNull())).first()
    docs_per_file = max(docs_per_file, -(-rows // (16 * partitions(spark))))
    many = max(1, -(-(rows - nulls) // docs_per_file))
    cuts = [i / many for i in range(1, many)]
    bounds = list(ids.agg(F.percentile_approx("d", cuts, min(100 * many, 1_000_000)).alias("q")).first().q or []) if cuts else []
    parts = Parts(bounds, -(-nulls // docs_per_file))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        attempt = TaskContext.get().taskAttemptId()
        part, writer, done = None, None, []

        def close() -> None:
            writer.close()
            fs.move(f"{root}/{part:08d}.{attempt}", f"{root}/{part:08d}.tok")
            done.append((part, len(writer.docs), writer.n))

        for b in batches:
            for p, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if p != part:
                    if writer:
                        close()
                    part, writer = p, PackedWriter(fs.open_output_stream(f"{root}/{p:08d}.{attempt}"), bits)
                writer.add(d, np.frombuffer(x.as_buffer(), unit))
        if writer:
            close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([x[0] for x in done], pa.int32()), "docs": pa.array([x[1] for x in done], pa.int64()), "n": pa.array([x[2] for x in done], pa.int64())})

    dealt = encoded(docs, tokenizer, end_id, parts).repartition(many + parts.nulls, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "crc", "ids")
    files = dealt.mapInArrow(write, "part int, docs long, n long").collect()
    return [(f"{folder}/{r.part:08d}.tok", r.docs, r.n) for r in sorted(files)]


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32, read from the files; one task for each file."""
    base, at = [], 0
    for uri, _, n in files:
        base.append((uri, at))
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                uri, start = base[k]
                fs, path = pafs.FileSystem.from_uri(uri)
                out: list[tuple] = []
                with fs.open_input_file(path) as f:
                    for d, ids in PackedReader(f).all_docs():
                        out.append((d, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes())))
                        start += ids.size
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*out[i : i + 10_000], strict=True), strict=True)})

    return spark.range(0, len(base), 1, max(1, len(base))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    files = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(docs.sparkSession, files)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded, packed, written and read back."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
