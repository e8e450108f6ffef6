"""Operators whose results have a plain exact form."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import palimpsest.llm.neardup as neardup
import palimpsest.llm.substrings as substrings
from palimpsest.llm import decontaminate, lines, media, tokens
from palimpsest.llm.common import Workspace
from tests.llm import brute
from tests.llm.conftest import same


def test_lines(frame, docs, empty):
    out = lines.dedup_lines(frame)
    same(out.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect(), brute.lines(docs))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and dict(out.dtypes)["n_lines"] == "bigint"
    assert lines.dedup_lines(empty, keep_text=False).collect() == []


def test_line_index_compacts(spark):
    index = lines.LineIndex(Workspace(spark), 2, fanout=2)
    for k in range(5):
        new = index.lookup(spark.createDataFrame([(h, 0) for h in range(k * 3, k * 3 + 5)], "h1 long, h2 long"))
        index.add(new.filter("first is null").withColumn("first", new.h1 * 0 + k))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    found = {r.h1: r.first for r in index.lookup(spark.range(17).selectExpr("id as h1", "0L as h2")).collect()}
    assert found == {h: max(0, min(4, (h - 2) // 3)) for h in range(17)}
    index.drop()


@pytest.mark.parametrize("kinds", [512, 1])
def test_substrings(frame, docs, monkeypatch, kinds):
    monkeypatch.setattr(substrings, "MOST_KINDS", kinds)
    out = substrings.dedup_substrings(frame).cache()
    same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute.repeats(docs))
    assert all(r.kept.decode("utf-8", "ignore") == r.text for r in out.collect())


def test_substrings_empty(empty):
    assert substrings.dedup_substrings(empty, keep_text=False).collect() == []


def test_segments_cover_all_windows_and_blocks(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8).tobytes()
    monkeypatch.setattr(substrings, "PIECE", 700)
    substrings._powers.clear()
    at = [p for first, last, _, _ in substrings.segments(data, 200) for f, z in zip(first, last) for p in range(f, z + 1)]
    assert at == list(range(5000 - 199))
    substrings._powers.clear()


@given(st.lists(st.binary(min_size=8, max_size=16), min_size=1, max_size=30), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_multikey_ties(rows, groups):
    a = np.array([np.frombuffer(x.ljust(16, b"\0")[:16], np.uint8) for x in rows])
    g = np.arange(len(rows)) % groups
    keys = [(int(k), bytes(r)) for k, r in zip(g, a)]
    assert substrings.multikey_ties(a, g).tolist() == [keys.count(k) > 1 for k in keys]


def test_near_duplicates(frame, docs, empty):
    out = neardup.near_duplicates(frame)
    rows = out.select("doc_id", "_nd_n", "component_id", out.doc_id.eqNullSafe(out.component_id)).collect()
    same([(r[0], r[1], r[2], r[0] == r[2]) for r in rows], [(i, n, c, i == c) for i, n, c, _ in brute.near(docs)])
    assert neardup.near_duplicates(empty).collect() == []


def test_near_duplicates_in_branched_and_dense_nodes(spark, monkeypatch):
    """Many near copies and many unlike texts around one passage, with small limits: branches, dense leaves, blocks."""
    import random

    r = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    base, passage = [r.choice(words) for _ in range(60)], [r.choice(words) for _ in range(30)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(passage + [r.choice(words) for _ in range(40)])) for i in range(100, 160)]
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup.classes, "__defaults__", (6,))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    same(out.select("doc_id", "component_id").collect(), [(i, c) for i, _, c, _ in brute.near(rows)])


def test_near_duplicates_in_large_nodes_meet(spark):
    """Pairs of similarity 0.75 whose common tokens are frequent ones only, so that their nodes branch over many levels, share a leaf."""
    r = np.random.default_rng(11)
    rows, pairs, groups, size = [], [], 50, 150
    for g in range(groups):
        for k in range(size + 2):
            # A token is the group's frequent one or the class's own; the last two classes share 0.866 ** 2 of them, all frequent.
            own = r.random(neardup.COORDINATES) >= (0.6 if k < size else 0.75**0.5)
            m = np.where(own, r.integers(1 << 40, 1 << 62, neardup.COORDINATES), np.arange(neardup.COORDINATES) + 1000 * g).astype(np.uint64)
            mixed = neardup.mix64(m)
            rows.append((len(rows), m[: neardup.TREES].tobytes(), mixed.astype(np.uint8).tobytes() + mixed[: neardup.TREES].astype(np.uint32).tobytes()))
        pairs.append((len(rows) - 2, len(rows) - 1))
    ws = neardup.Workspace(spark)
    leaves, _ = neardup.leaves(ws, spark.createDataFrame(rows, "cid long, top binary, bytes binary"), 6)
    wanted = {c for pair in pairs for c in pair}
    held: dict[int, set[int]] = {c: set() for c in wanted}
    for row in leaves.filter(leaves.cid.isin(list(wanted))).select("node", "cid").collect():
        held[row.cid].add(row.node)
    assert [p for p in pairs if not held[p[0]] & held[p[1]]] == []


def test_keep_one(frame, docs):
    out = neardup.keep_one(frame)
    assert out.columns == frame.columns
    roots: list[int] = []
    found = brute.near(docs, roots)
    assert out.count() == len(set(roots)) + sum(not n for _, n, _, _ in found)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short Item"), (3, None), (4, "..."), (None, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (10, "été: 12 naïve")]


def test_decontaminate(spark, frame, docs, empty):
    extra = [(70, "x ALPHA-beta gamma delta epsilon zeta eta theta iota kappa nothing short item ete"), (71, "short, item! été 12 naïve"), (72, ITEMS[0][1] + " " + ITEMS[0][1]), (73, "alpha beta gamma delta epsilon zeta eta theta iota x")]
    every = frame.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (1_000_000, 5):
        found = decontaminate.match(every, bench, block_words=block)
        import hashlib

        rows = [(r.doc_id, r.n_words, sum(r.hit_spans[1::2]) - sum(r.hit_spans[::2]), len(r.hit_items), hashlib.sha256(",".join(r.hit_items).encode()).hexdigest(), bool(r.hit_spans)) for r in found.collect()]
        same(rows, brute.leaks(docs + extra, ITEMS))
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(every, bench, max_coverage=0.9).collect()}
    assert kept[70].startswith("x  nothing ") and 72 not in kept and kept[40] is None
    assert decontaminate.match(empty, bench).collect() == [] and decontaminate.match(empty, bench.limit(0)).collect() == []


def test_decontaminate_removes_whole_short_items(spark):
    rows = [(1, "one two three SHORT-item, four five six seven"), (2, "été: 12 Naïve at the front of this text"), (3, "short of an item"), (4, "a b c d e f short item short item g h")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (1_000_000, 5):
        found = decontaminate.match(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=block)
        assert sorted(r.doc_id for r in found.filter("size(hit_spans) > 0").collect()) == [1, 2, 4]
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert kept == {1: "one two three , four five six seven", 2: " at the front of this text", 3: "short of an item", 4: "a b c d e f  g h"}


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=4), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_automaton(items, text, window):
    named = [(str(k), [w.encode() for w in x]) for k, x in enumerate(items)]
    machine = decontaminate.SuffixAutomaton(named, window)
    spans, names = machine.scan([w.encode() for w in text])
    (expected,) = brute.leaks([(0, " ".join(text))], [(k, " ".join(x)) for k, x in enumerate(items)], window)
    assert (sum(b - a for a, b in spans), len(names)) == expected[2:4]


def test_tokens_round_trip(frame, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    of = lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]
    files = tokens.write_tokens(frame, public_tokenizers.path("word_bpe_49k.json"), 2, docs_per_file=7)
    rows = tokens.read_tokens(frame.sparkSession, files).orderBy("start").collect()
    assert sorted((repr(i), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in ((i, of(x)) for i, x in docs)) == sorted((repr(r.doc_id), r.ids_crc32) for r in rows)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(files) > 3
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert tokens.read_tokens(frame.sparkSession, tokens.write_tokens(empty, public_tokenizers.path("word_bpe_49k.json"), 2)).collect() == []


@given(st.text(alphabet="aAbéÉñßİıſKΣς'sdt.,!|  \t\n\x0b\x0c\r\x1c\x85́一二👍<>endoftext12ǅŉœÿ", max_size=40))
@settings(max_examples=200, deadline=None)
def test_encoder_is_the_library(text):
    import public_tokenizers

    e = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for x in (text, text + "<|endoftext|>"):
        ids = e.tokenizer.encode(x, add_special_tokens=False).ids
        assert e(x.encode()) == struct.pack(f"<{len(ids)}I", *ids)


@given(st.integers(1, 20), st.data())
@settings(max_examples=60, deadline=None)
def test_packing(bits, data):
    import io

    docs = data.draw(st.lists(st.lists(st.integers(0, (1 << bits) - 1), max_size=40), max_size=6))
    out = io.BytesIO()
    out.close = lambda: None
    w = tokens.PackedWriter(out, bits, block=16)
    for k, ids in enumerate(docs):
        w.add(k if k else None, np.array(ids, np.uint32))
    w.close()
    r = tokens.PackedReader(out)
    assert [r.doc(k).tolist() for k in range(len(docs))] == docs
    assert [(k, x.tolist()) for k, x in r.all_docs(2)] == [(k or None, x) for k, x in enumerate(docs)]


def test_media(frame, docs, empty):
    for form in ("ppm", "bmp"):
        out = media.media_columns(media.pack_text(frame, form)).collect()
        import hashlib

        payload = lambda t: brute.data(t) + b" " * (max(192, -(-len(brute.data(t)) // 192) * 192) - len(brute.data(t)))
        same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out], [(i, len(brute.data(t)), len(payload(t)), hashlib.sha256(payload(t)).hexdigest(), zlib.crc32(payload(t)[-16:])) for i, t in docs])
        assert all(r.media_error is None and len(r.dhash) == 16 for r in out)
    assert media.media_columns(media.pack_text(empty)).collect() == []


@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 12), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_area_resize(h, w, height, width):
    p = np.random.default_rng(h * 41 + w).integers(0, 256, (h, w, 3), dtype=np.uint8)
    weight = lambda n, k: np.array([[max(0.0, min((j + 1) * n / k, i + 1) - max(j * n / k, i)) for i in range(n)] for j in range(k)])
    a, b = weight(h, height), weight(w, width)
    expected = np.einsum("yi,xj,ijc->yxc", a, b, p.astype(float)) / ((h / height) * (w / width))
    assert np.allclose(media.area_resize(p, height, width), expected)


def test_decoders(spark):
    p = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(media.encode_ppm(p)) == p).all() and (media.decode(media.encode_bmp(p)) == p).all()
    assert media.decode(b"P1 # c\n2 2\n1 0\n01").ravel().tolist() == [0, 255, 255, 0]
    assert media.decode(b"P2\n2 1\n15\n0 15\n").ravel().tolist() == [0, 255]
    assert media.decode(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P5\n1 1\n65535\n\xff\xff").ravel().tolist() == [255]
    bad = spark.createDataFrame([(bytearray(b"P6\n9 9\n255\nxx"),), (bytearray(b"??"),), (None,), (bytearray(b""),)], "media binary")
    assert all(r.media_error and r.dhash is None for r in media.media_columns(bad).collect())
