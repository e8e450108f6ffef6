"""Very long texts, nulls, empties, repeated rows, clashing columns and clean-up, for every operator and stage."""

from __future__ import annotations

import hashlib
import json
import random
import struct
import zlib

import pytest

from palimpsest import storage
from palimpsest.llm import common, decontaminate, lines, media, mixing, neardup, quality, substrings, tokens, toxicity, urls
from tests.llm import brute
from tests.llm.conftest import same


@pytest.fixture(scope="module")
def long_docs():
    r = random.Random(9)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    big = " ".join(r.choice(words) + ("\n" if r.random() < 0.02 else "") for _ in range(450_000))
    cut = big[:120_000]
    one = "x" * 300_000  # one word, one line
    return [(1, big), (2, cut), (3, cut + " and a tail"), (4, None), (5, ""), (None, None), (None, cut), (6, one), (6, one), (7, "\n" * 50_000)]


@pytest.fixture(scope="module")
def long_frame(spark, long_docs):
    return spark.createDataFrame(long_docs, "doc_id long, text string")


def test_big_is_big(long_docs):
    assert len(long_docs[0][1].encode()) > 3_000_000


def test_lines(long_frame, long_docs):
    same(lines.dedup_lines(long_frame, keep_text=False).collect(), brute.lines(long_docs))


def test_substrings_over_pieces(spark, long_docs):
    docs = [(i, t[:700_000] if t else t) for i, t in long_docs if i != 6]
    out = substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), keep_text=False)
    same(out.collect(), brute.repeats(docs))


@pytest.mark.parametrize("length", [8, 24, 40, 333])
def test_substrings_of_other_lengths(frame, docs, length):
    out = substrings.dedup_substrings(frame.select("doc_id", "text"), length=length, keep_text=False)
    same(out.collect(), brute.repeats(docs, length))


def test_substring_lengths_are_checked(frame):
    for length in (0, 7, 4097):
        with pytest.raises(ValueError):
            substrings.dedup_substrings(frame, length=length)


def test_near(long_frame, long_docs):
    rows = neardup.near_duplicates(long_frame).select("doc_id", "_nd_n", "component_id").collect()
    same([(r[0], r[1], r[2], r[0] == r[2]) for r in rows], [(i, n, c, i == c) for i, n, c, _ in brute.near(long_docs)])


def test_tokens(long_frame, long_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = tokens.read_tokens(long_frame.sparkSession, tokens.write_tokens(long_frame, path, 2, docs_per_file=2)).collect()
    of = lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]
    assert sorted((repr(i), len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in ((i, of(x)) for i, x in long_docs)) == sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows)


def test_tokens_of_one_doc_id_spread_over_files(spark):
    import public_tokenizers

    rows = [(1, "first")] + [(5, f"text {k}") for k in range(60)] + [(None, f"null {k}") for k in range(25)] + [(9, "last")]
    files = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 2, docs_per_file=8)
    assert len(files) >= 8 and max(n for _, n, _ in files) < 30
    out = tokens.read_tokens(spark, files).orderBy("start").collect()
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]


def test_other_tokenizers_go_to_the_library():
    import public_tokenizers

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder(public_tokenizers.path(name))
        assert e.chunks == (name == "word_bpe_49k.json")
        for text in ("", " ", "Hello,  World!\n\nAnd  what's\tthis? naïve café 😀", "a  b   c"):
            ids = e.tokenizer.encode(text, add_special_tokens=False).ids
            assert e(text.encode()) == struct.pack(f"<{len(ids)}I", *ids)
    form = json.loads(tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer.to_str())
    assert set(tokens.BY_CHUNKS) <= set(form)


def test_decontamination(long_frame, long_docs, spark):
    item = " ".join(long_docs[0][1].split()[1000:1014])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    found = decontaminate.match(long_frame, bench).collect()
    rows = [(r.doc_id, r.n_words, sum(r.hit_spans[1::2]) - sum(r.hit_spans[::2]), len(r.hit_items), hashlib.sha256(",".join(r.hit_items).encode()).hexdigest(), bool(r.hit_spans)) for r in found]
    same(rows, brute.leaks(long_docs, [(1, item), (2, None), (3, "")]))


def test_media(long_frame, long_docs):
    out = media.media_columns(media.pack_text(long_frame)).collect()
    assert len(out) == len(long_docs) and all(r.payload_bytes >= r.n_bytes and r.payload_bytes % 192 == 0 and r.media_error is None for r in out)


def test_models_and_mixing(long_frame, long_docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, toxic int")
    assert toxicity.score(long_frame, toxicity.train(long_frame, labels)).count() == len(long_docs)
    assert quality.classify(long_frame).count() == len(long_docs)
    sizes = sorted(r["size"] for r in mixing.plan(long_frame).collect())
    assert sizes == sorted(len((t or "").encode().split()) for _, t in long_docs)


def test_urls(spark):
    html = "<p>word</p>" * 300_000 + '<a href="http://blocked.net/es/">a</a>'
    pages = [(1, "http://blocked.net/es/", None), (2, "http://friend.org/" + "a" * 200_000, html), (3, None, None), (3, None, None)]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[2].verdict == "block" and out[3].verdict == "allow" and len(out[2].path) == 200_001


CLASHING = "score string, predicted string, n_words string, hit_spans string, hit_items string, _rid string, _times string, _hits string, copies string, size string, source_size string, target string, taken string, _rule string, trust string, _chunk string, _h1 string, N_LINES string"


def test_columns_of_the_same_names_survive_the_stages(spark, tmp_path):
    import corpus_pipeline

    names = [c.split()[0] for c in CLASHING.split(", ")]
    texts = ["alpha beta gamma delta epsilon", None, "", "one two three four five six seven", "one two three four five six seven", "bench one two three four five six seven eight nine ten"]
    rows = [(k, t, "en", "s", 1, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)] + [(None, None, None, None, None, *[None] * len(names))] * 2
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    given = {r.doc_id: tuple(r[n] for n in names) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert tuple(r[n] for n in names) == given[r.doc_id], name
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == [], name


def test_decontamination_in_blocks_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", "y", "z", "r"), (2, "q", None, None, None, None)], "doc_id long, text string, n_words string, hit_spans string, _hits string, _rid string")
    bench = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "zz zz")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench, max_coverage=0.9, block_words=1).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, " c ", "x", "y", "z", "r"), (2, "q", None, None, None, None)]


def test_lines_and_urls_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a line of ten or more\nb", "c", "k", "h", 7), (2, "A LINE of ten or more", "d", "l", "i", 8)], "doc_id long, text string, _chunk string, _kind string, _h1 string, _first int")
    out = lines.dedup_lines(docs).orderBy("doc_id").collect()
    assert [(r.text, r._chunk, r._kind, r._h1, r["_first"], r.n_dropped) for r in out] == [("a line of ten or more\nb", "c", "k", "h", 7, 0), ("", "d", "l", "i", 8, 1)]
    pages = spark.createDataFrame([(1, "http://a.com/x", "mine")], "page_id long, url string, _rule string")
    assert urls.judge(pages).first()["_rule"] == "mine"


def test_nothing_is_left(spark, frame, tmp_path):
    """Released operators leave no file below the shared folder and no table in the catalogue."""
    common.release(spark)
    before = {t.name for t in spark.catalog.listTables()}
    docs = frame.select("doc_id", "text", "source")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    ops = [lambda: lines.dedup_lines(docs), lambda: substrings.dedup_substrings(docs), lambda: neardup.keep_one(docs), lambda: mixing.mix(docs), lambda: toxicity.drop_toxic(docs, labels), lambda: quality.classify(docs)]
    for op in ops:
        assert op().count() >= 0
    held = [ws.root for ws in storage._open[spark.sparkContext.applicationId]]
    assert held
    common.release(spark)
    assert not storage._open[spark.sparkContext.applicationId] and {t.name for t in spark.catalog.listTables()} == before
    fs = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    assert not any(fs(r).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs(r)) for r in held)


def test_a_stage_deletes_the_tables_of_the_one_before(spark, frame):
    common.release(spark)
    with common.stage_tables(spark):
        kept = neardup.keep_one(frame.select("doc_id", "text"))
    other = mixing.plan(frame)
    assert kept.count() and len(storage._open[spark.sparkContext.applicationId]) > 1
    with common.stage_tables(spark):
        pass
    assert other.count() == frame.count()
    common.release(spark)
