"""Operators with models, mixing, URLs and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, quality, toxicity, urls
from tests.llm import brute


def test_targets(spark):
    def targets(sizes):
        found = mixing.targets(mixing.Workspace(spark), spark.createDataFrame(list(sizes.items()), "_source string, source_size long")).collect()
        assert {r._source: r.source_size for r in found} == sizes
        return {r._source: r.target for r in found}

    got = targets({"+a": 100, "+b": 100, "+c": 100, "-": 100})
    assert got["+a"] == 200 and got["-"] == 200 and sum(got.values()) == pytest.approx(600)
    assert got["+b"] == pytest.approx(2 * got["+c"])
    assert targets({}) == {} and targets({"+a": 0}) == {"+a": 0}
    r = random.Random(2)
    sizes = {f"+{k:03d}": r.choice((0, 5, 50, 500, 5000)) for k in range(50)} | {"-": 70}
    assert targets(sizes) == pytest.approx(brute.targets(sizes))


def test_mixing(frame, docs, empty):
    rows = mixing.plan(frame).collect()
    assert len(rows) == len(docs) and all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted((repr(r.doc_id), r["size"]) for r in rows) == sorted((repr(i), len((t or "").encode().split())) for i, t in docs)
    per: dict[float, int] = {}
    for r in rows:
        per[r.target] = per.get(r.target, 0) + r.taken
    longest = max(r["size"] for r in rows)
    assert all(abs(t - got) <= longest for t, got in per.items()) and sum(per.values()) <= 1.5 * sum(r["size"] for r in rows)
    again = mixing.plan(frame.repartition(5)).collect()
    key = lambda x: sorted((repr(r.doc_id), r["size"], r.taken) for r in x)
    assert key(rows) == key(again)
    out = mixing.mix(frame)
    assert out.columns == frame.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.plan(empty).collect() == []


def corpus(n: int = 400):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(300)]
    bad = ["vilex", "grotter", "snarf"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(15, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, frame, empty):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labelled)
    out = toxicity.fold(toxicity.score(docs, model)).collect()
    held = [r for r in out if r._fold == 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    edge = toxicity.score(frame, model)
    assert edge.columns == [*frame.columns, "predicted"] and all(0 <= r.score <= 1 for r in edge.collect())
    assert toxicity.score(empty, model).collect() == []
    kept = toxicity.drop_toxic(docs, labelled)
    assert kept.columns == docs.columns and {r.doc_id % 4 for r in kept.collect()} >= {1, 2, 3}
    for none in (labelled.limit(0), labelled.withColumn("toxic", labelled.toxic * 0)):
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}


def test_training_never_sees_held_out_rows(spark):
    rows, labels = corpus()
    import zlib

    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    texts = [t.encode() for _, t in rows[:50]]
    assert (a.score(texts) == b.score(texts)).all()


def test_isotonic_is_monotone():
    m = np.random.default_rng(1).normal(size=300)
    y = (np.random.default_rng(2).random(300) < 1 / (1 + np.exp(-2 * m))).astype(float)
    p = toxicity.Isotonic(m, y)(np.linspace(-5, 5, 200))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_quality(spark, frame, empty):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(300)] + ["the", "of", "and", "to"] * 20
    rows = []
    for i in range(300):
        w = [r.choice(words) for _ in range(r.randint(30, 90))]
        for k in range(9, len(w), 10):
            w[k] += "."
        if i % 5 == 0:
            w = [x.upper() + "!!" for x in w] if i % 2 else [w[0]] * 60
        rows.append((i, " ".join(w)))
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in out]) > 0.97
    edge = quality.classify(frame)
    assert set(frame.columns) <= set(edge.columns) and edge.count() == frame.count()
    assert all(r.score == 0 for r in edge.filter("votes is null").collect())
    assert quality.classify(empty).collect() == []


def test_quality_trains_on_different_texts(spark, monkeypatch):
    texts = [f"text number {k} has a few words of its own and ends here." for k in range(40)]
    least = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text")).first().text
    sizes, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, target: sizes.append(len(rows)) or fit(rows, target))
    quality.train(spark.createDataFrame([(t,) for t in texts + [least] * 30], "text string"), max_train=20)
    assert sizes == [20]


def test_estimate_recovers_accuracies():
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75] * 2
    votes = [np.where(r.random(20_000) < a, truth, ~truth) for a in accuracy]
    patterns: dict[str, int] = {}
    for row in zip(*votes):
        p = "".join("+" if v else "-" for v in row)
        patterns[p] = patterns.get(p, 0) + 1
    prior, table, _ = quality.estimate(patterns)
    assert abs(prior - 0.8) < 0.02 and np.allclose(table[:, 1, 2], accuracy, atol=0.03)
    assert quality.estimate({})[2] == {}


def test_urls(spark):
    pages = [
        (1, "http://WWW.Example.com/en/x?q", "", "x"), (2, "https://a.example.com/en/x", "", "x"), (3, "https://b.www.example.com/en/", None, "x"), (4, "http://x.net/es/1", "", "x"),
        (5, "ftp://x.net:80/fr/1", "", "x"), (6, "http://x.net/de/", "", "x"), (7, "no scheme", "", "x"), (8, None, None, "x"), (9, "http://com", "", "x"), (10, "http://notexample.com/en/#a", "", "x"), (10, "http://notexample.com/en/#a", "", "x"),
        (11, "http://bad.net/es/", "", "x"), (12, "http://liar.org/p", '<a href="http://bad.net/x">a</a>', "x"), (13, "http://fine.org/p", '<a href="http://other.org/x">a</a><img src="//fine.org/y">', "x"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5] == ("x.net:80", "/fr/1", None, "allow") and got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow") == got[8] and got[9] == ("com", "", None, "allow") and got[10][2] == "com/"
    assert got[12][2:] == (None, "block") and got[13][2:] == (None, "allow")
    assert urls.judge(df).count() == 14 and urls.judge(df.limit(0)).collect() == []


def test_scores_of_a_link_cycle_converge(spark):
    pages = [(1, "http://bad.net/es/", '<a href="http://liar.org/p">a</a>'), (2, "http://liar.org/p", '<a href="http://bad.net/x">a</a>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r.distrust for r in urls.judge(df).collect()}
    assert got == pytest.approx({"bad.net": 1 / (1 - 0.85**2), "liar.org": 0.85 / (1 - 0.85**2)}, abs=1e-4)
    with pytest.raises(RuntimeError, match="still move"):
        urls.judge(df, rounds=3)


def test_pipeline(spark, tmp_path):
    """The stages one after another on a small corpus, checked against what each must do."""
    import corpus_pipeline

    rows, labels = corpus(200)
    copies = [(1000 + i, t) for i, t in rows if i % 10 == 1]
    item = " ".join(f"bench{k}" for k in range(14))
    leak = [(2000, " ".join(rows[5][1].split()[:10]) + " " + item + " tail words " + " ".join(rows[6][1].split()[:10]))]
    every = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in rows + copies + leak]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    toxic = {i for i, _, t in labels if t}
    assert not {r.doc_id for r in seen[0]} & toxic and {i for i, _ in rows} - toxic <= {r.doc_id for r in seen[0]}
    assert not {r.doc_id for r in seen[1]} & {i for i, _ in copies}
    assert "bench3" not in " ".join(r.text for r in seen[2]) and 2000 in {r.doc_id for r in seen[2]}
    assert len(seen[4]) == len(seen[3])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, seen[4]))
