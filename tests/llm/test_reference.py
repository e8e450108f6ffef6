"""Operators that SQL cannot express, against plain brute-force forms; recall and quality on generated and given tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import media, mixing, neardup, quality, toxicity, urls
from palimpsest.llm.queries import queries
from tests.llm import brute
from tests.llm.conftest import same
from tests.llm.test_models import corpus

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="the given tables are not here")


# Mixing: a queue that serves one document after another.


def fair_queue(rows, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """rows: (rid, source, order, doc_id, size). Times each document is taken by a sequential weighted fair queue."""
    sizes: dict[str, int] = {}
    for _, s, _, _, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal, budget = brute.targets(sizes, weights, share, most), share * sum(sizes.values())
    queue = []
    for s in sizes:
        spent = 0
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2] % (1 << 64), r[3] is not None, r[3] or 0, r[4], r[0]))
        for epoch in range(int(most)):
            if epoch * sizes[s] >= goal[s]:
                break
            for rid, _, order, _, n in own:
                spent += n
                if n:
                    queue.append((spent / goal[s], s, order, rid, n))
    taken: dict[int, int] = {}
    used = 0
    for _, _, _, rid, n in sorted(queue):
        if used + n > budget:
            break
        used += n
        taken[rid] = taken.get(rid, 0) + 1
    return taken


@pytest.mark.parametrize("seed", [0, 1])
def test_mixing_is_a_fair_queue(frame, seed):
    from palimpsest.llm.common import Workspace

    held = Workspace(frame.sparkSession).stage(frame.withColumn("row", F.monotonically_increasing_id()), "docs")
    rows = [(r._rid, r._source, r._order, r.doc_id, r["size"]) for r in mixing.sizes(held, seed, "row").collect()]
    expected = fair_queue(rows)
    got = {r._rid: r.copies for r in mixing.plan(held, seed=seed, rid="row").collect()}
    assert {k: v for k, v in got.items() if v} == expected and len(got) == len(rows)


@given
def test_mixing_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries()["op2_mixing"](spark, SF).collect()
    words = {r.doc_id: (len((r.text or "").encode().split()), r.source) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in out} == {i: n for i, (n, _) in words.items()}
    per: dict[str, list] = {}
    for r in out:
        per.setdefault(words[r.doc_id][1], []).append(r)
    goal = brute.targets({"+" + s: sum(r["size"] for r in rs) for s, rs in per.items()})
    for s, rs in per.items():
        assert all(r.target == pytest.approx(goal["+" + s]) and r.source_size == sum(x["size"] for x in rs) and r.taken <= 2 * r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - goal["+" + s]) <= max(r["size"] for r in out)


# Toxicity: boosted trees against exhaustive search over the same candidate cuts, and held-out quality.


def plain_trees(x, y, rounds, depth, rate, bins, penalty, least):
    """Greedy boosting that tries every candidate cut of every feature on the rows themselves."""
    cuts = []
    for c in x.T:
        e = np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]))
        more = np.quantile(c[c > 0], np.linspace(0, 1, bins)) if (c > 0).any() else []
        cuts.append(np.unique(np.concatenate((e, more, [0.0]))))
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    f = np.full(len(y), np.log(p0 / (1 - p0)))

    def grow(rows, g, h, level):
        if level == depth:
            return -rate * g[rows].sum() / (h[rows].sum() + penalty)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-9, 0, np.inf)
        for j, e in enumerate(cuts):
            for cut in e:
                left = rows[x[rows, j] <= cut]
                gl, hl = g[left].sum(), h[left].sum()
                if hl < least or total_h - hl < least:
                    continue
                gain = gl**2 / (hl + penalty) + (total_g - gl) ** 2 / (total_h - hl + penalty) - total_g**2 / (total_h + penalty)
                if gain > best[0] + 1e-9:
                    best = (gain, j, cut)
        _, j, cut = best
        return j, cut, grow(rows[x[rows, j] <= cut], g, h, level + 1), grow(rows[x[rows, j] > cut], g, h, level + 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
        return tree

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), 0)
        f = f + np.array([value(tree, r) for r in x])
    return f


def test_trees_equal_exhaustive_boosting():
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(200, 4)), 2)
    x[:, 3] = (r.random(200) < 0.1) * r.integers(1, 4, 200)
    y = (r.random(200) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 3 * (x[:, 3] > 0))))).astype(float)
    settings = {"rounds": 8, "depth": 3, "rate": 0.2, "bins": 12, "penalty": 1.0, "least": 1.0}
    model = toxicity.BoostedTrees(**settings).fit(x, y)
    assert np.allclose(model.margin(x), plain_trees(x, y, **settings), atol=1e-8)


def auc(score, label) -> float:
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    n1 = label.sum()
    return float((order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1)))


def test_isotonic_equals_quadratic_pooling():
    r = np.random.default_rng(3)
    m, y = r.normal(size=60), (r.random(60) < 0.4).astype(float)
    fit = toxicity.Isotonic(m, y)
    order = np.argsort(m)
    t = y[order]
    # The minimax form of isotonic regression.
    best = [max(min(t[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(np.sort(np.unique(np.round(best, 9))), np.sort(np.unique(np.round(fit.y, 9))))


@given
def test_toxicity_on_held_out_rows(spark):
    out = queries()["op3_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert auc(np.array([r.score for r in held]), np.array([r.toxic for r in held])) > 0.9


# Quality: one step of expectation-maximisation by enumeration, and agreement with labels that it never sees.


def test_posteriors_equal_enumeration():
    r = random.Random(2)
    patterns = {"".join(r.choice("+-0") for _ in range(10)): r.randint(1, 30) for _ in range(60)}
    prior, table, posterior = quality.estimate(patterns)
    for p, got in posterior.items():
        good, bad = prior, 1 - prior
        for j, c in enumerate(p):
            k = "-0+".index(c)
            good, bad = good * table[j, 1, k], bad * table[j, 0, k]
        assert got == pytest.approx(good / (good + bad), abs=1e-6)
    total = sum(patterns.values())
    assert prior == pytest.approx(sum(posterior[p] * n for p, n in patterns.items()) / total, abs=1e-6)
    for j, k in itertools.product(range(10), range(3)):
        n = sum(posterior[p] * m for p, m in patterns.items() if "-0+".index(p[j]) == k) + 0.5
        assert table[j, 1, k] == pytest.approx(n / (prior * total + 1.5), abs=1e-5)


@given
def test_quality_agrees_with_labels(spark):
    out = queries()["op4_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert len(out) > 100 and auc(np.array([r.score for r in out]), np.array([r.quality for r in out])) > 0.9


# URL filters: propagation against a dense personalised PageRank.


def dense_rank(hosts, links, seeds, damping=0.85):
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, n in links:
        m[at[b], at[a]] += n
    out = m.sum(0)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - damping * m, [seeds.get(h, 0.0) for h in hosts]), strict=True))


def test_propagation_equals_dense_pagerank(spark):
    """A graph with cycles, dangling hosts, a hub that a third of all pages link to, and chains of several links."""
    r = random.Random(8)
    hosts = [f"h{k}.{r.choice(['com', 'net', 'org'])}" for k in range(30)]
    pages = []
    for k in range(400):
        host = r.choice(hosts[:25])  # the last five hosts are only linked to
        links = [r.choice(hosts) for _ in range(r.randint(0, 4))] + (["h0.org"] if k % 3 == 0 else [])
        pages.append((k, f"http://{host}/{r.choice(['en', 'es', 'fr'])}/{k}", " ".join(f'<a href="http://{x}/p">' for x in links)))
    pages += [(1000 + k, f"http://chain{k}.org/p", f'<a href="https://chain{k + 1}.org/q">') for k in range(6)] + [(1006, "http://chain6.org/p", '<a href="//bad.net/es/x">'), (1007, "http://bad.net/es/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = urls.judge(df).collect()

    own: dict[str, list] = {}
    edges: dict[tuple[str, str], int] = {}
    for p in out:
        own.setdefault(p.host, []).append(p)
    import re

    for i, url, html in pages:
        src = url.split("://")[1].split("/")[0]
        for dst in re.findall(r'href="(?:https?:)?//([^/]+)', html or ""):
            if dst != src:
                edges[src, dst] = edges.get((src, dst), 0) + 1
    everyone = sorted({h for e in edges for h in e} | set(own))
    links = [(a, b, n) for (a, b), n in edges.items()]
    share = lambda v: {h: sum(p.rule is not None and v == verdict_of(p.rule) for p in ps) / len(ps) for h, ps in own.items()}
    verdict_of = {x.name: x.verdict for x in urls.RULES}.get
    trust = dense_rank(everyone, links, share("allow"))
    distrust = dense_rank(everyone, [(b, a, n) for a, b, n in links], share("block"))
    for p in out:
        assert p.trust == pytest.approx(trust[p.host], abs=1e-4) and p.distrust == pytest.approx(distrust[p.host], abs=1e-4)
        assert p.verdict == (verdict_of(p.rule) if p.rule else "block" if p.distrust - p.trust > 0.5 else "allow")
    assert {p.verdict for p in out if p.rule is None} == {"allow", "block"}
    assert max(p.distrust for p in out if p.host == "chain0.org") > 0.2


@given
def test_given_pages_have_no_links_between_hosts(spark):
    """The query's SQL rests on this."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    host, _ = urls.split_url(F.col("url"))
    assert urls.host_edges(pages.select(host.alias("host"), "html")).isEmpty()


# Media: every digest from the text itself.


def test_media_equals_brute_force(spark, frame, docs, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = []
    for i, t in docs:
        x = brute.data(t)
        payload = x + b" " * (max(192, -(-len(x) // 192) * 192) - len(x))
        image = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        p = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(float)
        weight = lambda n, k: np.array([[max(0.0, min((j + 1) * n / k, i + 1) - max(j * n / k, i)) for i in range(n)] for j in range(k)])
        area = lambda h, w: np.einsum("yi,xj,ijc->yxc", weight(p.shape[0], h), weight(64, w), p) / ((p.shape[0] / h) * (64 / w))  # noqa: B023, E731
        cells = area(8, 9) @ np.array([0.299, 0.587, 0.114])
        gaps = np.diff(cells, axis=1)
        tile = area(8, 8)
        rows.append((i, len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), gaps, tile))
    out = queries()["op10_media_columns"](spark, str(tmp_path)).collect()
    key = lambda r: (repr(r[0]), r[3])
    for got, want in zip(sorted(out, key=lambda r: (repr(r.doc_id), r.payload_sha256)), sorted(rows, key=key), strict=True):
        assert (got.doc_id, got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32, got.media_bytes, got.media_sha256) == want[:7]
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(got.feature), np.uint8)).reshape(8, 8).astype(bool)
        clear = np.abs(want[7]) > 1e-9  # where both cells are equal, rounding decides
        assert (bits[clear] == (want[7] > 0)[clear]).all()
        whole = np.floor(want[8] + 0.5).astype(np.uint8)
        if (np.abs(want[8] + 0.5 - np.round(want[8] + 0.5)) > 1e-9).all():
            assert got.tile_sha256 == hashlib.sha256(b"8 8 3 " + whole.tobytes()).hexdigest()
    assert media.media_columns(media.pack_text(frame)).filter("tile_npy is null").isEmpty()


# Near duplicates: recall and cost.


def _template(r: random.Random, n: int, shared: int, own: int, pairs: int) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """n texts around one passage, each with words of its own; the first 2 * pairs of them are near copies of each other by twos."""
    passage = [f"p{k}" for k in range(shared)]
    rows, found = [], []
    for i in range(n):
        if i % 2 and i < 2 * pairs:
            w = rows[-1][1].split()
            w[-3] = f"edit{i}"
            found.append((i - 1, i))
        else:
            w = passage + [f"w{r.randrange(10**6)}" for _ in range(own)]
        rows.append((i, " ".join(w)))
    return rows, found


@pytest.mark.parametrize("kind", ["sparse", "template", "dense"])
def test_near_recall(spark, kind):
    """Planted pairs near the threshold are all found, in texts of little, much and nearly enough in common, and nothing else is linked."""
    r = random.Random(6)
    shared, own = {"sparse": (0, 40), "template": (24, 24), "dense": (50, 14)}[kind]
    rows, pairs = _template(r, 1600, shared, own, 300)
    began = time.monotonic()
    component = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    took = time.monotonic() - began
    sets = [brute.shingles(t) for _, t in rows]
    close = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    pairs = [p for p in pairs if close(*p)]
    assert len(pairs) > 250 and sum(component[a] == component[b] for a, b in pairs) >= 0.95 * len(pairs)
    groups: dict[int, list[int]] = {}
    for i, c in component.items():
        groups.setdefault(c, []).append(i)
    # Whoever is linked has a link on the full sets.
    assert all(any(close(a, b) for b in g if b != a) for g in groups.values() if len(g) > 1 for a in g)
    assert took < 90


def test_held_sets_count_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, r.integers(1, 30)).astype(np.uint64)) for _ in range(20)]
    held = neardup.Held(sets[:8])
    for s in sets:
        assert held.shared(s).tolist() == [len(np.intersect1d(s, x)) for x in sets[:8]]
    assert held.shared(np.array([99], np.uint64)).tolist() == [0] * 8


def test_equal_bytes():
    r = np.random.default_rng(2)
    a = r.integers(0, 4, (50, 128), dtype=np.uint8)
    words = np.ascontiguousarray(a).view(np.uint64)
    assert neardup.equal_bytes(words[0], words).tolist() == (a == a[0]).sum(1).tolist()


# The pipeline against plain forms of its deterministic stages.


def test_pipeline_equals_its_plain_form(spark, tmp_path):
    """Toxicity by the trained model row by row, near-duplicates, decontamination and mixing by brute force, tokens by the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from palimpsest.llm import decontaminate
    from palimpsest.llm.common import Workspace

    rows, labels = corpus(160)
    rows += [(500 + i, t + " tail") for i, t in rows if i % 8 == 1]
    item = " ".join(f"bench{k}" for k in range(12))
    rows += [(900, rows[5][1] + " " + item), (901, item), (902, ""), (903, None)]
    every = [(i, t, "en", f"s{i % 3}", 1) for i, t in rows]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [r for r in every if model.score([brute.data(r[1])])[0] < 0.5]
    near = {i: kept or not n for i, n, _, kept in brute.near([(r[0], r[1]) for r in left])}
    left = [r for r in left if near[r[0]]]
    clean = []
    for i, t, lang, source, n in left:
        (_, words, hit, _, _, _), = brute.leaks([(i, t)], [(1, item)])
        if hit <= 0.8 * words:
            clean.append((i, t if t is None else t.replace(item, ""), lang, source, n))
    held = Workspace(spark).stage(spark.createDataFrame(clean, docs.schema).withColumn("row", F.monotonically_increasing_id()), "docs")
    sized = mixing.sizes(held, 0, "row").collect()
    copies = fair_queue([(r._rid, r._source, r._order, r.doc_id, r["size"]) for r in sized])
    number = {r._rid: r.doc_id for r in sized}
    text = {r[0]: r[1] for r in clean}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for i in sorted(number[rid] for rid, k in copies.items() for _ in range(k)):
        ids = t.encode(text[i] or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(got, want)
    assert decontaminate.WORD.pattern == brute.WORD.pattern
