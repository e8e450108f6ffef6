from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, kept string, host string, copies string, target string, votes string"


def make(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Documents with nulls, empties, copies, near copies, shared lines and passages, a long text and repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = text(60), "Licensed under the Same License, Version 2"
    docs = [(i, text(r.randint(8, 90))) for i in range(14)]
    base = text(80)
    docs += [(20, base), (21, base), (22, base.upper())]
    for i in range(23, 31):
        w = base.split()
        w[r.randrange(80)] = "edit%d" % i
        docs.append((i, " ".join(w)))
    docs += [(i, f"{text(12)}\n {line.upper()} \n{passage}\n{text(9)}") for i in range(31, 36)]
    docs += [(40, None), (41, ""), (42, " \n\t \n"), (43, "one two"), (44, "One  two"), (45, "x"), (46, "a b c d e"), (47, "\n\n" + line), (48, line + "\n" + line)]
    docs += [(50, text(4000)), (51, ("der " * 300).strip()), (51, ("der " * 300).strip()), (51, "same id, other text here"), (None, base), (None, None), (None, "lonely words of nobody here")]
    docs += [(60, "naïve café 😀 " * 30), (61, " wide space\x1c\x85 'quote's <|endoftext|>!!")]
    r.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def docs():
    return make()


@pytest.fixture(scope="session")
def frame(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", 1, "x", "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(rows, expected) -> None:
    key = lambda t: tuple(map(repr, t))
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
