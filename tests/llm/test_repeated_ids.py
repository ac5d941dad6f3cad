"""Joins over tables with repeated ids of different content: nothing is lost."""

import random
from collections import defaultdict

import numpy as np
import pytest

from kinweave.llm import near_vectors, ngram_join

from .test_operators import documents, grams, words


def brute(rows, linked):
    """``rows``: ``(id, content)``. Distinct rows with links among all of them; ids fold their rows."""
    rows = list(dict.fromkeys(r for r in rows if r[0] is not None))
    near = [(a, b) for a in rows for b in rows if a != b and linked(a[1], b[1])]
    links, root = defaultdict(int), {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    contents = defaultdict(set)
    for k, c in rows:
        contents[c].add(k)
    for a, b in near:
        links[a[0]] += 1
        x, y = sorted((find(a[0]), find(b[0])))
        root[y] = x
    return {k: (find(k), links[k]) for k, _ in rows}


def similar(a, b):
    a, b = grams(a), grams(b)
    return a == b if not a or not b else len(a & b) >= 0.8 * len(a | b) - 1e-9


def near_rows(rng, n):
    bases = [words(rng, 60).split() for _ in range(12)]
    rows = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        rows.append((rng.randrange(n // 2), " ".join(w)))
    return rows + rows[:5]


TABLES = [[(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "q r s t u v")], [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v")], near_rows(random.Random(3), 60)]


@pytest.mark.parametrize("rows", TABLES, ids=["linked by an id", "one unique", "random"])
def test_documents_of_one_id(spark, rows):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join_documents(documents(spark, rows)).collect()}
    assert got == brute(rows, similar)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one_of_each(documents(spark, rows)).collect()]
    classes = brute([((k, t), t) for k, t in rows], similar)
    left = {r for r in rows if classes[r][0][0] == r[0]}
    assert set(kept) <= left and {classes[r][0] for r in kept} == {c for c, _ in classes.values()}
    assert len({classes[r][0] for r in kept}) == len(set(kept)) and len(kept) == sum(r in set(kept) for r in rows)


def test_vectors_of_one_id(spark):
    x = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, x), (2, x), (2, [None] * 3), (3, x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1)}
    rng = np.random.default_rng(2)
    base = rng.normal(size=(15, 24))
    rows = []
    for k in range(80):
        v = base[rng.integers(15)] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12])
        rows.append((int(rng.integers(50)), tuple(float(c) for c in v)))
    rows += rows[:6]

    def near(a, b):
        a, b = np.array(a), np.array(b)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    df = spark.createDataFrame([(k, list(v)) for k, v in rows], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in near_vectors.near_vectors(df).collect()}
    want = {k: v for k, v in brute(rows, near).items() if v[1]}
    assert got == want
