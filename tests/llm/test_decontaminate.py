"""Spaced seeds: recall over all placements, whole overlaps, and the shuffled path."""

import itertools
import random

from kinweave.llm import decontaminate

from .test_operators import documents, words

SPAN, MASKS = decontaminate.SPAN, decontaminate.MASKS


def recall(n, changed):
    """Share of the placements of substitutions in an overlap of ``n`` tokens that leave a window hit by a mask."""
    places = list(itertools.combinations(range(n), changed))
    hit = [any(not set(c) & {p + o for o in m} for p in range(n - SPAN + 1) for m in MASKS) for c in places]
    return sum(hit) / len(hit)


def test_masks_find_substitutions_wherever_they_lie():
    assert recall(13, 2) == recall(14, 2) == 1.0
    assert recall(15, 3) > 0.99 and recall(16, 3) > 0.99 and recall(20, 4) > 0.99


def test_every_placement_of_two_substitutions_in_thirteen_tokens(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for k, changed in enumerate(itertools.combinations(range(13), 2)):
        part = item[20:33]
        for c in changed:
            part[c] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join([words(rng, 15, 10**7), *part, words(rng, 15, 10**7)])))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"] for r in decontaminate.overlaps(documents(spark, rows), bench).collect()}
    assert got == set(range(len(rows)))


def shuffled(spark):
    g = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_large_benchmarks_and_long_texts(spark, monkeypatch, tmp_path):
    rng = random.Random(1)
    items = [words(rng, 40, 10**6) for _ in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)) + [(100, items[3])], "item_id long, text string")
    rows = [(k, " ".join([words(rng, 10_000, 10**7), items[k], words(rng, 10_000, 10**7)])) for k in range(6)] + [(None, items[9]), (3, items[10]), (3, items[10])]
    documents(spark, rows).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    small = sorted(map(str, decontaminate.overlaps(docs, bench).collect()))
    assert len(small) == 9 and all("n_equal=40, n_tokens=40" in r for r in small)
    kept = decontaminate.decontaminate(docs, bench).count()
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    before = shuffled(spark)
    assert sorted(map(str, decontaminate.overlaps(docs, bench).collect())) == small
    assert shuffled(spark) - before < 4 * sum(len(t) for _, t in rows)
    monkeypatch.setattr(decontaminate, "PART", 3000)
    assert sorted(map(str, decontaminate.overlaps(docs, bench).collect())) == small
    assert decontaminate.decontaminate(docs, bench).count() == kept == 1
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_overlaps_are_followed_as_far_as_they_hold(spark):
    rng = random.Random(8)
    item = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    part = item[50:250]
    for c in range(7, 200, 9):
        part[c] = f"c{c}"
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    text = " ".join([words(rng, 30, 10**7), *part, words(rng, 30, 10**7)])
    (row,) = decontaminate.overlaps(documents(spark, [(4, text)]), bench).collect()
    assert (row["n_tokens"], row["n_equal"], row["doc_at"], row["item_at"]) == (200, 200 - len(range(7, 200, 9)), 30, 50)
