import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import chat_format, decontaminate, html_text, lang_id, line_dedup, near_vectors, ngram_join, packing, quality, url_filter
from kinweave.llm.links import components, dealt
from kinweave.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, gone string, sig string, _part long"


def lettered(rng, n):
    """Words of letters, as clean text has."""
    parts = ["an", "the", "in", "er", "ou", "re", "on", "th", "ea", "st", "ing", "le"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def documents(spark, rows):
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", "y", 1) for k, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- components and blocks --------------------------------------------------


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(5, 3), (3, 9), (7, 8), (8, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)]])
def test_components(spark, pairs):
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert got == {x: find(x) for p in pairs for x in p}


def test_block_pairs_meet_once(spark):
    df = spark.range(40).select(F.lit(1).alias("key"), F.col("id"), F.lit(4).alias("n"))
    tasks = defaultdict(list)
    for r in dealt(df, "key", "id", F.col("n")).collect():
        tasks[r["bi"], r["bj"]].append((r["id"], r["own"]))
    met = defaultdict(int)
    for (a, b), rows in tasks.items():
        for x, p in rows:
            for y, q in rows:
                if x < y and (a == b or p != q):
                    met[x, y] += 1
    assert len(met) == 40 * 39 // 2 and set(met.values()) == {1}


# --- line dedup -------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate({c: c + 32 for c in range(65, 91)})
    first, held = {}, defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and k is not None:
                first[key(line)] = min(first.get(key(line), k), k)
                held[key(line)].add(k)
    out = {}
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (k is not None and len(held.get(key(x), ())) > 1 and first[key(x)] != k)]
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line number {k} of the pool" for k in range(12)] + ["short", "", "  ÉA padded LINE here \t", "éa padded line here", "ÉA PADDED line here"]
    rows = [(k, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(0, 9)))) for k in rng.sample(range(1000), 60)]
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "x" * 200_000 + "\nline number 3 of the pool"), (None, "line number 3 of the pool")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_runs_batch_by_batch(spark):
    index = line_dedup.LineRuns(spark, fanout=2)
    schema = "h1 long, h2 long, doc_id long"
    seen = {}
    for batch in range(7):
        rows = [((batch * 3 + k) % 11, 1, batch * 100 + k) for k in range(6)]
        got = {tuple(r) for r in index.add(spark.createDataFrame(rows, schema)).collect()}
        want = set()
        for h1, h2, doc in sorted(rows, key=lambda r: r[2]):
            if seen.setdefault(h1, doc) != doc:
                want.add((h1, h2, doc))
        assert got == want
    assert sum(len(level) for level in index.levels) <= 2 * len(index.levels) and len(index.levels) >= 2
    keys = [r["h1"] for run in index.runs() for r in run.collect()]
    assert sorted(keys) == sorted(set(keys)) and len(keys) == 11


# --- n-gram join ------------------------------------------------------------


def grams(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_classes(rows, threshold=0.8):
    sets = {k: grams(t) for k, t in rows}
    links, root = defaultdict(int), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a != b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (find(k), links[k]) for k in ids}


def near_documents(rng, copies=25):
    rows, k = [], 0
    for _ in range(14):
        base = words(rng, rng.randrange(30, 200)).split()
        for _ in range(rng.choice((1, 2, 5, copies))):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
            k += 1
            rows.append((k, rng.choice((" ", "  ", ", ")).join(w)))
    return rows


def test_ngram_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = near_documents(rng) + [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, two!"), (905, "two one"), (906, words(rng, 30_000))]
    rows += [(907, rows[0][1]), (908, rows[0][1].upper())]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join_documents(documents(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_ngram_join_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 700)
    rows = near_documents(random.Random(8), copies=40)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join_documents(documents(spark, rows)).collect()}
    assert got == brute_classes(rows)
    kept = {r["doc_id"] for r in ngram_join.keep_one_of_each(documents(spark, rows)).collect()}
    assert kept == {c for c, _ in brute_classes(rows).values()}


def test_ngram_join_of_nothing_and_of_repeated_ids(spark):
    assert ngram_join.join_documents(documents(spark, [])).count() == 0
    text = words(random.Random(1), 50)
    rows = [(1, text), (1, text), (2, text + " end"), (None, text)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join_documents(documents(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), None: (None, 0)}
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_one_of_each(documents(spark, rows)).collect()) == ["1", "1", "None"]


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert (1 - 0.8**rows) ** bands <= 1e-4 and bands * rows <= 160 and rows >= 4
    a, b = ngram_join._coefficients(bands * rows)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    other = np.concatenate([base[:520], rng.integers(0, 1 << 63, 70, dtype=np.uint64)])
    same = (ngram_join.minima_of(base, a, b) == ngram_join.minima_of(other, a, b)).mean()
    assert abs(same - 520 / 670) < 0.15


# --- decontamination --------------------------------------------------------


def test_overlaps_with_substitutions(spark):
    rng = random.Random(5)
    items = [(k, words(rng, n)) for k, n in enumerate((15, 30, 60, 9))]
    rows, want = [], set()
    for k, (item, text) in enumerate(items[:3]):
        w = text.split()
        rows.append((10 + k, words(rng, 20, 10**6) + " " + text.upper() + ". " + words(rng, 20, 10**6)))
        w[len(w) // 2] = "changed"
        rows.append((20 + k, words(rng, 20, 10**6) + ", " + " ".join(w) + " " + words(rng, 20, 10**6)))
        want |= {(10 + k, item), (20 + k, item)}
    rows += [(30, items[3][1]), (31, None), (32, ""), (33, words(rng, 200, 10**6)), (34, " ".join(items[2][1].split()[20:45])), (35, "--" + items[0][1])]
    want |= {(34, 2), (35, 0)}
    bench = spark.createDataFrame([(k, t, 1) for k, t in items] + [(7, None, 1), (8, "", 1)], "item_id long, text string, seed int")
    got = decontaminate.overlaps(documents(spark, rows + rows[:1]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_equal"] >= 0.8 * r["n_tokens"] and r["n_tokens"] >= 13 for r in got)
    assert {r["doc_id"]: r["doc_at"] for r in got}[35] == 0
    clean = decontaminate.decontaminate(documents(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {30, 31, 32, 33} and clean.columns == documents(spark, []).columns
    assert decontaminate.overlaps(documents(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.overlaps(documents(spark, []), bench).count() == 0


def test_overlaps_are_the_same_without_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    bench = spark.createDataFrame([(k, words(rng, 40)) for k in range(5)], "item_id long, text string")
    rows = [(k, words(rng, 10) + " " + r["text"]) for k, r in enumerate(bench.collect())]
    broadcast = sorted(map(tuple, decontaminate.overlaps(documents(spark, rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert broadcast and sorted(map(tuple, decontaminate.overlaps(documents(spark, rows), bench).collect())) == broadcast


def test_passages_from_inside_an_item(spark):
    """Every overlap of 13 tokens with four fifths equal counts, wherever it lies in two longer texts."""
    rng = random.Random(11)
    items = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(12)]
    rows, want = [], {}
    for k, item in enumerate(items):
        at = 8 + k
        for n, changed in ((13, ()), (14, ()), (15, ()), (16, (8,)), (18, (4, 9, 14)), (20, (2, 7, 12, 17))):
            part = item[at : at + n]
            for c in changed:
                part[c] = f"c{rng.randrange(10**6)}"
            key = len(rows)
            rows.append((key, " ".join([words(rng, 30, 10**7), *part, words(rng, 30, 10**7)])))
            want[key] = (k, n, n - len(changed), 30, at)
        rows.append((len(rows), " ".join([words(rng, 30, 10**7), *item[at : at + 10], words(rng, 30, 10**7)])))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.overlaps(documents(spark, rows), bench).collect()}
    missed = [key for key in want if key not in got]
    assert not [key for key in missed if want[key][1] - want[key][2] < 3], missed
    assert len(missed) <= 2 and set(got) <= set(want)
    for key, r in got.items():
        item, n, equal, doc_at, item_at = want[key]
        assert r["item_id"] == item and r["n_tokens"] >= 13 and r["n_equal"] >= 0.8 * r["n_tokens"]
        assert r["n_equal"] <= equal and r["doc_at"] - r["item_at"] == doc_at - item_at
        if n <= 15:
            assert r["n_equal"] == n and r["doc_at"] <= doc_at and r["item_at"] <= item_at


# --- packing ----------------------------------------------------------------


def check_packing(rows, pieces, exact, top=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, text in rows:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[k], key=lambda r: r["start"])
        assert b"".join(r["tokens"] for r in parts) == ids.tobytes()
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert all(r["doc_tokens"] == len(ids) and r["length"] > 0 for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        size = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert size <= top and size & (size - 1) == 0 and all(r["sequence_tokens"] == size for r in parts)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    rng = random.Random(3)
    odd = ["", None, "a", "  \n\t x", "It's we'LL <|endoftext|> ½²٣ \U0001f600", "é" * 3000, "naïve\r\n\r\nname", words(rng, 9000)]
    rows = list(enumerate(odd + [words(rng, rng.randrange(0, 900)) for _ in range(80)]))
    pieces = packing.pack_documents(documents(spark, rows).repartition(3), horizon=5000, group=4).collect()
    check_packing(rows, pieces, exact)
    assert packing.pack_documents(documents(spark, [])).count() == 0
    digest = packing.with_digest(packing.pack_documents(documents(spark, rows[:3]))).collect()
    assert {r["ids_crc32"] for r in digest} <= {zlib.crc32(p.tobytes()) for p in (np.array([0], "<u4"), np.array([64, 0], "<u4"))}


def test_step_groups_are_balanced():
    rng = random.Random(1)
    pool = packing.Pool()
    for k in range(800):
        pool.put((k, 0, np.zeros(rng.choice((rng.randrange(1, 1024), rng.randrange(1, 200))), "<u4"), 0))
    windows = packing.pack(pool, packing.TIERS)
    assert pool.tokens < 1024 and all(sum(len(p[2]) for p in w) in packing.TIERS for w in windows)
    steps = packing.balanced(windows, 32)
    tokens, cost = defaultdict(int), defaultdict(int)
    for w, s in zip(windows, steps, strict=True):
        tokens[s] += sum(len(p[2]) for p in w)
        cost[s] += sum(len(p[2]) ** 2 for p in w)
    assert max(tokens.values()) <= 1.1 * min(tokens.values()) and max(cost.values()) <= 1.2 * min(cost.values())


# --- quality ----------------------------------------------------------------


def good_and_bad(rng, n=120):
    rows, labels = [], []
    for k in range(n):
        text = ". ".join(lettered(rng, 12) for _ in range(rng.randrange(2, 12)))
        if k % 4 == 0:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "$$$" for w in text.split()), " ".join([text.split()[0]] * 60)])
        rows.append((k, text))
        labels.append((k, int(k % 4 != 0)))
    return rows, labels


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = good_and_bad(rng)
    table = spark.createDataFrame(labels + [(5000, 1), (1, None), (None, 0), (2, 7)], "doc_id long, quality int")
    docs = documents(spark, rows + [(700, None), (701, ""), (None, rows[1][1]), (702, words(rng, 20_000)), rows[1]])
    model = quality.train(docs, table)
    got = [(r["doc_id"], r["score"]) for r in quality.score_documents(docs, model).collect()]
    assert len(got) == len(rows) + 5 and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    truth = dict(labels)
    assert np.mean([(score[k] >= quality.CUT) == truth[k] for k in truth]) > 0.97
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, s in got if s >= quality.CUT}
    assert quality.score_documents(documents(spark, []), model).count() == 0
    again = quality.train(docs.repartition(7), table)
    assert np.array_equal(model.factors, again.factors)


def test_quality_learns_nothing_from_held_out_rows_or_single_classes(spark):
    rows, labels = good_and_bad(random.Random(7))
    docs = documents(spark, rows)
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    one = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    flipped = [(k, 1 - q if k in held else q) for k, q in labels]
    two = quality.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert np.array_equal(one.means, two.means) and one.share == two.share
    only = quality.train(docs, spark.createDataFrame([(k, 1) for k, _ in rows], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_documents(docs, only).collect()} == {1.0}
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}


def test_discriminant_is_the_normal_log_ratio():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (500, 3))])
    y = np.repeat([0, 1], [300, 500])
    m = quality.fit(x, y, 0.6, pooled=0.0, diagonal=0.0)
    logs = []
    for k in (0, 1):
        s = np.cov(x[y == k].T, bias=True) + 1e-4 * np.eye(3)
        d = x - x[y == k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.log(np.linalg.det(s)))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1] - np.log(0.6 / 0.4))))


# --- language ---------------------------------------------------------------


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    lengths = [0, 1, 5, 7, 3]
    at = np.concatenate([[0], np.cumsum(lengths)])
    scores, moves = rng.normal(size=(at[-1], 3)), rng.normal(size=(3, 3))
    for window in (2, 3, 64):
        got = lang_id.marginals(scores, at, moves, window)
        for r, n in enumerate(lengths):
            want = np.zeros((n, 3))
            for y in itertools.product(range(3), repeat=n):
                if n:
                    first = np.log(np.exp(moves).mean(axis=0))[y[0]]
                    w = np.exp(first + sum(scores[at[r] + t, y[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
                    want[np.arange(n), y] += w
            if n:
                assert np.allclose(got[at[r] : at[r + 1]], want / want.sum(axis=1, keepdims=True))


def test_language_of_texts(spark):
    rng = random.Random(1)
    vocabulary = {"aa": ["thing", "house", "the", "with", "thorn"], "bb": ["ñando", "casaó", "que", "paraí", "lla"]}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(k, text("aa" if k % 2 else "bb", rng.randrange(3, 80)), "aa" if k % 2 else "bb") for k in range(200)]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 .. €€ \U0001f600", "bb"), (503, text("aa", 40) + " " + text("bb", 10), None), (None, text("bb", 9), None), (504, text("bb", 30_000), None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = lang_id.train(docs)
    assert model.languages == ["aa", "bb"] and model.moves[0, 0] > model.moves[0, 1]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_id.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got.values())
    assert np.mean([got[k][0] == lang for k, _, lang in rows[:200]]) > 0.99
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] == "aa" and got[None][0] == "bb" and got[504][0] == "bb"
    assert lang_id.identify(docs.limit(0), model).count() == 0
    empty = lang_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in lang_id.identify(docs, empty).collect()} == {"und"}


def test_language_ignores_held_out_labels(spark):
    rows = [(k, f"wort{k % 7} ist gut" if k % 2 else f"word{k % 5} is good", "de" if k % 2 else "en") for k in range(60)]
    flip = lambda k, lang: {"de": "en", "en": "de"}[lang] if zlib.crc32(str(k).encode()) % 4 == 2 else lang
    schema = "doc_id long, text string, lang string"
    one = lang_id.train(spark.createDataFrame(rows, schema))
    two = lang_id.train(spark.createDataFrame([(k, t, flip(k, x)) for k, t, x in rows], schema))
    assert np.array_equal(one.weights, two.weights) and one.lead == two.lead


# --- chat -------------------------------------------------------------------


def test_chats_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "[\\INST]\\[INST] <", "[NEXT]", "a\nb", "", None, "<s>[ROLE]user[/ROLE]", "ends with [", "\\", "é\U0001f600", "[/ROLE", "$1 \\1", "<\\/s>", "[[INST]]"]
    rng = random.Random(2)
    turns = []
    for conv in range(12):
        for t in range(rng.randrange(1, 9)):
            turns.append((conv, t, rng.choice(["user", "assistant", "assistant", "system", None, "[/ROLE]"]), rng.choice(tricky)))
    turns += [(None, 0, "user", "no id"), (50, 1, "user", "tie b"), (50, 1, "user", "tie a"), (50, 1, "user", "tie a"), (50, None, "assistant", "null turn"), (51, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, loss string")
    chats = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in chat_format.read_chats(chats).collect()}
    assert len(got) == len({t[0] for t in turns})
    for conv, r in got.items():
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        want = [(t[2] or "", t[3] or "") for t in own]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert list(r["loss_texts"]) == [t for role, t in want if role == "assistant"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert r["formatted"].count("<s>") == blocks == r["formatted"].count("</s>")
    assert chat_format.format_chats(df.limit(0)).count() == 0
    probe = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(chat_format.with_probe(df))).collect()}[-7]
    assert [t["text"] for t in probe["turns"]] == ["</s>[INST] ok [/INST]"] * 2 and len(probe["turns"]) == 2
    assert "x</s>" not in probe["formatted"] and probe["formatted"].count("</s>") == 2


# --- html -------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One,   two.<p>Th<b>re</b>e<br>four</article><footer>f</footer>", "A & B\nOne, two.\nThree four"),
    ("<body><div class='sidebar'>Side, text.</div><div id=main-content><p>Long enough text, with stops. And more.</p><ul><li>first</li><li>second</li></ul></div><div class='comments'>Nice one!</div>", "Long enough text, with stops. And more.\nfirst\nsecond"),
    ("<article><p>x < y & z &lt;b&gt; &#233; &nbsp; end</p><aside>no</aside><form>mail <input></form><script>if (a < b) '</p>'</script><!-- <p>no</p> --><div class=\"cookie-notice\">no</div></article>", "x < y & z <b> é end"),
    ("<main><p>cut off in the mid", "cut off in the mid"),
    ("<article><header><h1>Head</h1></header><section><p>Body.</p></section><div class='ad'>Buy!</div><table><tr><td>a<td>b</table></article>", "Head\nBody.\na\nb"),
    ("plain text only", "plain text only"),
    ("", ""),
    (None, ""),
    ("<script>x", ""),
    ("<p title='a > b'>quoted</p>", "quoted"),
    ("<p>stray </div> end</p></article>", "stray\nend"),
    ("<article>" + "<p>many words, here.</p>" * 3000 + "</article>", "\n".join(["many words, here."] * 3000)),
]


@pytest.mark.parametrize(("page", "want"), PAGES, ids=range(len(PAGES)))
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "attribute",
    [
        'style="overflow:hidden"', 'title="The hidden city"', 'data-role="banner"', 'data-id="nav"', "data-class=footer", "title='class=nav id=menu hidden'",
        'id="related-work"', 'class="related-work"', "hidden-at=never", 'aria-hidden="false"', "data-x=hidden", 'title=a/hidden',
    ],
)
def test_other_attributes_hide_nothing(attribute):
    page = f"<article><p>Before, it.</p><section {attribute}><h2 id=social-history>Head</h2><p>Kept, all.</p></section></article>"
    assert html_text.main_text(page) == "Before, it.\nHead\nKept, all."


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", "title='x'hidden", "aria-hidden=true", "role='navigation'", "class='x share-buttons'", "class=ad", "/class=nav"])
def test_own_attributes_hide(attribute):
    assert html_text.main_text(f"<article><p>Before, it.</p><section {attribute}><p>Gone, all.</p></section></article>") == "Before, it."


def test_extract(spark):
    df = spark.createDataFrame([(k, "u", p, "x") for k, (p, _) in enumerate(PAGES)] + [(None, None, None, "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {k: t for k, (_, t) in enumerate(PAGES)} | {None: ""}
    assert html_text.extract(df.limit(0)).count() == 0


# --- vectors ----------------------------------------------------------------


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))
    for k in range(0, 120):
        x[k] = x[120 + k % 4] + rng.normal(size=32) * 0.05 * (1 + k % 7)
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x * rng.uniform(0.1, 9, (300, 1)))]
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [float("inf")] * 32), (905, [None] + [1.0] * 31), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[0][1]), rows[0]]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows + odd], "vec_id long, embedding array<double>, cap int, unit int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    found = np.array([got.get(k, (0, 0))[0] for k in range(300)])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum() and want.sum() > 500
    assert got[906] == (1, 906) and got[907] == (1, 906)
    assert not set(got) & {900, 901, 902, 903, 904, 905, None}
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_list_decoding_finds_every_exceeding_filter():
    rng = np.random.default_rng(0)
    caps = near_vectors.plan_caps(24, 2000)[3]
    x = rng.normal(size=(40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, codes = near_vectors.decode(caps, x)
    turned, parts = x @ caps.basis, np.array_split(np.arange(24), len(caps.books))
    total = np.zeros((40, 1))
    for p, book in zip(parts, caps.books, strict=True):
        total = (total[:, :, None] + (turned[:, p] @ book.T)[:, None, :]).reshape(40, -1)
    want = {(int(r), int(c)) for r, c in zip(*np.nonzero(total >= caps.least), strict=True)}
    assert {(int(r), int(c)) for r, c in zip(rows, codes, strict=True)} == want


@pytest.mark.parametrize(("dim", "rows"), [(64, 10_000), (64, 1_000_000), (16, 5000), (3, 400)])
def test_pairs_at_the_threshold_share_a_filter(dim, rows):
    rng = np.random.default_rng(dim)
    x, y = rng.normal(size=(2, 1500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    z = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    codes = near_vectors.plan_caps(dim, rows)
    held = [set(), set()]
    for k, v in enumerate((x, z)):
        held[k] = set(zip(*(a.tolist() for a in near_vectors.decode_all(codes, v)), strict=True))
    assert len({r for r, _ in held[0] & held[1]}) >= 0.97 * len(x)
    assert len(held[0]) <= 80 * len(x)


# --- url lists --------------------------------------------------------------


def test_temporal_list_join(spark):
    log = [
        ("bad.org", "block", "2024-01-10", True), ("bad.org", "block", "2024-02-01", False), ("bad.org", "block", "2024-03-01", True),
        ("good.bad.org", "allow", "2024-01-15", True), ("news.com/en", "block", "2024-01-01", True), ("same.org", "block", "2024-01-01", True),
        ("same.org", "allow", "2024-01-05", True), ("twice.org", "block", "2024-01-01", True), ("twice.org", "block", "2024-01-01", False), (None, "block", "2024-01-01", True),
    ]
    entries = spark.createDataFrame(log, "pattern string, list string, day string, active boolean").withColumn("day", F.col("day").cast("date"))
    asked = [
        ("http://bad.org/x", "2024-01-09", "unlisted"), ("http://bad.org/x", "2024-01-10", "block"), ("https://A.bad.org:80/", "2024-01-31", "block"),
        ("http://bad.org", "2024-02-01", "unlisted"), ("http://u@bad.org/", "2025-01-01", "block"), ("http://good.bad.org/", "2024-03-05", "allow"),
        ("http://x.good.bad.org/", "2024-01-14", "block"), ("http://news.com/en/1", "2024-05-01", "block"), ("http://news.com/de/1", "2024-05-01", "unlisted"),
        ("http://notbad.org", "2024-05-01", "unlisted"), ("http://same.org", "2024-01-04", "block"), ("http://same.org", "2024-01-06", "allow"),
        ("http://twice.org", "2024-05-01", "unlisted"), (None, "2024-05-01", "malformed"), ("no url", "2024-05-01", "malformed"), ("", None, "malformed"), ("http://bad.org", None, "unlisted"),
    ]
    schema = "url string, day string, want string, pattern string"
    captures = spark.createDataFrame([(u, d, w, "clash") for u, d, w in asked] * 2, schema).withColumn("fetched_on", F.col("day").cast("date"))
    got = url_filter.evaluate(captures, entries).collect()
    assert len(got) == 2 * len(asked) and all(r["verdict"] == r["want"] for r in got)
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0
    assert {r["verdict"] for r in url_filter.evaluate(captures, entries.limit(0)).collect()} == {"unlisted", "malformed"}


def test_top_level_domains(spark):
    entries = spark.sql("select 'org' as pattern, 'block' as list, date'2024-01-01' as day, true as active union all select 'a.org', 'allow', date'2024-01-01', true")
    urls = [("http://example.org/x", "block"), ("http://x.y.org", "block"), ("http://org/", "block"), ("http://b.a.org", "allow"), ("http://example.com", "unlisted")]
    captures = spark.createDataFrame(urls, "url string, want string").withColumn("fetched_on", F.lit("2024-02-01").cast("date"))
    assert [r for r in url_filter.evaluate(captures, entries).collect() if r["verdict"] != r["want"]] == []


# --- pipeline ---------------------------------------------------------------


def write_tables(spark, path, rows, labels, items):
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    good, labels = good_and_bad(rng, 80)
    item = lettered(rng, 30)
    base = lettered(rng, 120)
    near = base.split()
    near[7] = "other"
    rows = good + [(200, base), (201, " ".join(near)), (202, base), (203, "shared line of the corpus\n" + lettered(rng, 90)), (204, "Shared line of the corpus \n" + lettered(rng, 90)), (205, lettered(rng, 40) + " " + item), (206, None), (207, "")]
    write_tables(spark, tmp_path, rows, [(k, q, 0) for k, q in labels], [(1, item)])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = model.score(quality.statistics(pa.array([t for _, t in rows], pa.string())))
    left = [r for r, s in zip(rows, scores, strict=True) if s >= quality.CUT]
    lines = brute_lines(left)
    left = [(k, lines[k][2]) for k, _ in left]
    classes = brute_classes(left)
    left = [(k, t) for k, t in left if classes[k][0] == k]
    bad = {k for k, t in left if item in t}
    want = dict(r for r in left if r[0] not in bad)
    assert bad == {205} and 200 in want and not {201, 206, 207} & set(want) and want[202] == ""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert {r["doc_id"]: r["text"] or "" for r in docs.collect()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(list(want.items()), pieces, exact)
    assert {r["doc_id"] for r in pieces} == set(want)


def test_pipeline_over_nothing(spark, tmp_path):
    write_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_digest_of_chats_matches_plain_python(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = chat_format.query(spark, str(tmp_path)).where("conv_id = 1").first()
    assert row["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nyo\nassistant\n\n").hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (3, 2, hashlib.sha256(b"yo").hexdigest())
