"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label. Its score for a language is the sum of the
weights of its features (affixes, character n-grams with word borders, the
whole word as a lexicon entry, letters beyond ASCII); learned transitions join
neighbouring labels. Forward-backward gives each word's label probabilities. A
text's language is the one with the largest mean over its words; the first
words count once more with a learned weight, since a text that switches is
mostly known by the language it begins in.

Training sequences are spliced from passages of documents of several languages,
so transitions learn to switch inside a text. The passages come from at most
``SAMPLE`` documents a language, the weight of the beginning from at most about
``TUNE``; prediction covers every word of every text.
Chains are cut into windows only to work on many at once: messages between
windows are passed exactly.

Defined cases: a text that is null or without letters is ``und`` with score 0;
null ids pass through and are not held out; equal means go to the language that
sorts first; without labelled rows all texts are ``und``; repeated rows are
predicted each; an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import importable
from .text import slices, words_of

#: Documents a language gives passages at most, and characters of a passage.
SAMPLE, PASSAGE = 400, 1200
#: Documents a language on which the weight of the beginning is chosen, its words, and the weights tried.
TUNE, LEAD_WORDS, LEADS = 1000, 12, (0.0, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5)
#: Hash buckets of features, spliced sequences and their words, steps of the fit.
BUCKETS, SEQUENCES, LENGTH, STEPS = 1 << 15, 1500, 40, 60
#: Words of a window, and words whose scores a worker remembers.
WINDOW, REMEMBERED = 64, 800_000
UNKNOWN = "und"


def features(word: str) -> list[int]:
    """Buckets of a word's features."""
    found = ["w" + word, "b"]
    found += ["p" + word[:k] for k in (1, 2, 3)] + ["s" + word[-k:] for k in (1, 2, 3, 4)]
    edged = f"^{word}$"
    found += [edged[k : k + 2] for k in range(len(edged) - 1)] + [edged[k : k + 3] for k in range(len(edged) - 2)]
    found += ["c" + c for c in word if c > "\x7f"]
    return [zlib.crc32(f.encode()) % BUCKETS for f in found]


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Scores of each word for each language; a word without letters scores alike for all and is marked by NaN."""
    flat, begins, void = [], [], []
    for k, word in enumerate(words):
        letters = "".join(c for c in word if c.isalpha())
        begins.append(len(flat))
        flat += features(letters) if letters else [0]
        if not letters:
            void.append(k)
    if not words:
        return np.zeros((0, weights.shape[1]))
    out = np.add.reduceat(weights[np.array(flat)], np.array(begins), axis=0).astype(float)
    out[void] = np.nan
    return out


def marginals(scores: np.ndarray, at: np.ndarray, moves: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Label probabilities of each word of chains ``at[r]:at[r+1]``, by forward-backward.

    The label before a chain is uniform; ``moves`` are transition scores.
    """
    n, size = scores.shape
    out = np.zeros((n, size))
    lengths = np.diff(at)
    windows = -(-lengths // window)
    if not windows.sum():
        return out
    step = np.exp(moves - moves.max())
    here = np.exp(scores - scores.max(axis=1, keepdims=True))
    chain = np.repeat(np.arange(len(lengths)), windows)
    first = np.cumsum(windows) - windows
    nth = np.arange(len(chain)) - first[chain]
    begin = at[:-1][chain] + nth * window
    filled = np.minimum(window, at[1:][chain] - begin)
    order = np.argsort(-filled, kind="stable")
    active = np.array([np.searchsorted(-filled[order], -t) for t in range(window)])  # those with more than t words
    begin_o = begin[order]
    before = np.full((len(chain), size), 1 / size)
    after = np.ones((len(chain), size))
    if windows.max() > 1:
        whole = np.broadcast_to(np.eye(size), (len(chain), size, size)).copy()
        for t in range(window):
            k = active[t]
            if not k:
                break
            x = (whole[:k] @ step) * here[begin_o[:k] + t][:, None, :]
            whole[:k] = x / x.sum(axis=(1, 2), keepdims=True)
        transfer = np.empty_like(whole)
        transfer[order] = whole
        many = np.flatnonzero(windows > 1)
        for j in range(1, windows.max()):
            w = first[many[windows[many] > j]] + j
            x = np.einsum("wi,wij->wj", before[w - 1], transfer[w - 1])
            before[w] = x / x.sum(axis=1, keepdims=True)
        for j in range(windows.max() - 2, -1, -1):
            w = first[many[windows[many] > j + 1]] + j
            x = np.einsum("wij,wj->wi", transfer[w + 1], after[w + 1])
            after[w] = x / x.sum(axis=1, keepdims=True)
    forward = np.empty((window, active[0], size))
    x = before[order]
    for t in range(window):
        k = active[t]
        if not k:
            break
        x = (x[:k] @ step) * here[begin_o[:k] + t]
        x /= x.sum(axis=1, keepdims=True)
        forward[t, :k] = x
    back = after[order].copy()
    for t in range(window - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        both = forward[t, :k] * back[:k]
        out[begin_o[:k] + t] = both / both.sum(axis=1, keepdims=True)
        y = (here[begin_o[:k] + t] * back[:k]) @ step.T
        back[:k] = y / y.sum(axis=1, keepdims=True)
    return out


@dataclass
class Field:
    """Languages, feature weights and transition scores."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lead: float = 0.0
    known: dict[int, int] = field(default_factory=dict, repr=False)
    held: list[np.ndarray] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights, "moves": self.moves, "lead": self.lead, "known": {}, "held": []}

    def scores(self, words) -> np.ndarray:
        """Emission scores of all words; each distinct word is scored once a worker."""
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.held = {}, []
        keys = distinct.tolist()
        fresh = [k for k, h in enumerate(keys) if h not in self.known]
        if fresh:
            base = len(self.known)
            self.held.append(emissions([words.spelled(first[k]) for k in fresh], self.weights))
            self.known.update({keys[k]: base + i for i, k in enumerate(fresh)})
        if len(self.held) > 1:
            self.held = [np.concatenate(self.held)]
        return self.held[0][[self.known[h] for h in keys]][inverse] if keys else np.zeros((0, len(self.languages)))

    def means(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean label probabilities of each text, those of its first words, and its number of words with letters."""
        words = words_of(column, keep_digits=False)
        scores = self.scores(words)
        lettered = ~np.isnan(scores[:, 0]) if len(scores) else np.zeros(0, bool)
        chance = marginals(np.nan_to_num(scores), words.at, self.moves) * lettered[:, None]
        total = np.concatenate([np.zeros((1, chance.shape[1])), np.cumsum(chance, axis=0)])
        count = np.concatenate([[0], np.cumsum(lettered)])
        begin, end = words.at[:-1], words.at[1:]
        some = np.minimum(begin + LEAD_WORDS, end)
        mean, first = ((total[x] - total[begin]) / np.maximum(count[x] - count[begin], 1)[:, None] for x in (end, some))
        return mean, first, count[end] - count[begin]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        rows = len(column)
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        mean, first, count = self.means(column)
        mean = (mean + self.lead * first) / (1 + self.lead)
        best = mean.argmax(axis=1)
        named = [self.languages[b] if c else UNKNOWN for b, c in zip(best, count, strict=True)]
        return named, np.where(count > 0, np.clip(mean[np.arange(rows), best], 0, 1), 0.0)


def fit(passages: dict[str, list[list[str]]], steps: int = STEPS, seed: int = 7) -> Field:
    """Maximum likelihood with a quadratic penalty, over spliced sequences; Adam on all of them at once."""
    languages = sorted(k for k, v in passages.items() if any(v))
    size = len(languages)
    if size < 1:
        return Field([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    pools = [[p for p in passages[k] if p] for k in languages]
    sequences, gold = [], []
    for _ in range(SEQUENCES):
        words, labels = [], []
        while len(words) < LENGTH:
            k = int(rng.integers(size))
            source = pools[k][int(rng.integers(len(pools[k])))]
            begin = int(rng.integers(len(source)))
            part = source[begin : begin + int(rng.integers(4, LENGTH))][: LENGTH - len(words)]
            words += part
            labels += [k] * len(part)
        sequences += words
        gold += labels
    vocabulary, spelled = np.unique(sequences, return_inverse=True)
    flat, begins = [], []
    for word in vocabulary:
        begins.append(len(flat))
        flat += features(str(word))
    flat, begins = np.array(flat), np.array(begins)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff([*begins, len(flat)]))
    gold = np.array(gold)
    at = np.arange(0, len(gold) + 1, LENGTH)
    target = np.zeros((len(gold), size))
    target[np.arange(len(gold)), gold] = 1
    inside = np.ones(len(gold), bool)
    inside[at[:-1]] = False
    pairs = np.flatnonzero(inside)
    seen = np.zeros((size, size))
    np.add.at(seen, (gold[pairs - 1], gold[pairs]), 1)
    theta = [np.zeros((BUCKETS, size)), np.zeros((size, size))]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        weights, moves = theta
        scores = np.add.reduceat(weights[flat], begins, axis=0)[spelled]
        chance = marginals(scores, at, moves, LENGTH)
        by_word = np.column_stack([np.bincount(spelled, (target - chance)[:, k], len(vocabulary)) for k in range(size)])
        slope = np.column_stack([np.bincount(flat, by_word[owner, k], BUCKETS) for k in range(size)]) - 0.1 * weights
        turn = seen - _expected_moves(scores, chance, at, moves) - 0.1 * moves
        for k, g in enumerate((slope, turn)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            theta[k] = theta[k] + 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Field(languages, theta[0].astype(np.float32), theta[1])


def _expected_moves(scores: np.ndarray, chance: np.ndarray, at: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected transitions of sequences of one length, from forward messages and the marginals."""
    length, size = int(at[1] - at[0]), scores.shape[1]
    here = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(-1, length, size)
    chance = chance.reshape(-1, length, size)
    step = np.exp(moves - moves.max())
    x = np.full((len(here), size), 1 / size)
    total = np.zeros((size, size))
    for t in range(length):
        if t:
            # P(a, b) = forward(a) step(a, b) / (forward step)(b) * marginal(b)
            ahead = np.maximum(x @ step, 1e-300)
            total += (x.T @ (chance[:, t] / ahead)) * step
        x = (x @ step) * here[:, t]
        x /= x.sum(axis=1, keepdims=True)
    return total


def train(docs: DataFrame, sample: int = SAMPLE, tune: int = TUNE) -> Field:
    """Fit on labelled documents whose crc32 modulo 4 is not 2."""
    importable(docs.sparkSession)
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit({})
    u = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))

    def below(most: int):
        bound = F.lit(0)
        for lang, n in counts.items():
            bound = F.when(F.col("lang") == lang, int(min(1.0, 1.2 * most / n) * (1 << 30))).otherwise(bound)
        return known.withColumn("u", u).where(F.col("u") < bound)

    begin = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1)
    part = F.substring(F.col("text"), (begin + 1).cast("int"), F.lit(PASSAGE)).alias("part")
    passages: dict[str, list[list[str]]] = {}
    taken: dict[str, int] = {}
    for r in sorted(below(sample).select("lang", "u", "doc_id", part).collect(), key=lambda r: (r["u"], r["doc_id"])):
        if taken.get(r["lang"], 0) < sample:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            words = words_of(pa.array([r["part"]]), keep_digits=False)
            spelled = ["".join(c for c in words.spelled(k) if c.isalpha()) for k in range(len(words.hashes))]
            passages.setdefault(r["lang"], []).append([w for w in spelled if w])
    model = fit(passages)
    if model.languages:
        model.lead = _best_lead(model, below(tune))
    return model


def _best_lead(model: Field, docs: DataFrame) -> float:
    """The smallest weight of the beginning that names the most of these documents right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared(model)
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                mean, first, count = own.means(batch.column(1).slice(begin, end - begin))
                lang = np.array(batch.column(0).slice(begin, end - begin).to_pylist())
                right = [np.array(own.languages)[(mean + lead * first).argmax(axis=1)] == lang for lead in LEADS]
                yield pa.RecordBatch.from_arrays([pa.array([int((r & (count > 0)).sum()) for r in right]), pa.array(range(len(LEADS)), pa.int32())], ["right", "lead"])

    right = docs.select("lang", "text").mapInArrow(run, "right long, lead int").groupBy("lead").agg(F.sum("right").alias("n")).collect()
    return LEADS[min((-r["n"], r["lead"]) for r in right)[1]] if right else 0.0


_models: dict[int, Field] = {}


def _shared(model: Field) -> Field:
    """One copy a worker, so that its remembered words serve later tasks."""
    key = hash((model.lead, zlib.crc32(model.weights.tobytes()), zlib.crc32(model.moves.tobytes())))
    if key not in _models:
        _models.clear()
        _models[key] = model
    return _models[key]


def identify(docs: DataFrame, model: Field) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row, from its text alone."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared(model)
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                part = batch.slice(begin, end - begin)
                lang, score = own.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
