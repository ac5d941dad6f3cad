"""Cases beyond the driver's tables: long runs, extreme ids, repeated ids, long conversations, odd patterns."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import chat_format, lang_id, line_dedup, packing, quality, text, url_filter

from .test_operators import brute_lines, documents, good_and_bad


def exact(special_ids):
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    if not special_ids:
        found.encode_special_tokens = True
    return lambda s: found.encode(s, add_special_tokens=False).ids


# --- words ------------------------------------------------------------------


def test_words_over_the_borders_of_pieces(monkeypatch):
    rng = random.Random(4)
    rows = ["".join(rng.choice(("a", "é", " ", "你好", "x9", "-")) for _ in range(rng.randrange(0, 400))) for _ in range(30)] + ["q" * 1000, None, ""]
    whole = text.words_of(pa.array(rows))
    alone = {whole.spelled(k): h for k, h in enumerate(whole.hashes)}
    for word, h in alone.items():
        assert text.words_of(pa.array([word])).hashes.tolist() == [h]
    assert len(set(alone.values())) == len(alone)
    monkeypatch.setattr(text, "_PIECE", 7)
    monkeypatch.setattr(text, "_UP", text._powers(text._BASE))
    monkeypatch.setattr(text, "_DOWN", text._powers(text._UNBASE))
    pieces = text.words_of(pa.array(rows))
    assert np.array_equal(whole.hashes, pieces.hashes) and np.array_equal(whole.at, pieces.at)


def test_letters_among_punctuation_are_words():
    words = text.words_of(pa.array(["々 〆 ⁿ x² a・b «c» d‘e 〜 ½"]))
    assert [words.spelled(k) for k in range(len(words.hashes))] == ["々", "〆", "ⁿ", "x²", "a・b", "c", "d", "e", "½"]
    model = lang_id.Field(["aa"], np.zeros((lang_id.BUCKETS, 1), np.float32), np.zeros((1, 1)))
    assert model.predict(pa.array(["ⁿ", "々", "2²", "", None]))[0] == ["aa", "aa", "und", "und", "und"]


def test_statistics_of_long_texts_are_those_of_whole_texts():
    rng = random.Random(2)
    long = "".join(rng.choice(("Word ", "other, ", "12 ", "\n", "é! ")) for _ in range(300_000))
    together = quality.statistics(pa.array([long, "short one.", None]))
    assert np.allclose(together[0], quality.statistics(pa.array([long]))[0])


# --- packing ----------------------------------------------------------------


@pytest.mark.parametrize("special_ids", [False, True])
def test_ids_are_those_of_the_file(special_ids, monkeypatch):
    rng, want, encode = random.Random(1), exact(special_ids), packing.encoder(*_file(), special_ids)
    assert encode.__name__ == "encode"
    pool = list(" \t\n\r\x0b\x0c\x1c\x85\xa0 　​aAéß你½²٣'\"-.,!\x00\U0001f600́") + ["<|endoftext|>", "'s", "'ll", "<|", "|>", "the ", "     "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    assert [t for t in texts if encode(t) != want(t)] == []
    monkeypatch.setattr(packing, "LONG_BLANK", 3)
    monkeypatch.setattr(packing, "_LONG_BLANK", re.compile(packing._LONG_BLANK.pattern.replace(str(1 << 14), "3")))
    assert [t for t in texts if encode(t) != want(t)] == []


def _file():
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"),)


@pytest.mark.parametrize("blanks", [" \t" * 2_500_000, " " * 5_000_000, "x" + "\n" * 5_000_000 + "y"], ids=["mixed", "blanks", "breaks"])
def test_long_runs_of_blanks(blanks):
    assert packing.encoder(*_file())(blanks) == exact(False)(blanks)


def test_junk_documents_are_packed(spark):
    rows = [(1, " \t" * 1_000_000), (2, "a"), (3, "\n" * 1_500_000 + "end")]
    pieces = packing.pack_documents(documents(spark, rows)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {r["doc_id"]: r["m"] for r in pieces} == {k: len(exact(False)(t)) + 1 for k, t in rows}


# --- line dedup ---------------------------------------------------------------


def test_lines_of_extreme_ids_and_of_several_texts_an_id(spark):
    rows = [(6 * 10**18, "this is a line\nother here x"), (-6 * 10**18, "this is a line\nx"), (-(2**63), "q"), (2**63 - 1, "another line, it is"), (7, "another line, it is")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute_lines(rows)
    rows = [(5, "THIS is a line\nabcdefghijk\nabcdefghijk"), (5, "abcdefghijk\nthis is a line"), (2, "abcdefghijk"), (9, "this is a line"), (9, "this is a line")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect())
    assert got == [(2, "abcdefghijk"), (5, "THIS is a line"), (5, "this is a line"), (9, ""), (9, "")]


def test_many_lines_go_in_proportion(spark):
    lines = [f"line number {k} of a text" for k in range(60_000)]
    docs = documents(spark, [(1, "\n".join(lines)), (2, "\n".join(lines[1:] + ["its own, at the end"]))])
    line_dedup.dedup_lines(documents(spark, [(1, "x")])).count()
    began = time.time()
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (0, "\n".join(lines)) and got[2] == (59_999, "its own, at the end")
    assert time.time() - began < 60


def test_batches_hold_alike_numbers_of_rows(spark):
    docs = spark.range(4000).select(F.when(F.col("id") < 3990, F.col("id")).otherwise(F.col("id") * 10**15).alias("doc_id"))
    sizes = [r["count"] for r in docs.groupBy(line_dedup.ranges(docs, 4)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1100
    assert line_dedup.ranges(docs.limit(0), 4) is not None


# --- chat -------------------------------------------------------------------


def test_long_conversations_and_rows_without_id(spark):
    n = 16_000
    role = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant")
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("text \U0001f600 of turn "), F.col("id").cast("string")).alias("text"))
    lost = spark.range(500).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    began = time.time()
    got = chat_format.read_chats(chat_format.format_chats(turns.union(lost))).collect()
    assert time.time() - began < 60
    one = [r for r in got if r["conv_id"] == 1]
    assert len(got) == 501 and [t["text"] for t in one[0]["turns"]] == [f"text \U0001f600 of turn {k}" for k in range(n)]
    assert list(one[0]["loss_texts"]) == [f"text \U0001f600 of turn {k}" for k in range(n) if k % 3]
    assert all(r["formatted"] == "<s>[ROLE]user[/ROLE]same</s>" for r in got if r["conv_id"] is None)


# --- url lists --------------------------------------------------------------


def test_patterns_are_compared_in_one_form(spark, monkeypatch):
    log = [("Example.org", "block", "2024-01-01", True), (" example.ORG.", "block", "2024-02-01", False), ("[2001:DB8::1]", "block", "2024-01-01", True), (" ", "block", "2024-01-01", True), ("News.com./en", "block", "2024-01-01", True)]
    entries = spark.createDataFrame(log, "pattern string, list string, day string, active boolean").withColumn("day", F.col("day").cast("date"))
    asked = [("http://example.org/", "2024-01-15", "block"), ("http://EXAMPLE.org./", "2024-03-01", "unlisted"), ("http://[2001:db8::1]:80/x", "2024-03-01", "block"), ("http://[2001:db8::2]/x", "2024-03-01", "unlisted"), ("http://news.com/en/1", "2024-03-01", "block")]
    captures = spark.createDataFrame(asked, "url string, day string, want string").withColumn("fetched_on", F.col("day").cast("date"))
    for most in (url_filter.MAX_BROADCAST, 0):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST", most)
        got = url_filter.evaluate(captures, entries).collect()
        assert len(got) == 5 and [r for r in got if r["verdict"] != r["want"]] == []
    assert {r["host"] for r in got} >= {"[2001:db8::1]", "[2001:db8::2]"}


# --- quality ----------------------------------------------------------------


def test_null_ids_are_not_held_out_and_hot_ids_are_fitted_once(spark, tmp_path):
    rows, labels = good_and_bad(random.Random(7))
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in [*rows, (None, "a text")]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.createDataFrame([(k, q, 0) for k, q in labels], "doc_id long, quality int, toxic int")
    table.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.query(spark, str(tmp_path)).collect()}
    assert got[None]["held_out"] is False and all(r["held_out"] is not None for r in got.values())
    hot = docs.union(docs.where("doc_id = 1").crossJoin(spark.range(300)).drop("id"))
    one, two = quality.train(docs, table), quality.train(hot, table)
    assert np.array_equal(one.means, two.means) and np.array_equal(one.factors, two.factors)
    low = one.factors[0]
    d = np.random.default_rng(1).normal(size=(5, len(low)))
    assert np.allclose(quality.solved(low, d) @ low.T, d)
