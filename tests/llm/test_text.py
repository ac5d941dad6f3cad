import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm.text import buffers, gram_hashes, slices, words_of


def spelled(text):
    w = words_of(pa.array([text]))
    return [w.spelled(k) for k in range(len(w.hashes))]


def test_words_are_letters_digits_and_underscores():
    for text in ("Hello, World_1!", "Éa çouelle ÑANDÚ größe", "a—b × «、c» 12.5", "", "...", "x", "…"):
        assert spelled(text) == re.findall(r"[^\W]+", text.lower())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abÉñ .,\n9_-ß—", max_size=30)), max_size=6))
def test_rows_never_share_words(texts):
    column = pa.array(texts, pa.string())
    words = words_of(column)
    for r, text in enumerate(texts):
        have = [words.spelled(k) for k in range(words.at[r], words.at[r + 1])]
        assert have == re.findall(r"\w+", (text or "").lower())
        alone = words_of(pa.array([text], pa.string()))
        assert np.array_equal(alone.hashes, words.hashes[words.at[r] : words.at[r + 1]])


def test_hashes_tell_words_apart():
    words = [f"w{k}" for k in range(20_000)] + ["a" * k for k in range(1, 200)]
    assert len(np.unique(words_of(pa.array([" ".join(words)])).hashes)) == len(words)


def test_grams():
    w = words_of(pa.array(["a b c d e f", "a b c", "", "b c d e f", None]))
    grams, at = gram_hashes(w, 5)
    assert list(np.diff(at)) == [2, 1, 0, 1, 0]
    assert grams[1] == grams[3] and len(np.unique(grams)) == 3
    swapped, _ = gram_hashes(words_of(pa.array(["b a c d e"])), 5)
    assert swapped[0] != grams[0]


def test_slices_cover_all_rows_and_long_texts_stand_alone():
    column = pa.array(["x" * 10, None, "y" * 100, "", "z" * 5])
    parts = list(slices(column, 20))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    data, at = buffers(column.slice(2, 3))
    assert list(at) == [0, 100, 100, 105] and len(data) == 105
    assert list(slices(pa.array([], pa.string()))) == []
