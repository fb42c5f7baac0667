import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aAbZ é\t\n\r\x0b\x0c .", max_size=40), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    found = [[] for _ in texts]
    for begin, piece in words.slices(pa.array(texts, pa.string())):
        text = words.split(piece)
        for h, r in zip(text.hash, text.row):
            found[begin + r].append(int(h))
    names = {}
    for text, hashes in zip(texts, found):
        own = plain(text)
        assert len(own) == len(hashes)
        for word, h in zip(own, hashes):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_slices_hold_all_rows_and_a_long_text_is_whole():
    texts = ["a b"] * 5 + ["x " * (words.SLICE_BYTES)] + [None, ""] * 3
    parts = list(words.slices(pa.chunked_array([pa.array(texts[:4]), pa.array(texts[4:])])))
    assert sum(len(p) for _, p in parts) == len(texts)
    assert sum(words.split(p).counts().sum() for _, p in parts) == 10 + words.SLICE_BYTES


def test_letters_part_words_at_punctuation():
    text = words.split(next(words.slices(pa.array(["don't stop--now é,è"])))[1], letters=True)
    assert len(text.hash) == 6


def test_pair_is_ordered():
    a, b = np.array([1], np.uint64), np.array([2], np.uint64)
    assert words.pair(a, b) != words.pair(b, a)
