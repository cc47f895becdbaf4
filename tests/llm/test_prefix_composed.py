"""Prefix counts where characters compose with those before them: equal to the library, in linear time."""

import random
import time
import unicodedata

import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import prefix_tokens, queries  # noqa: E402
from kindred.llm.wordbpe import word_bpe  # noqa: E402

PATH = queries.tokenizer_path()


def library(text):
    return len(word_bpe(PATH).library.encode(text, add_special_tokens=False).ids)


def counts(text):
    return prefix_tokens.counts_from(prefix_tokens._for(PATH).changes([text.encode()])[0][0])


def test_every_prefix_equals_the_library():
    rng = random.Random(2)
    signs = [*"aesrtvlLdm'!7.", "\u0301", "\u0323", "\u0307", "\u0130", "か", "\u3099", "ᄀ", "ᅡ", "ᆨ", "\u0344", "\u0f73", "é", "\u00a0", "Σ", "<", "ﬁ", "가", "𝟙"]
    for n in range(150):
        text = "".join(rng.choices(signs, k=rng.randrange(1, 25)))
        got = counts(text)
        assert got.tolist() == [library(text[:e]) for e in range(len(text) + 1)], (n, text)


def test_long_decomposed_text_takes_linear_time():
    rng = random.Random(3)
    text = unicodedata.normalize("NFD", "".join(chr(rng.randrange(0x304B, 0x3094)) for _ in range(300_000)))[:400_000]
    began = time.perf_counter()
    got = counts(text)
    assert time.perf_counter() - began < 120 and len(got) == 400_001
    for e in (1, 2, 77, 5000, 20_001):
        assert got[e] == library(text[:e])
    assert got[-1] == library(text)


def test_questions_beyond_the_ends(spark):
    df = prefix_tokens.with_prefix_counts(spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string"), PATH)
    assert [tuple(r) for r in prefix_tokens.ask(df, -1, -5).orderBy("doc_id").collect()] == [(1, None, 0), (2, None, 0)]
    assert [tuple(r) for r in prefix_tokens.ask(df, 10**9, 10**9).orderBy("doc_id").collect()] == [(1, 5, df.filter("doc_id = 1").first().n_tokens), (2, 0, 0)]
