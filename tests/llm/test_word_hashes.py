"""Hashes of words: equal for equal words only, also for words made to collide."""

import random
import re

import pytest

from assayer.llm import _common, ngram_join, quality


def thue_morse(n):
    """A word that polynomial hashes modulo powers of two cannot tell from its complement."""
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def complement(word):
    return word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 8192])
def test_complements_differ(n):
    (h,) = _common.word_hashes([f"{thue_morse(n)} {complement(thue_morse(n))} {thue_morse(n)}"])
    assert h[0] == h[2] != h[1]


def test_words_keep_their_hash_anywhere():
    r, seen = random.Random(1), {}
    for size in (10, 100, 5000):
        for _ in range(60):
            text = "".join(r.choice("abc \n\té\x0b漢") for _ in range(r.randint(0, size)))
            for word, h in zip(re.findall(r"[^\x20\x09-\x0D]+", text), _common.word_hashes([text])[0], strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert (_common._factors(1 << 14)[: 1 << 12] == _common._factors(1 << 12)).all()
    long = "x" * 20_000
    assert _common.word_hashes([long + " y"])[0][0] == _common.word_hashes(["y " + long])[0][1]


def test_documents_of_colliding_words_are_not_linked(spark, documents):
    odd, even = thue_morse(1024), complement(thue_morse(1024))
    texts = [" ".join([f"{odd} lead {i} tail" for i in range(20)]), " ".join([f"{even} lead {i} tail" for i in range(20)]), " ".join([f"{odd} lead {i} tail" for i in range(20)])]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(documents(texts)).collect()}
    assert found == {0: 0, 1: 1, 2: 0}


def test_windows_of_colliding_words_are_not_repeated():
    odd, even = thue_morse(2048), complement(thue_morse(2048))
    repeated = lambda *ws: quality.base_statistics(t := " x y ".join(f"{w} c d e f g h i" for w in ws), _common.word_hashes([t])[0])[-1]
    assert (repeated(odd, odd), repeated(odd, even)) == (16, 0)
