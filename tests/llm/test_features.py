"""Hashed features of the quality classifier."""

from larkspur.llm import quality


def test_most_words_of_a_large_vocabulary_have_coordinates_of_their_own():
    words = {f"word{k}" for k in range(100_000)}
    assert len(quality.Features(quality.BITS).numbers(words)) > 80_000
