"""Announced values and issued keys of any length are found whole; forms and lengths that the fit has not seen."""

import random

import pytest

from loomspan.llm import pii

SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


@pytest.fixture(scope="module")
def weights():
    return pii.fit()


def shares(weights, make, n=60):
    """(share of the values found as one span, share of their characters that stay unmasked)."""
    whole = left = size = 0
    for _ in range(n):
        before, value, after = make()
        spans = pii.find_spans(before + value + after, weights)[1]
        whole += ("secret", len(before), len(before) + len(value)) in spans
        covered = {k for _, a, b in spans for k in range(a, b)}
        left += sum(k not in covered for k in range(len(before), len(before) + len(value)))
        size += len(value)
    return whole / n, left / size


def test_values_of_any_length(weights):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice(SIGNS) for _ in range(n))
    for n in (40, 60, 90, 97, 150, 400, 5000):
        for before, after in (('api_key = "', '" and more'), ("password: ", ", he said"), ("client secret => '", "'\nnext line")):
            whole, left = shares(weights, lambda n=n, a=before, b=after: (a, "x" + word(n - 2) + "7", b), 20)
            assert whole >= 0.95 and left <= 0.02, (n, before, whole, left)


def test_issued_keys(weights):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice(SIGNS[:62]) for _ in range(n))
    for before in ("the token: ", "we saw "):
        whole, left = shares(weights, lambda a=before: (a, f"eyJ{word(33)}.eyJ{word(120)}.{word(43)}", " in the log"))
        assert whole >= 0.9 and left <= 0.02, (before, whole, left)


def test_plain_text_is_left_alone(weights):
    for text in (
        "The key: a short word that is fine.", "token is the smallest unit of text in a corpus", "The secret: never give up on your dreams", "Press any key: the program continues",
        "sk-learn is a library for machine learning models", "see https://example.org/very/long/path/with/many/segments/and-words/that-go-on-and-on/for/more/than/96/characters/in/total", "key: " + "word " * 400,
    ):
        assert pii.find_spans(text, weights)[1] == [], text[:40]


def test_long_values_take_time_that_grows_with_them(weights):
    text = "password: " + "aB3-" * 100_000 + " end"
    assert pii.find_spans(text, weights)[1] == [("secret", 10, 10 + 4 * 100_000 - 1)] or ("secret", 10, 10 + 4 * 100_000) in pii.find_spans(text, weights)[1]
