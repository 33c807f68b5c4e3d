"""Boundaries and kinds chosen together, with moves between kinds; forms of numbers that the fit has not seen."""

import random
from itertools import product

import numpy as np
import pytest

from loomspan.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.fit()


def value_of(way, score, moves):
    total = sum(score[x] for x in way)
    return total + sum(moves[a[2], b[2]] for a, b in zip(way, way[1:], strict=False) if b[0] - a[1] <= pii.GAP)


def every_way(spans, at=0):
    yield ()
    for x in spans:
        if x[0] >= at:
            for rest in every_way(spans, x[1]):
                yield (x, *rest)


def test_decoding_with_moves_is_the_best_of_all_segmentations():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(2, 12)
        moves = np.array([[rng.uniform(-2, 2) for _ in range(5)] for _ in range(5)])
        places = sorted(rng.sample([(i, j) for i, j in product(range(n), range(1, n + 1)) if i < j <= i + 4], k=min(6, n)))
        score = {(i, j, k): rng.uniform(-2, 2) for i, j in places for k in rng.sample(range(5), 2)}
        best = max(value_of(w, score, moves) for w in every_way(sorted(score)))
        got = pii._decoded(iter([(*x, score[x]) for x in sorted(score)]), moves)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        assert abs(value_of(got, score, moves) - best) < 1e-9


def test_candidates_left_out_never_count(field):
    """What `_scored` leaves out is in no best segmentation."""
    for text, _ in pii.examples(120, seed=4):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        kept = list(pii._scored(text, 0, len(text), [], tokens, field))
        low = pii.Field(field.weights, field.moves)
        whole = []
        for i, j, row in pii._candidates(text, 0, len(text), [], tokens):
            scores = row @ low.weights
            scores[pii.KINDS.index("card")] = scores[pii.KINDS.index("card")] if row[pii._AT["luhn"]] else -np.inf
            scores[4] += pii._AS_ONE if row[pii._AT["opened_whole"]] and scores[4] > 0 else 0
            whole += [(i, j, k, float(x)) for k, x in enumerate(scores)]
        assert pii._decoded(iter(kept), field.moves) == pii._decoded(iter(whole), field.moves), text


def test_a_kind_depends_on_the_span_before_it(field):
    """The same number is a phone beside a phone, and nothing by itself."""
    assert pii.find_spans("we said 8688180 to them", field)[1] == []
    assert pii.find_spans("write bob at host dot com, (212) 555-1234; 212-555-9999 now", field)[1] == [("email", 6, 25), ("phone", 27, 41), ("phone", 43, 55)]


@pytest.mark.parametrize("form", ["call 0671165951", "phone: 868 8180", "Tel. 0049 51 6145393", "Tél : 05 05 85 35 82", "Telefon: 030 1234567", "ring 020 7946 0018", "Fax 0161 496 0000", "cell 555.019.4477", "ring (020) 7946 0018"])
def test_announced_numbers(field, form):
    """Cue words and forms of which the last five are not made by the generator."""
    start = next(k for k, c in enumerate(form) if c in "(0123456789")
    assert pii.find_spans(f"we said {form} to them", field)[1] == [("phone", 8 + start, 8 + len(form))]


@pytest.mark.parametrize("text", ["order 8688180 came", "on 12 12 12 12 12 we", "it grew 868 8180 times", "in 1999 2000 2001 we", "lot 0012345678 was sold", "from 1999 to 2004, 2005 and 2006", "ran 12:30:55 and 13:30:55"])
def test_numbers_that_nothing_announces(field, text):
    assert pii.find_spans(text, field)[1] == []
