"""The Viterbi search against all readings of short tokens."""

import itertools
import random

import numpy as np
import pytest

from engram.llm import toxicity

MODEL = toxicity.language_model(np.random.default_rng(8).integers(0, 40, toxicity._N**3).astype(float) ** 2)


def all_readings(token):
    """Every way to read a token with its cost: what each character may stand for, and the language model over the letters."""
    best = None
    for chosen in itertools.product(*toxicity._lattice(token)):
        letters = "".join(x for x, _ in chosen)
        classes = [0, 0, *(0 if not c.isalpha() else ord(c) - 96 if c in "abcdefghijklmnopqrstuvwxyz" else 27 for c in letters), 0]
        cost = sum(c for _, c in chosen) + sum(MODEL[a, b, c] for a, b, c in zip(classes, classes[1:], classes[2:]))
        best = min(best or (cost, letters), (cost, letters))
    return best


@pytest.mark.parametrize("token", ["1d1ot", "i.d.i.o.t", "idiooot", "sh1!!t", "$|+", "a11b11", "l33t5p3ak", "x-_-y", "é1é", "111", "...", "b4d+w0rd", "s h i t", "s  h 1 t", "d u m m m b", "a . b", "1 1  1 x"])
def test_cheapest_reading(token):
    cost, letters = toxicity._reading(token, MODEL)
    wanted, _ = all_readings(token)
    assert cost == pytest.approx(wanted)
    own = [c for c in itertools.product(*toxicity._lattice(token)) if "".join(x for x, _ in c) == letters]
    assert own  # what it spells is one of the readings


def test_cheapest_reading_of_random_tokens():
    draw = random.Random(4)
    for _ in range(300):
        token = "".join(draw.choices("abio1350$!.-|", k=draw.randrange(1, 9)))
        if draw.random() < 0.3:
            token = " ".join(token[:6])
        assert toxicity._reading(token, MODEL)[0] == pytest.approx(all_readings(token)[0]), token
