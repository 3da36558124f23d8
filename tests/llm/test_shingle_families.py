"""Operator 7 on families: letters of one form, and copies with scattered edits."""

import random

import pytest

from careflow.llm import shingle_join
from tests.llm.test_operators import frame, plain_components, rows_of, shingle_sets


def letters(count, own, seed):
    """Letters of 120 words that differ in ``own`` words at one place."""
    rng = random.Random(seed)
    form = [f"form{k}" for k in range(120)]
    return [" ".join(form[:60] + [f"x{rng.randrange(10**9)}" for _ in range(own)] + form[60 + own:]) for _ in range(count)]


def scattered(count, most, seed):
    """Copies of a text of 150 words, each with up to ``most`` words replaced anywhere."""
    rng = random.Random(seed)
    base, out = [f"base{k}" for k in range(150)], []
    for _ in range(count):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randrange(most + 1)):
            w[at] = f"y{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.fixture
def compared(monkeypatch):
    """The pairs that each call of verified() looks at."""
    seen, plain = [], shingle_join.verified

    def counted(pairs, sets):
        seen.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(shingle_join, "verified", counted)
    return seen


@pytest.mark.parametrize("count", [150, 600])
def test_letters_of_one_form_cost_no_pairs(spark, compared, count):
    """Pairwise similarity 0.70: no links, and pairs in proportion to the letters."""
    texts = dict(enumerate(letters(count, 16, 3), 1))
    sets = shingle_sets(texts)
    assert 0.6 < len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.75
    got = rows_of(shingle_join.join(frame(spark, texts)))
    assert {d: r["component_id"] for d, r in got.items()} == {d: d for d in texts}
    assert sum(compared) <= 2 * count


def test_families_equal_brute_force(spark):
    some = letters(40, 16, 1) + letters(40, 12, 2) + scattered(60, 9, 4) + scattered(40, 4, 5)
    some += [" ".join(t.split()[k % 7:]) for k, t in enumerate(scattered(40, 6, 6))]
    texts = dict(enumerate(some, 1))
    expected = plain_components(shingle_sets(texts))
    got = rows_of(shingle_join.join(frame(spark, texts)))
    assert {d: r["component_id"] for d, r in got.items()} == expected
    assert 2 < len(set(expected.values())) < len(texts)
