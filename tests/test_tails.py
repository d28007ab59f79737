"""Tail probabilities against enumeration and known values."""

import itertools
import math

import pytest

from tidemark.functions import tails


def test_exact_u_tail_by_enumeration():
    for a, b in ((1, 1), (2, 3), (3, 5), (4, 4), (5, 3)):
        us = [sum(p) - a * (a + 1) // 2 for p in itertools.combinations(range(1, a + b + 1), a)]
        for u in range(a * b + 1):
            high = max(u, a * b - u)
            want = min(1.0, 2 * sum(x >= high for x in us) / len(us))
            assert tails.exact_u_tail(float(u), a, b) == pytest.approx(want, rel=1e-12)


def test_exact_u_tail_with_one_very_large_side():
    p = tails.exact_u_tail(0.30 * 8 * 10**8, 8, 10**8)
    normal = math.erfc((0.70 - 0.5) * 8 * 10**8 / math.sqrt(8 * 10**8 * (10**8 + 9) / 12) / math.sqrt(2))
    assert p == pytest.approx(normal, rel=0.1)


def test_chi2_tail_values():
    for x, df, want in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05)):
        assert tails.chi2_tail(x, df) == pytest.approx(want, rel=1e-9)


def test_largest_supported_set_of_many_labels():
    """Against every subset for few labels; forty labels end as well."""
    import random

    from tidemark.operators.separation import _largest_clique

    rng = random.Random(7)
    for n in (1, 4, 7):
        labels = [f"l{i}" for i in range(n)]
        edges = {(a, b) for a, b in itertools.combinations(labels, 2) if rng.random() < 0.6}
        both = edges | {(b, a) for a, b in edges}
        sets = [s for k in range(n, 0, -1) for s in itertools.combinations(labels, k) if all(p in edges for p in itertools.combinations(s, 2))]
        assert _largest_clique(labels, both) == list(sets[0])
    labels = [f"l{i:02d}" for i in range(40)]
    edges = {(a, b) for a, b in itertools.combinations(labels, 2) if rng.random() < 0.5}
    assert len(_largest_clique(labels, edges | {(b, a) for a, b in edges})) >= 5
