"""Properties that need no Spark session."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortflow.functions.categories import cut_labels
from cohortflow.models import mixed, tails, trees

ratios = st.lists(st.floats(0.01, 1.0), min_size=1, max_size=5)


@given(ratios, st.floats(-10, 10))
def test_leaf_values_add_up(z, value):
    k = len(z)
    path = trees.Path(np.arange(k), np.zeros(k), np.ones(k), np.array(z), value)
    bits = np.array(list(itertools.product((0.5, 2.0), repeat=k)))  # inside and outside of (0, 1]
    phi = trees.shap_matrix(bits, [path])
    want = value * (bits < 1).all(axis=1)
    assert value * np.prod(z) + phi.sum(1) == pytest.approx(want, abs=1e-9)


@given(st.integers(0, 10_000), st.integers(2, 6))
def test_aliased_columns_are_dropped(seed, p):
    x = np.random.default_rng(seed).normal(size=(30, p))
    full = np.column_stack([x, x[:, 0] + 2 * x[:, 1], np.zeros(30)])
    assert mixed.independent(full.T @ full) == list(range(p))


@settings(deadline=None)
@given(st.floats(0.6, 0.999), st.floats(1, 500))
def test_t_quantile_inverts_its_tail(p, df):
    assert tails.t_two_sided(tails.t_quantile(p, df), df) == pytest.approx(2 * (1 - p), rel=1e-8)


@given(st.lists(st.integers(-50, 50), min_size=2, max_size=6, unique=True))
def test_labels_cover_all_bins(points):
    breaks = sorted(points)
    labels = cut_labels([float("-inf"), *map(float, breaks), float("inf")])
    assert len(set(labels)) == len(breaks) + 1 and labels[0].startswith("[-Inf,") and labels[-1].endswith(", Inf]")
