"""Properties of the parts that run inside tasks, on generated input."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorlab.functions.arrow import matrix, numbers
from sensorlab.functions.hashing import MERSENNE, lattice
from sensorlab.operators.elm.layer import SCORE_ROWS, draw_layer
from sensorlab.operators.elm.solver import RowFactor, factor_batch, fold, solve
from sensorlab.operators.evaluate import _ranked_pairs


@settings(max_examples=60, deadline=None)
@given(
    seed=st.integers(0, 2**32 - 1),
    width=st.integers(2, 9),
    blocks=st.lists(st.integers(0, 60), min_size=1, max_size=12),
    spread=st.integers(0, 6),
    shift=st.sampled_from([0.0, 1.0, 1e3]),
)
def test_factor_of_any_blocks_has_the_singular_values_of_all_rows(seed, width, blocks, spread, shift):
    rng = np.random.default_rng(seed)
    scale = 10.0 ** -rng.integers(0, spread + 1, width)
    parts = [rng.normal(size=(n, width)) * scale + shift for n in blocks]
    rows = np.vstack(parts)
    sums = RowFactor()
    for part in parts:
        sums.add(part)
    factor = sums.settle()
    if not len(rows):
        assert factor is None
        return
    expected = np.linalg.svd(rows, compute_uv=False)
    got = np.zeros(len(expected))
    found = np.linalg.svd(factor, compute_uv=False)
    got[: min(len(found), len(got))] = found[: len(got)]
    assert np.allclose(got, expected, rtol=1e-7, atol=1e-11 * expected[0])


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 2**32 - 1), cut=st.integers(1, 199), columns=st.integers(1, 4))
def test_merged_factors_solve_the_whole_problem(seed, cut, columns):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(200, 4))
    y = rng.normal(size=200)
    rows = np.column_stack([a, y])
    merged = fold(fold(None, rows[:cut]), fold(None, rows[cut:]))
    direct = np.linalg.lstsq(a[:, :columns], y, rcond=None)[0]
    assert np.allclose(solve(merged, columns), direct)


@settings(max_examples=80, deadline=None)
@given(
    data=st.lists(st.tuples(st.integers(-5, 5), st.booleans()), min_size=1, max_size=40),
    cuts=st.lists(st.integers(0, 40), max_size=4),
)
def test_ranked_pairs_equal_all_pairs(data, cuts):
    counts = {}
    for score, positive in data:
        p, n = counts.get(score, (0, 0))
        counts[score] = (p + positive, n + (not positive))
    ordered = sorted(counts.items())
    batch = pa.RecordBatch.from_pydict(
        {
            "score": [float(s) for s, _ in ordered],
            "positives": [c[0] for _, c in ordered],
            "negatives": [c[1] for _, c in ordered],
        }
    )
    edges = sorted({0, len(ordered), *(c for c in cuts if c < len(ordered))})
    batches = [batch.slice(a, b - a) for a, b in zip(edges, edges[1:])]
    (result,) = [b.to_pylist()[0] for b in _ranked_pairs(iter(batches))]
    expected = sum(
        (a > b) + 0.5 * (a == b) for a, p in data if p for b, q in data if not q
    )
    assert result["pairs"] == expected
    assert result["positives"] == sum(p for _, p in data)
    assert result["first"] == float(min(s for s, _ in data))


def test_scores_in_pieces():
    layer = draw_layer(10, 2)
    x = np.random.default_rng(0).normal(size=(2 * SCORE_ROWS + 7, 2))
    beta = np.arange(10.0)
    assert np.allclose(layer.scores(x, beta), layer.outputs(x) @ beta)
    assert layer.scores(x[:0], beta).shape == (0,)
    assert layer.scores(x[:0], np.ones((10, 3))).shape == (0, 3)


def test_arrow_columns():
    lists = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    assert matrix(lists.slice(1)).tolist() == [[3.0, 4.0], [5.0, 6.0]]
    assert matrix(pa.chunked_array([lists, lists])).shape == (6, 2)
    assert matrix(lists.slice(0, 0)).shape == (0, 0)
    for bad in ([[1.0], None], [[1.0], [None]], [[1.0], [1.0, 2.0]], [[1.0], [1.0, 2.0, 3.0]]):
        with pytest.raises(ValueError):
            matrix(pa.array(bad))
    with pytest.raises(ValueError):
        numbers(pa.array([1.0, None]))
    batch = factor_batch(3, 4, np.arange(6.0).reshape(3, 2))
    assert batch.column("row").to_pylist() == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=50))
def test_lattice_numbers_are_in_the_unit_interval(keys):
    values = lattice(np.array(keys))
    assert ((values >= 0) & (values < 1)).all()
    exact = [((1103515245 * k + 12345) % 2**31) ** 2 % MERSENNE / MERSENNE for k in keys]
    assert values.tolist() == exact
