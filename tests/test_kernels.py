"""Coders and planes must give back what they were given."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastrum.operators import coders, kernels


@pytest.mark.parametrize("coder", sorted(coders.CODERS))
@pytest.mark.parametrize("n", [*range(2, 19), 4095, 4096, 4097])
def test_coders_of_awkward_lengths(coder, n):
    data = np.arange(n) % 17
    assert (coders.decode_any(coders.encode(data, coder)) == data).all()


def test_what_is_refused():
    for data in (np.full(1024, 42), np.array([5]), np.arange(500)):
        with pytest.raises(coders.NotCompressible):
            coders.tans_encode(data)
        assert (coders.decode_any(coders.encode(data)) == data).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), min_size=1, max_size=400), st.sampled_from(sorted(coders.CODERS)))
def test_streams_round_trip(data, coder):
    assert coders.decode_any(coders.encode(np.array(data), coder)).tolist() == data


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from([0, 1, 2, 3, 7, 8, 15, 255, 4095, 65535]), st.randoms(), st.sampled_from(kernels.PREDICTORS), st.booleans())
def test_planes_round_trip(h, w, most, random, predictor, use_runs):
    plane = np.array([[random.choice((0, most, random.randint(0, most))) for _ in range(w)] for _ in range(h)])
    assert (kernels.decode_plane(kernels.encode_plane(plane, predictor, use_runs=use_runs)) == plane).all()


def test_normalisation_fills_the_table():
    random = np.random.default_rng(3)
    for _ in range(200):
        counts = np.bincount(np.minimum(random.geometric(0.02 + 0.5 * random.random(), 3000), 500))
        log = coders.table_log(int(counts.sum()), len(counts))
        while np.count_nonzero(counts) > 1 << log:
            log += 1
        assert np.abs(coders.normalized(counts, log)).sum() == 1 << log
        assert np.abs(coders._proportional(counts, log)).sum() == 1 << log
