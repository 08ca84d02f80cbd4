"""The splitting tree beyond the sizes that numpy draws from."""

import numpy as np

from kelpline.llm import mixing


def test_large_draws_have_the_right_distribution():
    rng = np.random.default_rng(4)
    # Where numpy can draw as well: the same distribution.
    for good, bad, draws in ((30, 50, 20), (500, 400, 300), (7, 2000, 900)):
        own = np.array([mixing.large_hypergeometric(rng, good, bad, draws) for _ in range(20_000)])
        ref = rng.hypergeometric(good, bad, draws, 20_000)
        a, b = (np.bincount(x, minlength=good + 1) / 20_000 for x in (own, ref))
        assert np.abs(np.cumsum(a) - np.cumsum(b)).max() < 0.02
    # Beyond it: mean and variance.
    good, bad, draws = 4_000_000_000, 2_000_000_000, 3_000_000_000
    own = np.array([mixing.hypergeometric(rng, good, bad, draws) for _ in range(4000)])
    sd = np.sqrt(draws * (2 / 3) * (1 / 3) * (good + bad - draws) / (good + bad - 1))
    assert abs(own.mean() - 2e9) < 5 * sd / 63 and 0.95 < own.std() / sd < 1.05
    assert mixing.large_hypergeometric(rng, 2_000_000_000, 1, 2_000_000_001) == 2_000_000_000


def test_quotas_of_thousands_of_millions_split_exactly():
    quota = np.array([4_000_000_000, 0, 2_000_000_000, 7, 3_000_000_000], np.int64)
    parts = [mixing.split_path(quota, i, 8, 9) for i in range(8)]
    assert (sum(p for p, _ in parts) == quota).all()
    assert all((b == sum(p for p, _ in parts[:i])).all() for i, (_, b) in enumerate(parts))
    assert all(abs(int(p.sum()) - 9_000_000_007 // 8) <= 3 for p, _ in parts)
