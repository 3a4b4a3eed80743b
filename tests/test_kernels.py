import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.functions import kernels as k
from kinelake.functions import linalg as la

RNG = np.random.default_rng(0)


def test_runs():
    assert k.runs(np.array([1, 1, 0, 1, 0, 0, 1], bool)) == [(0, 2), (3, 4), (6, 7)]
    assert k.runs(np.zeros(0, bool)) == []


@pytest.mark.parametrize("high", [False, True])
def test_butterworth_has_half_power_at_the_cutoff(high):
    b, a = k.butterworth_sections(2, 6.0, 60.0, high)
    z = np.exp(-1j * 2 * np.pi * np.array([0.0, 6.0, 29.999]) / 60.0)
    h = np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))
    assert h[1] == pytest.approx(2**-0.5, abs=1e-6)
    assert h[2 if high else 0] == pytest.approx(1, abs=1e-3) and h[0 if high else 2] < 1e-3
    with pytest.raises(ValueError):
        k.butterworth_sections(2, 40.0, 60.0)


def test_butterworth_keeps_constants_and_ramps_and_damps_noise():
    t = np.arange(200) / 60
    assert np.allclose(k.butterworth(np.full(200, 3.0), 60), 3.0)
    assert np.allclose(k.butterworth(t + 1, 60)[20:-20], (t + 1)[20:-20], atol=1e-3)
    slow, fast = np.sin(2 * np.pi * t) + 5, 0.5 * np.sin(2 * np.pi * 25 * t)
    assert np.abs(k.butterworth(slow + fast, 60)[30:-30] - slow[30:-30]).max() < 0.02


def test_filters_skip_short_runs_and_gaps():
    x = np.concatenate([np.full(5, 1.0), [np.nan], np.arange(30) + 1.0, [0.0], np.arange(4) + 1.0])
    for f in (lambda v: k.butterworth(v, 60), lambda v: k.kalman(v, 60), lambda v: k.gcv_spline(v, 60), lambda v: k.one_euro(v, 60), lambda v: k.lowess(v)):
        y = f(x)
        assert np.isnan(y[5]) and len(y) == len(x)
    for f in (lambda v: k.butterworth(v, 60), lambda v: k.kalman(v, 60), lambda v: k.gcv_spline(v, 60)):
        assert f(x)[36] == 0
    assert (k.butterworth(x, 60)[:5] == 1).all() and k.butterworth(np.full(9, 2.0), 60).tolist() == [2.0] * 9


def test_speed_filter_starts_at_the_first_value():
    x = np.cumsum(RNG.normal(size=100))
    assert k.butterworth_on_speed(x, 60)[0] == pytest.approx(x[0], abs=2.0)


def test_gaussian_and_median_and_lowess():
    assert np.allclose(k.gaussian(np.ones(20), 2), 1)
    impulse = np.zeros(41)
    impulse[20] = 1
    y = k.gaussian(impulse, 2)
    assert y.sum() == pytest.approx(1) and y.argmax() == 20 and np.allclose(y, y[::-1])
    assert k.median(np.array([5.0, 1, 9]), 3).tolist() == [1, 5, 1]
    line = 3 + 2 * np.arange(30.0)
    assert np.allclose(k.lowess(line, 7), line)


def test_kalman_and_one_euro_follow_constants():
    assert np.allclose(k.kalman(np.full(30, 4.0), 60), 4.0)
    assert np.allclose(k.one_euro(np.full(30, 4.0), 60), 4.0)
    noisy = 5 + RNG.normal(scale=0.3, size=300)
    assert np.std(k.one_euro(noisy, 60, beta=0.0)[50:-50]) < 0.2


def test_kalman_follows_a_movement():
    t = np.arange(240) / 60
    y = np.sin(2 * np.pi * 2 * t) + 3
    assert np.sqrt(np.mean((k.kalman(y, 60) - y)[30:-30] ** 2)) < 0.006


def test_smoothing_spline_minimises_its_energy():
    y = RNG.normal(size=25)
    s = k.smoothing_spline(y, 3.0)
    # Second derivatives of the natural spline through s, and the integral of their squares.
    n = len(y)
    r = (4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)) / 6

    def bend(v):  # the second derivative is linear between the values
        m = np.concatenate([[0], np.linalg.solve(r, np.diff(v, 2)), [0]])
        return ((m[1:] ** 2 + m[1:] * m[:-1] + m[:-1] ** 2) / 3).sum()

    energy = lambda v: (y - v) @ (y - v) + 3.0 * bend(v)
    assert all(energy(s) <= energy(s + 1e-3 * RNG.normal(size=n)) for _ in range(50))
    assert np.allclose(k.smoothing_spline(y, 0.0), y) and np.allclose(k.smoothing_spline(y, 1e9), np.polyval(np.polyfit(range(n), y, 1), range(n)), atol=1e-4)


def test_gcv_spline_keeps_lines_and_smooths_noise():
    line = 1 + 0.1 * np.arange(50)
    assert np.allclose(k.gcv_spline(line, 60), line, atol=1e-6)
    t = np.linspace(0, 1, 120)
    y = np.sin(2 * np.pi * t) + 3
    assert np.abs(k.gcv_spline(y + RNG.normal(scale=0.1, size=120), 60) - y).mean() < 0.06
    assert np.abs(k.gcv_spline(y + RNG.normal(scale=0.1, size=120), 120, cutoff=4)[10:-10] - y[10:-10]).mean() < 0.08


def test_hampel_replaces_spikes():
    x = np.arange(20.0) + RNG.normal(scale=0.01, size=20)
    x[10] = 500
    assert abs(k.hampel(x)[10] - 10) < 1.5 and (k.hampel(x)[:3] == x[:3]).all()


@pytest.mark.parametrize("kind,f", [("linear", lambda t: 2 * t + 1), ("quadratic", lambda t: t * t + 1), ("cubic", lambda t: t**3 + 1)])
def test_interpolation_is_exact_for_its_degree(kind, f):
    t = np.arange(30.0)
    x = f(t)
    x[[5, 6, 12]] = np.nan
    x[20] = 0
    assert np.allclose(k.interpolate(x, 5, kind), f(t))
    x[8:18] = np.nan
    assert np.isnan(k.interpolate(x, 5, kind)[8:18]).all() and not np.isnan(k.interpolate(x, None, kind)).any()
    few = np.array([1.0, np.nan, 2.0])
    assert np.isnan(k.interpolate(few, 5, kind)[1])


def test_peaks_by_prominence():
    x = np.array([0, 1, 0, 3, 3, 3, 1, 2, 0, 5.0])
    assert k.peaks(x, 0.5) == [1, 4, 7] and k.peaks(x, 2) == [4]


def test_alternation():
    assert k.alternate([1, 2, 5], [3, 4, 7]) == ([2, 5], [4, 7])
    assert k.alternate([1, 2, 5], [3, 4, 7], "first") == ([1, 5], [3, 7])


vector = st.lists(st.floats(-3, 3), min_size=3, max_size=3).map(np.array)


@settings(max_examples=100, deadline=None)
@given(vector)
def test_rotation_vectors_round_trip(r):
    m = la.rodrigues(r)
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    assert np.allclose(la.rodrigues(la.rotation_vector(m)), m, atol=1e-6)


def test_half_turns_and_inverse_motion():
    for axis in np.eye(3):
        m = la.rodrigues(axis * np.pi)
        assert np.allclose(la.rodrigues(la.rotation_vector(m)), m, atol=1e-6)
    r, t = la.rodrigues([0.1, 0.2, 0.3]), np.array([1.0, 2, 3])
    r2, t2 = la.world_to_camera(*la.world_to_camera(r, t))
    assert np.allclose(r2, r) and np.allclose(t2, t)
    assert np.allclose(la.quaternion_matrix([1, 0, 0, 0]), np.eye(3)) and np.allclose(la.quaternion_matrix([0, 0, np.sin(0.5), np.cos(0.5)], 3), la.rodrigues([0, 0, 1.0]).T)


def test_undistort_inverts_distortion():
    k_, d = np.array([[1700.0, 0, 540], [0, 1700, 960], [0, 0, 1]]), [-0.05, 0.14, 0.0006, 0.0007]
    xy = RNG.uniform(-0.3, 0.3, (50, 2))
    seen = la.distort(xy, d) * 1700 + [540, 960]
    assert np.allclose(la.undistort(seen, k_, d), xy * 1700 + [540, 960], atol=1e-6)
    new = la.optimal_matrix(k_, d, (1080, 1920))
    corners = la.undistort(np.array([(0.0, 0), (1079, 0), (0, 1919), (1079, 1919)]), k_, d, new)
    assert corners.min() >= -1e-6 and corners[:, 0].max() <= 1079 + 1e-6 and corners[:, 1].max() <= 1919 + 1e-6


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    import itertools

    cost = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    pairs = la.assignment(cost)
    best = min(sum(cost[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
    assert sum(cost[i, j] for i, j in pairs) == best and len(pairs) == min(n, m)
