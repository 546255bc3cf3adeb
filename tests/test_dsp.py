import numpy as np
import pytest

from wavequill.functions import dsp
from wavequill.plans import planner


def direct(x, y, lags):
    n = len(x)
    return np.array([sum(x[i] * y[i + m] for i in range(max(0, -m), min(n, n - m))) for m in range(-lags, lags + 1)])


def reverberation(t):
    """A dozen decaying tones."""
    r = np.random.default_rng(11)
    f, phase = r.uniform(1.5, 9, 12), r.uniform(0, 2 * np.pi, 12)
    return np.exp(-t / 6) * np.cos(2 * np.pi * f[:, None] * t + phase[:, None]).sum(0)


@pytest.mark.parametrize("f", [dsp.correlate_spectra, dsp.correlate_blocks])
def test_correlation_is_the_direct_sum(rng, f):
    x, y = rng.standard_normal((3, 5, 290)), rng.standard_normal((2, 5, 290))
    r = f(x, y, 23)
    want = np.mean([direct(x[2, s], y[1, s], 23) for s in range(5)], axis=0)
    assert np.abs(r[2, 1] - want).max() < 1e-9 * np.abs(want).max()
    assert np.allclose(f(y, x, 23)[1, 2], r[2, 1, ::-1])


def test_blocks_of_any_size_agree(rng):
    x = rng.standard_normal((2, 2, 333))
    for block in (20, 50, 400):
        assert np.allclose(dsp.correlate_blocks(x, x, 12, block), dsp.correlate_spectra(x, x, 12))


# Lags -> (block, FFT length).
@pytest.mark.parametrize(("lags", "want"), [(8, (112, 128)), (37, (950, 1024)), (100, (1848, 2048)), (125, (3846, 4096)), (250, (7692, 8192)), (500, (15384, 16384)), (1000, (30768, 32768)), (4000, (123072, 131072))])
def test_block_size(lags, want):
    assert dsp.block_size(lags) == want


@pytest.mark.parametrize(("lags", "want"), [(37, (524, 598)), (100, (1642, 1842)), (500, (9999, 10999)), (4000, (98124, 106124))])
def test_block_size_not_snapped(lags, want):
    assert dsp.block_size(lags, snap=False) == want


def test_block_size_needs_lags():
    with pytest.raises(ValueError):
        dsp.block_size(0)
    with pytest.raises(ValueError):
        dsp.correlate_spectra(np.zeros((1, 1, 10)), np.zeros((1, 1, 10)), 10)


def test_planner_prefers_blocks_only_where_they_are_cheaper():
    assert planner.choose_method(15000, 125) == "block"
    assert planner.choose_method(15000, 1500) == "conventional"


def test_filter_gain_is_its_mask(rng):
    x = rng.standard_normal((4, 6000))
    a = dsp.bandpass(x, 80, 3, 14)
    b = dsp.spectral_bandpass(x, 80, 3, 14)
    assert np.linalg.norm(a - b) / np.linalg.norm(a) < 5e-2
    impulse = np.zeros(8192)
    impulse[4096] = 1
    for edges in ((2, 10), (None, 10), (5, None)):
        gain = np.abs(np.fft.rfft(dsp.bandpass(impulse, 100, *edges, alpha=None)))
        assert np.abs(gain - dsp.band_mask(np.fft.rfftfreq(8192, 0.01), 100, *edges))[1:-1].max() < 1e-3


def test_filter_has_no_delay_and_keeps_constants():
    t = np.arange(2000) / 100
    x = np.sin(2 * np.pi * 5 * t)
    y = dsp.bandpass(x, 100, 2, 10, alpha=None)
    assert np.corrcoef(x[300:-300], y[300:-300])[0, 1] > 0.9999
    assert np.allclose(dsp.filtfilt(dsp.chebyshev_low(8, 0.05, 0.4), np.full(500, 3.0)), 3.0, rtol=2e-2)
    with pytest.raises(ValueError):
        dsp.butterworth(100, None, None)
    with pytest.raises(ValueError):
        dsp.bandpass(np.zeros(20), 100, 2, 10)


def test_decimate():
    t = np.arange(4000) / 100
    x = np.sin(2 * np.pi * 2 * t) + np.sin(2 * np.pi * 20 * t)
    y = dsp.decimate(x, 100, 4)
    assert len(y) == 1000 and len(dsp.decimate(np.zeros(101), 100, 4)) == 26
    assert np.abs(y[100:-100] - np.sin(2 * np.pi * 2 * t[::4])[100:-100]).max() < 0.02
    with pytest.raises(ValueError):
        dsp.decimate(x, 100, 4, 13)


def test_detrend_median_and_running_mean(drifting_panel):
    x = dsp.detrend(drifting_panel)
    assert np.abs(x.mean(-1)).max() < 1e-10 and np.abs((x * np.arange(3000)).sum(-1)).max() < 1e-5
    y = dsp.running_absolute_mean(x, 25)
    size = np.abs(np.pad(x, [(0, 0), (12, 12)], mode="edge"))
    want = x / np.stack([size[:, i : i + 25].mean(-1) for i in range(3000)], -1)
    assert np.allclose(y, want)
    assert set(np.unique(dsp.running_absolute_mean(x, 1))) <= {-1.0, 0.0, 1.0}
    assert not dsp.running_absolute_mean(np.zeros((1, 30)), 5).any()


def test_preprocess_modes(drifting_panel):
    a, b = (dsp.preprocess(drifting_panel, 100, 3, 20, 0.25, m) for m in ("exact", "spectral"))
    assert a.shape == b.shape == drifting_panel.shape
    assert min(np.corrcoef(x, y)[0, 1] for x, y in zip(a, b, strict=True)) > 0.98
    with pytest.raises(ValueError):
        dsp.preprocess(drifting_panel[0], 100, 3, 20)


def test_whitening_is_flat_in_band(rng):
    """Whatever the spectrum was: here noise that grows weaker with frequency."""
    x = np.cumsum(rng.standard_normal((3, 900)), axis=-1)
    f = np.fft.rfftfreq(900, 1 / 60)
    size = np.abs(np.fft.rfft(dsp.whiten(x, 60, 4, 18)))
    assert np.abs(size[:, (f > 4.3) & (f < 17.7)] - 1).max() < 1e-6
    # It rises from nothing at 0 and falls to nothing at the last frequency.
    assert (np.diff(size[:, f < 4], axis=1) > 0).all() and (np.diff(size[:, f > 18], axis=1) < 0).all() and size[:, [0, -1]].max() < 1e-9
    assert not dsp.whiten_spectrum(np.ones(10, complex), 1.0, 0, 5, 5).any()
    level = dsp.whiten_spectrum(np.ones(65, complex), 1.0, 5.0, 10, 50)
    assert np.allclose(np.abs(level[12:48]), 1)
    with pytest.raises(ValueError):
        dsp.whiten_segments(np.zeros((1, 10)), 1, 3, 0.1, 0.2)


def test_resample_and_envelope():
    t = np.arange(256) / 64
    x = np.cos(2 * np.pi * 4 * t) + 0.2
    up = dsp.resample(x, 512)
    assert np.allclose(up[::2], x) and np.allclose(dsp.resample(up, 256), x)
    assert np.allclose(dsp.envelope(np.cos(2 * np.pi * 8 * t)), 1)


def test_fk_round_trip_and_fan():
    dt, dx, v = 0.01, 1.0, 50.0
    t = np.arange(256) * dt
    x = np.stack([np.exp(-(((t - 0.5 - r * dx / v) / 0.03) ** 2)) for r in range(48)])
    _, _, s = dsp.fk(x, dt, dx)
    assert np.allclose(dsp.fk_back(s, x.shape), x)
    rest, fan = (dsp.fk_filter(x, dt, dx, 20, 200, mode, smooth="no") for mode in ("eliminate", "extract"))
    assert np.allclose(rest + fan, x)
    assert np.linalg.norm(fan) > 0.8 * np.linalg.norm(x - x.mean())
    for bad in ({"mode": "other"}, {"smooth": "other"}):
        with pytest.raises(ValueError):
            dsp.fk_filter(x, dt, dx, 20, 200, **bad)


def test_phase_velocity_image_finds_the_velocity():
    dt, offsets = 0.01, np.arange(1, 41) * 2.0
    t = np.arange(512) * dt
    x = np.stack([np.exp(-(((t - 1 - o / 120) / 0.02) ** 2)) * np.cos(2 * np.pi * 8 * (t - 1 - o / 120)) for o in offsets])
    p, f, v = dsp.phase_velocity_image(x, offsets, dt, 60, 240, 4, 5, 12)
    assert np.abs(v[p.argmax(0)] - 120).max() <= 8 and p.max() == 1
    with pytest.raises(ValueError):
        dsp.phase_velocity_image(x, offsets[:3], dt, 60, 240, 4, 5, 12)
    picked = dsp.pick_curve(p, f, v, [8.0], [200.0])
    assert np.abs(picked - 120).max() <= 8


def test_ridge_follows_a_slope():
    rows, cols = np.arange(60)[:, None], np.arange(40)[None, :]
    image = np.exp(-((rows - (10 + cols)) ** 2) / 8)
    for seeds in ([(20, 30)], [(5, 15), (20, 30), (35, 45)]):
        assert np.abs(dsp.follow_ridge(image, seeds, 2) - (10 + np.arange(40))).max() <= 0


@pytest.mark.parametrize("eps", [-0.013, 0.004, 0.021])
def test_stretch(eps):
    """The stretch is found on its grid, to the nearest value."""
    t, most, steps = np.arange(1500) * 0.02, 0.025, 51
    found, cc = dsp.stretch(reverberation(t), reverberation(t * (1 + eps)), t, 4, 22, most, steps)
    assert found / 100 == pytest.approx(eps, abs=most / (steps - 1)) and cc > 0.9
    assert dsp.stretch(reverberation(t), reverberation(t), t, 31, 40, most, 5)[1] == 0.0


def test_delays(rng):
    """Bursts shifted by whole samples: pairs give the differences, the solution the shifts about their mean."""
    dt, shifts = 0.005, np.array([4, -7, 0, 11, -2, 3])
    t = np.arange(-200, 200) * dt
    late = t - shifts[:, None] * dt
    x = np.exp(-((late / 0.07) ** 2)) * np.cos(2 * np.pi * 6 * late + 0.4) + 0.005 * rng.standard_normal((6, 400))
    cc, lag = dsp.pair_delays(x, dt)
    i, j = np.nonzero(np.triu(cc > 0.8, 1))
    assert len(i) == 15 and np.allclose(lag[i, j], (shifts[i] - shifts[j]) * dt)
    got = dsp.solve_delays(i, j, lag[i, j], 6)
    assert np.allclose(got, (shifts - shifts.mean()) * dt, atol=dt / 10)


def test_similarity_power_and_attenuation(rng):
    a = rng.standard_normal((30, 40))
    assert dsp.ssim(a, a) == pytest.approx(1) and dsp.ssim(a, rng.standard_normal((30, 40))) < 0.3
    f, p = dsp.welch(rng.standard_normal((4, 20000)), 100, 256)
    assert p.sum(-1) * (f[1] - f[0]) == pytest.approx(1, rel=0.1)
    f, s = dsp.spectrogram(np.sin(2 * np.pi * 10 * np.arange(1000) / 100), 100, 100)
    assert (f[s.argmax(-1)] == 10).all()
    freqs, offsets, q, v = np.fft.rfftfreq(256, 0.01), np.arange(1, 11) * 20.0, 30.0, 200.0
    x = np.fft.irfft(np.exp(-np.pi * freqs * offsets[:, None] / (q * v)))
    got, r2 = dsp.attenuation(x, offsets, freqs, (freqs > 5) & (freqs < 20), v, 1)
    assert got == pytest.approx(q, rel=1e-6) and r2 == pytest.approx(1)


def test_windows():
    assert np.allclose(dsp.tukey(64, 1.5), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 63))
    assert (dsp.tukey(5, 0) == 1).all() and list(dsp.tukey(1, 0.5)) == [1]
    assert [dsp.next_pow2(n) for n in (0, 1, 2, 3, 1024, 1025)] == [1, 1, 2, 4, 1024, 2048]


def test_lags_in_a_basis(rng):
    """Band-limited traces need few traces of a basis, others none."""
    x = dsp.resample(rng.standard_normal((40, 16)), 320)
    spectra, nfft = dsp.pair_spectra(x)
    coefficients, basis = dsp.pair_basis(x, spectra, nfft)
    assert len(basis) <= 17 and dsp.pair_basis(x[:, ::20], *dsp.pair_spectra(x[:, ::20])) is None
    for one in spectra[:5]:
        cc, lag = dsp.best_lags(one, spectra, 320, nfft)
        got, at = dsp.best_lags_in_basis(one, coefficients, basis, 320, nfft)
        assert np.allclose(got, cc, atol=1e-12) and (at == lag).all()
