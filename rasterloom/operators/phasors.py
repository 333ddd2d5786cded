"""The phase method on stacks of small images (images, h, w) as arrays: what spectral, transport and topology do on relations of pixels.

Each step is that of the relational form; an image lies whole in its row, so that nothing is shuffled or written between steps.
"""

from __future__ import annotations

import numpy as np

from rasterloom.operators import kernels, spectral, topology
from rasterloom.operators.transport import EPS


def size(n: int, scale: float) -> int:
    return max(1, int(np.rint(n * scale)))


def enlarged(v: np.ndarray, scale: float) -> np.ndarray:
    """As resample.enlarge, of (..., h, w)."""
    have = (0, v.shape[-2], 0, v.shape[-1])
    for s in kernels.resizes(*v.shape[-2:], *(size(n, scale) for n in v.shape[-2:])):
        want = (0, s.to_h, 0, s.to_w)
        v, have = s.run(v, have, want), want
    return v


def analysed(v: np.ndarray, bands: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The low pass, and theta (images, h, w), amp, phi, gx and gy (bands, images, h, w)."""
    h, w = v.shape[1:]
    split = {k: [np.fft.irfft2(s, s=(h, w)) for s in spectra] for k, spectra in spectral._split(np.fft.rfft2(v), h, w, slice(None), bands, spectral.TOP, spectral.SIGMA)}
    b, rx, ry = (np.stack([split[k][i] for k in range(bands)]) for i in range(3))
    angle, weight = 2 * np.arctan2(ry, rx), np.sqrt(b * b + rx * rx + ry * ry)
    theta = 0.5 * np.arctan2((weight * np.sin(angle)).sum(axis=0), (weight * np.cos(angle)).sum(axis=0))
    r = rx * np.cos(theta) + ry * np.sin(theta)
    amp = np.hypot(b, r)
    z = (b + 1j * r) / np.maximum(amp, EPS)
    s = np.fft.fft2(z)
    gx, gy = (np.imag(np.conj(z) * np.fft.ifft2(2j * np.pi * f * s)) for f in (np.fft.fftfreq(w)[None, :], np.fft.fftfreq(h)[:, None]))
    return split[-1][0], {"theta": theta, "amp": amp, "phi": np.arctan2(r, b), "gx": gx, "gy": gy}


def transported(theta: np.ndarray, amp: np.ndarray, phi: np.ndarray, gx: np.ndarray, gy: np.ndarray, scale: float, gain: float = 1.0, gamma: float = 1.0, power: float = 0.5, anisotropy: float = 0.55, sigma_normal: float = 0.6, sigma_tangent: float = 1.8) -> np.ndarray:
    """As transport.transport: a band's (..., h, w) at scale times the size, with mean 0 in each image."""
    axes = []
    for n in theta.shape[-2:]:
        q = np.clip((np.arange(size(n, scale)) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.floor(q).astype(np.int64)
        axes.append([(np.minimum(low + k, n - 1), low + k - q) for k in (0, 1)])
    tangent = sigma_normal + anisotropy * (sigma_tangent - sigma_normal)
    cos, sin, a = np.cos(theta), np.sin(theta), np.maximum(amp, EPS)
    mass_of, flat_of = a**gamma, a ** (gamma - 1)
    re = im = mass = flat = 0.0
    for y, dy in axes[0]:
        for x, dx in axes[1]:
            at = lambda c: c[..., y[:, None], x]  # noqa: B023, E731
            dy_, c, s = dy[:, None], at(cos), at(sin)
            along, across = dx * c + dy_ * s, dy_ * c - dx * s
            # A tap beyond the edge is a whole pixel away, so that its weight is 0.
            wt = (1 - np.abs(dx)) * (1 - np.abs(dy_)) * np.exp(-0.5 * (across**2 / sigma_normal**2 + along**2 / tangent**2))
            wa, advance = wt * at(mass_of), at(phi) - gain * (at(gx) * dx + at(gy) * dy_)
            re, im, mass, flat = re + wa * np.cos(advance), im + wa * np.sin(advance), mass + wa, flat + wt * at(flat_of)
    kappa = np.hypot(re, im) / np.maximum(mass, 1e-12)
    v = mass / np.maximum(flat, 1e-12) * kappa**power * np.cos(np.arctan2(im, re))
    return v - v.mean(axis=(-2, -1), keepdims=True)


def coherence(parts: dict[str, np.ndarray]) -> np.ndarray:
    amp, phi = parts["amp"], parts["phi"]
    return np.hypot((amp * np.cos(phi)).sum(axis=0), (amp * np.sin(phi)).sum(axis=0)) / np.maximum(amp.sum(axis=0), EPS)


def dominant_orientation(parts: dict[str, np.ndarray]) -> np.ndarray:
    amp, theta = parts["amp"], 2 * parts["theta"]
    return 0.5 * np.arctan2((amp * np.sin(theta)).sum(axis=0), (amp * np.cos(theta)).sum(axis=0))


def threshold(v: np.ndarray, relative: float) -> np.ndarray:
    low, high = np.percentile(v, [1, 99], axis=(-2, -1))
    return relative * np.maximum(high - low, 0.0)


def extrema(v: np.ndarray, kind: str = "peak") -> tuple[np.ndarray, ...]:
    """(image, y, x, value, persistence) of the peaks (or pits) of some persistence."""
    sign = -1.0 if kind == "peak" else 1.0
    at, birth, death = topology.merge_trees(sign * v)
    some = death > birth
    at, birth, death = at[some], birth[some], death[some]
    image, place = np.divmod(at, v[0].size if len(v) else 1)
    return image, *np.divmod(place, v.shape[2]), sign * birth, death - birth


def _significant(points: tuple[np.ndarray, ...], tau: np.ndarray) -> tuple[np.ndarray, ...]:
    some = points[4] >= tau[points[0]]
    return tuple(c[some] for c in points)


def _around(v: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """(dy, dx, y, x, value, inside) of the surroundings of points, each (points, offsets)."""
    dy, dx = (d.ravel() for d in np.mgrid[-radius : radius + 1, -radius : radius + 1])
    y, x = y[:, None] + dy, x[:, None] + dx
    inside = (y >= 0) & (y < v.shape[1]) & (x >= 0) & (x < v.shape[2])
    return dy, dx, y, x, v[image[:, None], y.clip(0, v.shape[1] - 1), x.clip(0, v.shape[2] - 1)], inside


def suppressed(candidate: np.ndarray, reference: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidate without its spurious peaks (see topology.spurious, suppress), and how many these are in each image."""
    image, y, x, height, _ = _significant(extrema(candidate), tau)
    known, ry, rx, *_ = _significant(extrema(reference), tau)
    # Reference peaks are laid on a grid, and looked up around each candidate peak.
    marks = np.zeros(candidate.shape, bool)
    marks[known, ry, rx] = True
    dy, dx, *_, there, inside = _around(marks, image, y, x, 3)
    lone = ~(there & inside & (dy * dy + dx * dx <= 9)).any(axis=1)
    image, y, x, height = image[lone], y[lone], x[lone], height[lone]
    *_, near, inside = _around(candidate, image, y, x, 2)
    top = np.where(inside, near, -np.inf).max(axis=1, initial=-np.inf)
    some = top >= height - 0.02 * tau[image]
    image, y, x = image[some], y[some], x[some]
    dy, dx, at_y, at_x, *_ = _around(candidate, image, y, x, 3)
    weight = np.exp(-(dy * dy + dx * dx) / 4.5)
    mask = np.zeros(candidate.shape)
    # What a stamp has beyond the edge falls on it.
    np.add.at(mask, (image[:, None], at_y.clip(0, candidate.shape[1] - 1), at_x.clip(0, candidate.shape[2] - 1)), np.where(weight >= 1e-3, weight, 0.0))
    mask = np.minimum(1.0, mask)
    return candidate * (1 - mask) + reference * mask, np.bincount(image, minlength=len(candidate))


def restored(field: np.ndarray, source: np.ndarray, scale: float, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The field with the source's peaks put back where they are lost (see topology.lost, restore), and how many these are in each image."""
    image, y, x, apex, _ = _significant(extrema(source), tau)
    y, x = (np.rint((c + 0.5) * scale - 0.5).astype(np.int64) for c in (y, x))
    dy, dx, at_y, at_x, near, inside = _around(field, image, y, x, 2)
    top = np.where(inside, near, -np.inf).max(axis=1, initial=-np.inf)
    lost = inside.any(axis=1) & (top < apex - 0.25 * tau[image])
    bump = np.exp(-0.5 * (dy * dy + dx * dx) / (1.5 * 1.5))
    raised = near * (1 - bump) + apex[:, None] * bump
    out, some = field.copy(), inside & lost[:, None]
    np.maximum.at(out, (np.broadcast_to(image[:, None], some.shape)[some], at_y[some], at_x[some]), raised[some])
    return out, np.bincount(image[lost], minlength=len(field))


def reconstructed(v: np.ndarray, scale: float, bands: int, relative: float, keep_topology: bool) -> dict:
    """What phase.reconstruct does: parts (of analysed), assembled, plain, out and, with topology, tau and the counts suppressed and restored."""
    low, parts = analysed(v, bands)
    out = enlarged(low, scale) + transported(**parts, scale=scale).sum(axis=0)
    run = {"parts": parts, "assembled": out, "plain": enlarged(v, scale), "out": out}
    if keep_topology:
        tau = threshold(v, relative)
        kept, n_suppressed = suppressed(out, run["plain"], tau)
        out, n_restored = restored(kept, v, scale, tau)
        run |= {"out": out, "tau": tau, "suppressed": n_suppressed, "restored": n_restored}
    return run


def signature(v: np.ndarray, tau: np.ndarray, kept: int = 32) -> dict:
    """peaks, pits, total, sum_persistence and spectrum (the greatest persistences) of each image, of the extrema above tau."""
    found = [_significant(extrema(v, kind), tau) for kind in ("peak", "pit")]
    n = len(v)
    peaks, pits = (np.bincount(f[0], minlength=n) for f in found)
    image, lasting = (np.concatenate([f[i] for f in found]) for i in (0, 4))
    order = np.lexsort((-lasting, image))
    ends = np.cumsum(peaks + pits)
    spectrum = [lasting[order[e - k : e]][:kept].tolist() for e, k in zip(ends, peaks + pits, strict=True)]
    return {"peaks": peaks, "pits": pits, "total": peaks + pits, "spectrum": spectrum, "sum_persistence": np.bincount(image, lasting, n)}


def gradient(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gx, gy and the magnitude, as neighbourhood.gradient."""
    gx, gy = (np.gradient(v, axis=axis) if v.shape[axis] > 1 else np.zeros_like(v) for axis in (-1, -2))
    return gx, gy, np.sqrt(gx * gx + gy * gy)


def orient_smooth(v: np.ndarray, theta: np.ndarray, radius: int) -> np.ndarray:
    """As neighbourhood.orient_smooth, of (..., images, h, w)."""
    n, h, w = theta.shape
    image, y, x = np.arange(n)[:, None, None], np.arange(h)[:, None], np.arange(w)
    total = weights = 0.0
    for step in range(-radius, radius + 1):
        weight = np.exp(-0.5 * step * step / max(radius * radius, 1e-6))
        at = [np.rint(c + step * d).astype(np.int64).clip(0, m - 1) for c, d, m in ((y, np.sin(theta), h), (x, np.cos(theta), w))]
        total, weights = total + v[..., image, at[0], at[1]] * weight, weights + weight
    return total / weights


def enlarged_rgb(rgb: np.ndarray, scale: float, chroma_detail: float, chroma_guided: bool, **options) -> np.ndarray:
    """What phase.enlarge_rgb does, of (3, images, h, w)."""
    y = kernels.luma(rgb)
    chroma = np.stack([(rgb[2] - y) * kernels.CB, (rgb[0] - y) * kernels.CR]) + 0.5
    run = reconstructed(y, scale, **options)
    lx, ly, lm = gradient(y)
    gx, gy, magnitude = gradient(chroma)
    cos = (gx * lx + gy * ly) / np.maximum(magnitude * lm, 1e-8)
    gate = np.clip(cos, 0, 1) * np.clip(magnitude / np.maximum(lm, 1e-8), 0, 1)
    if chroma_guided:
        gate = orient_smooth(gate, dominant_orientation(run["parts"]), 2)
    cb, cr, plain, *gate = enlarged(np.concatenate([chroma, y[None], gate]), scale)
    y = run["out"]
    cb, cr = (c + chroma_detail * (y - plain) * np.clip(g, 0, 1) for c, g in zip((cb, cr), gate, strict=True))
    r, b = y + (cr - 0.5) / kernels.CR, y + (cb - 0.5) / kernels.CB
    return np.clip(np.stack([r, (y - kernels.LUMA[0] * r - kernels.LUMA[2] * b) / kernels.LUMA[1], b]), 0, 1)
