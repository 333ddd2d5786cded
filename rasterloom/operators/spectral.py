"""Frequency analysis: stacks of small images are transformed in one go, large images in two passes, over rows and over columns.

A large image is never in one place: whole rows are transformed where they lie, a shuffle brings the columns of the half spectrum
together, which are transformed, multiplied and transformed back, and another shuffle brings back rows. What follows the
transform (orientation, amplitude, phase, transport) is relational; see transport.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import kernels, tilework

BANDS, TOP, SIGMA = 3, 0.22, 1.6


def frequencies(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    return np.fft.fftfreq(h)[:, None], np.fft.rfftfreq(w)[None, :]


def _responses(fy: np.ndarray, fx: np.ndarray, bands: int, top: float, sigma: float) -> np.ndarray:
    r = np.maximum(np.hypot(fy, fx), 1e-6)
    return np.stack([np.exp(-0.5 * (np.log(r / (top * 2.0**-k)) / np.log(sigma)) ** 2) for k in range(bands)])


@lru_cache(maxsize=256)
def _peak(h: int, w: int, bands: int, top: float, sigma: float) -> float:
    """The greatest sum of the bands, found strip by strip, or 1."""
    fy, fx = frequencies(h, w)
    step = max(1, kernels.MOST // h)
    return max(1.0, *(_responses(fy, fx[:, i : i + step], bands, top, sigma).sum(axis=0).max() for i in range(0, fx.shape[1], step)))


def filter_bank(h: int, w: int, bands: int = BANDS, top: float = TOP, sigma: float = SIGMA, columns: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Band transfers (bands, h, w // 2 + 1) and the low pass, or columns of these; together they sum to 1 where the bands sum to at most 1."""
    fy, fx = frequencies(h, w)
    g = _responses(fy, fx[:, columns], bands, top, sigma) / _peak(h, w, bands, top, sigma)
    return g, np.maximum(0.0, 1 - g.sum(axis=0))


def _split(spectrum: np.ndarray, h: int, w: int, columns: slice, bands: int, top: float, sigma: float) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(band, spectra of the band and its Riesz pair) of columns of a half spectrum; band -1 is the low pass, whose pair is 0."""
    g, low = filter_bank(h, w, bands, top, sigma, columns)
    fy, fx = frequencies(h, w)
    fx = fx[:, columns]
    r = np.hypot(fy, fx)
    r = np.where(r == 0, 1.0, r)
    for k in range(bands):
        s = spectrum * g[k]
        yield k, [s, -1j * fx / r * s, -1j * fy / r * s]
    yield -1, [spectrum * low, np.zeros_like(spectrum), np.zeros_like(spectrum)]


def _rows(ids: np.ndarray, part: kernels.Part, h: int, w: int, band: int | None, **planes: np.ndarray) -> pa.RecordBatch:
    d = kernels.pixels(ids, np.stack(list(planes.values())), list(planes), part, h, w)
    return d if band is None else d.append_column("band", pa.array(np.full(d.num_rows, band, np.int32)))


def _parts(ids: str, names: list[str], band: bool) -> str:
    return f"{ids}, h int, w int, y int, x int, {', '.join(f'{c} double' for c in names)}{', band int' if band else ''}"


def _sizes(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    small = F.col("h").cast("long") * F.col("w") <= most
    return df.where(small), df.where(~small)


def decompose(df: DataFrame, value: str, bands: int = BANDS, top: float = TOP, sigma: float = SIGMA, most: int = kernels.MOST) -> DataFrame:
    """(image_id, h, w, y, x, band, b, rx, ry): each band of a field with its Riesz pair; band -1 is the low pass (rx, ry 0). Images of over `most` pixels take two passes."""
    small, large = _sizes(df.select("image_id", "h", "w", "y", "x", F.col(value).alias("v")), most)
    ids, names = tilework.schema_of(df, ["image_id"]), ["b", "rx", "ry"]

    def at_once(v: np.ndarray, own_ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w = own[:2]
        for k, spectra in _split(np.fft.rfft2(v[0]), h, w, slice(None), bands, top, sigma):
            yield _rows(own_ids, part, h, w, k, **{n: np.fft.irfft2(s, s=(h, w)) for n, s in zip(names, spectra, strict=True)})

    def along_rows(v: np.ndarray, own_ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w = own[:2]
        s = np.fft.rfft(v[0], axis=-1)
        yield _rows(own_ids, (*part[:2], 0, w // 2 + 1), h, w, None, re=s.real, im=s.imag)

    waves = [f"{n}_{c}" for n in names for c in ("re", "im")]

    def along_columns(v: np.ndarray, own_ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w = own[:2]
        s = np.fft.fft(v[0] + 1j * v[1], axis=-2)
        for k, spectra in _split(s, h, w, slice(part[2], part[3]), bands, top, sigma):
            back = [np.fft.ifft(s, axis=-2) for s in spectra]
            yield _rows(own_ids, part, h, w, k, **dict(zip(waves, (p for z in back for p in (z.real, z.imag)), strict=True)))

    def rows_back(v: np.ndarray, own_ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w, _, band = own[:4]
        planes = {n: np.fft.irfft(v[2 * i] + 1j * v[2 * i + 1], n=w, axis=-1) for i, n in enumerate(names)}
        yield _rows(own_ids, (*part[:2], 0, w), h, w, band, **planes)

    half = F.floor(F.col("w") / 2).cast("int") + 1
    d = tilework.in_tasks(tilework.strips(large, "x", most=most), ["v"], [], along_rows, _parts(ids, ["re", "im"], False), most)
    d = tilework.in_tasks(tilework.strips(d, "y", width=half, most=most), ["re", "im"], [], along_columns, _parts(ids, waves, True), most)
    d = tilework.in_tasks(tilework.strips(d, "x", F.col("band"), half, most), waves, [], rows_back, _parts(ids, names, True), most)
    out = tilework.in_tasks(tilework.whole(small), ["v"], [], at_once, _parts(ids, names, True))
    return out.unionByName(d).select("image_id", "h", "w", "y", "x", "band", *names)


def phase_gradient(bands: DataFrame, most: int = kernels.MOST) -> DataFrame:
    """Adds gx, gy, the gradient of the phase of b + i r, to bands with r and amp: the spectral derivative of the unit phasor, times its conjugate. Two passes as in decompose."""
    small, large = _sizes(bands, most)
    ids, band = tilework.schema_of(bands, ["image_id"]), F.col("band")
    rest = [c for c in bands.columns if c not in ("image_id", "h", "w", "y", "x", "band", "b", "r", "amp")]
    carried, names = ["b", "r", "amp", *rest], ["gx", "gy"]
    unit: list[Column] = [F.col(c) / F.greatest("amp", F.lit(1e-8)) for c in ("b", "r")]

    def gradients(z: np.ndarray, s: np.ndarray, back) -> list[np.ndarray]:
        fy, fx = np.fft.fftfreq(s.shape[-2])[:, None], np.fft.fftfreq(s.shape[-1])[None, :]
        return [np.imag(np.conj(z) * back(2j * np.pi * f * s)) for f in (fx, fy)]

    def at_once(v: np.ndarray, own_ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w, k = own[:3]
        z = (v[0] + 1j * v[1]) / np.maximum(v[2], 1e-8)
        gx, gy = gradients(z, np.fft.fft2(z), np.fft.ifft2)
        yield _rows(own_ids, part, h, w, k, **dict(zip(carried, v, strict=True)), gx=gx, gy=gy)

    def along_rows(v: np.ndarray, own_ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w, _, k = own[:4]
        s = np.fft.fft(v[0] + 1j * v[1], axis=-1)
        yield _rows(own_ids, part, h, w, k, re=s.real, im=s.imag)

    waves = [f"{n}_{c}" for n in names for c in ("re", "im")]

    def along_columns(v: np.ndarray, own_ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w, _, k = own[:4]
        s = np.fft.fft(v[0] + 1j * v[1], axis=-2)
        fy, fx = np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, part[2] : part[3]]
        back = [np.fft.ifft(2j * np.pi * f * s, axis=-2) for f in (fx, fy)]
        yield _rows(own_ids, part, h, w, k, **dict(zip(waves, (p for z in back for p in (z.real, z.imag)), strict=True)))

    def rows_back(v: np.ndarray, own_ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w, _, k = own[:4]
        back = [np.fft.ifft(v[i] + 1j * v[i + 1], axis=-1) for i in (0, 2)]
        yield _rows(own_ids, part, h, w, k, **dict(zip(waves, (p for z in back for p in (z.real, z.imag)), strict=True)))

    unit_px = large.select("image_id", "h", "w", "y", "x", "band", unit[0].alias("re"), unit[1].alias("im"))
    d = tilework.in_tasks(tilework.strips(unit_px, "x", band, most=most), ["re", "im"], [], along_rows, _parts(ids, ["re", "im"], True), most)
    d = tilework.in_tasks(tilework.strips(d, "y", band, most=most), ["re", "im"], [], along_columns, _parts(ids, waves, True), most)
    d = tilework.in_tasks(tilework.strips(d, "x", band, most=most), waves, [], rows_back, _parts(ids, waves, True), most)
    d = large.join(d.select("image_id", "band", "y", "x", *waves), ["image_id", "band", "y", "x"])
    d = d.withColumns({n: unit[0] * F.col(f"{n}_im") - unit[1] * F.col(f"{n}_re") for n in names}).drop(*waves)
    out = tilework.in_tasks(tilework.whole(small, band), carried, [], at_once, _parts(ids, [*carried, *names], True))
    order = [*bands.columns, *names]
    return out.select(*order).unionByName(d.select(*order))


def dft_rows(df: DataFrame, value: str) -> DataFrame:
    """(image_id, y, k, re, im): the transform of each row as a join-free grouped sum; for small widths, and to check decompose.

    Of images that are rows of arrays, by the same sums in their rows."""
    if tilework.by_rows(df):

        def sums(v: np.ndarray) -> np.ndarray:
            w = v.shape[-1]
            angle = -2 * np.pi * np.arange(w)[:, None] * np.arange(w // 2 + 1) / w
            return np.stack([v[0] @ np.cos(angle), v[0] @ np.sin(angle)])

        d = tilework.changed(df.select("image_id", "h", "w", F.col(value).alias("v")), ["v"], sums, ["re", "im"])
        return tilework.as_pixels(d, ["re", "im"]).select("image_id", "y", F.col("x").alias("k"), "re", "im")
    d = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("w") / 2).cast("int"))))
    angle = -2 * F.pi() * F.col("k") * F.col("x") / F.col("w")
    return d.groupBy("image_id", "y", "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(F.col(value) * F.sin(angle)).alias("im"))
