"""Short-time spectra of waves, in Arrow batches: band shares, centroid, and band levels of frames.

A wave is one row's array, of any length; frames of one wave are transformed together, ``FRAMES`` at a time, so a long
wave takes memory for that many frames beside itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES = 1024
# Edges of six bands in Hz, and what counts as an active frame: a share of the 70th percentile of levels.
BANDS = ((0, 300), (300, 1000), (1000, 3000), (3000, 6000), (6000, 8500), (8500, 11000))
ACTIVE_PERCENT, ACTIVE_SHARE, FRAME_SECONDS, LEAST_SECONDS = 70, 0.35, 0.025, 0.3


def frame_powers(wave: np.ndarray, n_fft: int, hop: int) -> Iterator[np.ndarray]:
    """Powers (frames, bins) of windowed frames, some at a time; a wave shorter than a frame is filled up with zeros."""
    count = max(1, -(-(len(wave) - n_fft) // hop))
    if len(wave) < n_fft:
        wave = np.pad(wave, (0, n_fft - len(wave)))
    frames = np.lib.stride_tricks.sliding_window_view(wave, n_fft)[::hop][:count]
    window = np.hanning(n_fft)
    for at in range(0, len(frames), FRAMES):
        yield np.abs(np.fft.rfft(frames[at : at + FRAMES] * window, axis=1)) ** 2


def active_part(wave: np.ndarray, rate: float) -> np.ndarray:
    """The frames of 25 ms that are loud enough, side by side; the whole wave if none is."""
    size = max(1, int(rate * FRAME_SECONDS))
    frames = wave[: len(wave) // size * size].reshape(-1, size)
    if not len(frames):
        return wave
    level = np.sqrt((frames**2).mean(axis=1) + 1e-12)
    loud = level > np.percentile(level, ACTIVE_PERCENT) * ACTIVE_SHARE
    return frames[loud].ravel() if loud.any() else wave


def profile(wave: np.ndarray, rate: float, n_fft: int, hop: int, bands: tuple) -> tuple[list[float], float] | None:
    """Shares of the bands in percent, and the spectral centroid in Hz, of the active part; None for a wave too short."""
    if len(wave) < rate * LEAST_SECONDS:
        return None
    energy = sum(p.sum(axis=0) for p in frame_powers(active_part(wave, rate), n_fft, hop))
    pitch, total = np.fft.rfftfreq(n_fft, 1 / rate), energy.sum() + 1e-12
    return [float(100 * energy[(pitch >= lo) & (pitch < hi)].sum() / total) for lo, hi in bands], float((pitch * energy).sum() / total)


def _waves(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray | None]:
    column = batch.column(name)
    values, ends = column.values, column.offsets.to_numpy()
    numbers = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    for i, there in enumerate(column.is_valid().to_pylist()):
        yield numbers[ends[i] : ends[i + 1]] if there else None


def band_profiles(waves: DataFrame, item: str, wave: str, rate: float, n_fft: int = 2048, hop: int = 512, bands: tuple = BANDS) -> DataFrame:
    """item, bands (percent), centroid (Hz); null for null waves and those under 0.3 s. Null samples count as 0."""
    given = waves.select(item, F.col(wave).cast("array<double>").alias("wave"))

    def profiled(batches):
        for batch in batches:
            found = [None if w is None else profile(w, rate, n_fft, hop, bands) for w in _waves(batch, "wave")]
            columns = [pa.array([f and f[0] for f in found], pa.list_(pa.float64())), pa.array([f and f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [item, "bands", "centroid"])

    kind = given.schema[item].dataType.simpleString()
    return given.mapInArrow(profiled, f"`{item}` {kind}, bands array<double>, centroid double")


def band_levels(waves: DataFrame, item: str, wave: str, rate: float, n_fft: int = 2048, hop: int = 512, bands: tuple = BANDS) -> DataFrame:
    """item, pos, levels: the mean magnitude of each band in each frame, in dB; one row for each frame."""
    given = waves.select(item, F.col(wave).cast("array<double>").alias("wave"))

    def levelled(batches):
        pitch = np.fft.rfftfreq(n_fft, 1 / rate)
        within = [(pitch >= lo) & (pitch < hi) for lo, hi in bands]
        for batch in batches:
            for i, w in enumerate(_waves(batch, "wave")):
                at = 0
                for power in frame_powers(w, n_fft, hop) if w is not None and len(w) else ():
                    mean = np.stack([np.sqrt(power[:, b]).mean(axis=1) if b.any() else np.zeros(len(power)) for b in within], axis=1)
                    level = 20 * np.log10(np.maximum(mean, 1e-10))
                    ids = pa.array([batch.column(0)[i].as_py()] * len(level), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(at, at + len(level))), pa.array(level.tolist(), pa.list_(pa.float64()))], [item, "pos", "levels"])
                    at += len(level)

    kind = given.schema[item].dataType.simpleString()
    return given.mapInArrow(levelled, f"`{item}` {kind}, pos long, levels array<double>")
