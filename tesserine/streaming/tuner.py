"""A pitch tracker over a stream of audio frames.

Each row is a frame: session, seq, samples. A frame is windowed, transformed and
searched for a sharp peak; the peak is refined by a parabola, and the frequency
is smoothed over the frames of its session, whose state is one number. Silence
or a blurred peak clears it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Open strings, and the thresholds of a heard note.
NOTES = {"E2": 82.41, "A2": 110.0, "D3": 146.83, "G3": 196.0, "B3": 246.94, "E4": 329.63}
SILENCE, LOWEST, HIGHEST, ABOVE_MEAN, ABOVE_SIDES, ALPHA = 0.005, 50, 1000, 4.0, 1.5, 0.25
RESULT = "session string, seq long, note string, frequency double, target double, cents double, rms double"


def peak(samples: np.ndarray, rate: int) -> float | None:
    """The frequency of a frame's peak, or None where none stands out."""
    n = len(samples)
    magnitude = np.abs(np.fft.fft(samples * np.hanning(n)))
    low, high = int(LOWEST * n / rate), math.ceil(HIGHEST * n / rate)
    band = magnitude[low:high]
    if not len(band):
        return None
    k = low + int(np.argmax(band))
    if low < k < high - 1 and magnitude[k] < ABOVE_SIDES * (magnitude[k - 1] + magnitude[k + 1]) / 2 or magnitude[k] < ABOVE_MEAN * band.mean():
        return None
    bend = magnitude[k - 1] - 2 * magnitude[k] + magnitude[k + 1] if 0 < k < n - 1 else 0
    return (k + (0.5 * (magnitude[k - 1] - magnitude[k + 1]) / bend if bend else 0)) * rate / n


def tracked(frames: pd.DataFrame, smoothed: float | None, rate: int) -> tuple[pd.DataFrame, float | None]:
    """Results of frames in order, and the smoothed frequency after them."""
    rows = []
    for session, seq, samples in frames.sort_values("seq")[["session", "seq", "samples"]].itertuples(index=False):
        x = np.asarray(samples, float)
        rms = float(np.sqrt(np.mean(x * x))) if len(x) else 0.0
        found = peak(x, rate) if rms >= SILENCE else None
        if found is None:
            smoothed = None
            rows.append((session, seq, "--", 0.0, 0.0, 0.0, rms))
            continue
        smoothed = found if smoothed is None else ALPHA * found + (1 - ALPHA) * smoothed
        note = min(NOTES, key=lambda n: abs(NOTES[n] - smoothed))
        rows.append((session, seq, note, smoothed, NOTES[note], 1200 * math.log2(smoothed / NOTES[note]), rms))
    return pd.DataFrame(rows, columns=["session", "seq", "note", "frequency", "target", "cents", "rms"]), smoothed


def track(frames: DataFrame, rate: int = 44_100) -> DataFrame:
    """Notes of a stream, or of a table, of frames."""
    if not frames.isStreaming:
        return frames.groupBy("session").applyInPandas(lambda g: tracked(g, None, rate)[0], RESULT)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        out, held = tracked(pd.concat(parts), held, rate)
        state.update((held,))
        yield out

    return frames.groupBy("session").applyInPandasWithState(step, RESULT, "smoothed double", "append", GroupStateTimeout.NoTimeout)
