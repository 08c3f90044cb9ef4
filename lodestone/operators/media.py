"""Audio and video metrics. Decoders are optional: PCM WAV needs none; video needs cv2 and is reported unavailable without."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.config import DEFAULTS, Thresholds
from lodestone.functions.batches import steps

#: Bytes of files that a worker decodes, and whose rows leave it, at once (a single longer file makes a longer step).
STEP_BYTES = 1 << 22

AUDIO_DDL = "duration_seconds double, sample_rate long, channels long, n_samples long, rms_mean double, rms_std double, dynamic_range double, spectral_centroid_mean double, spectral_bandwidth_mean double, spectral_rolloff_mean double, zcr_mean double, zcr_std double, silence_ratio double, clipping_ratio double"


def available() -> dict[str, bool]:
    from importlib.util import find_spec

    return {"video": find_spec("cv2") is not None, "audio": True, "skeleton": True, "text": True}


def decode_wav(raw: bytes, most_seconds: float = 120.0) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] as channels x samples, and the rate."""
    with wave.open(io.BytesIO(raw)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        data = w.readframes(min(w.getnframes(), int(most_seconds * rate)))
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{width}").astype(float) / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).T, rate


def frames(y: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Centred frames, zeros beyond the ends."""
    padded = np.pad(y, size // 2)
    count = 1 + (len(padded) - size) // hop
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:count]


def audio_metrics(x: np.ndarray, rate: int, t: Thresholds = DEFAULTS) -> dict[str, float]:
    """All audio metrics of decoded samples (channels x samples); levels and spectra of the mean channel."""
    y = x.mean(0) if x.size else np.zeros(0)
    out = {"duration_seconds": x.shape[1] / rate if x.size else 0.0, "sample_rate": rate, "channels": x.shape[0], "n_samples": x.shape[1] if x.size else 0, "clipping_ratio": float((np.abs(x) >= t.clip_level).mean()) if x.size else 0.0}
    if not len(y):
        return out | {"silence_ratio": 1.0}
    cut = frames(y)
    rms = np.sqrt((cut**2).mean(1))
    spectrum = np.abs(np.fft.rfft(cut * np.hanning(2049)[:-1], axis=1))
    freq, total = np.fft.rfftfreq(2048, 1 / rate), np.maximum(spectrum.sum(1), 1e-10)
    centroid = (spectrum * freq).sum(1) / total
    width = np.sqrt((spectrum * (freq - centroid[:, None]) ** 2).sum(1) / total)
    rolloff = freq[(np.cumsum(spectrum, 1) >= 0.85 * spectrum.sum(1, keepdims=True)).argmax(1)]
    sign = np.signbit(cut)
    zcr = (sign[:, 1:] != sign[:, :-1]).sum(1) / cut.shape[1]
    level = 20 * np.log10(np.maximum(rms, 1e-10) / max(rms.max(), 1e-10))
    return out | {"rms_mean": rms.mean(), "rms_std": rms.std(), "dynamic_range": float(rms.max() - rms.min()), "spectral_centroid_mean": centroid.mean(), "spectral_bandwidth_mean": width.mean(), "spectral_rolloff_mean": rolloff.mean(), "zcr_mean": zcr.mean(), "zcr_std": zcr.std(), "silence_ratio": float((level < -t.silence_db).mean()) if rms.max() > 0 else 1.0}


def audio_files(df: DataFrame, path: str = "path", content: str = "content", t: Thresholds = DEFAULTS) -> DataFrame:
    """Metrics of a binaryFile frame: path, audio_error, and the metrics (null where decoding failed)."""
    names, ddl = [p.split(" ")[0] for p in AUDIO_DDL.split(", ")], "path string, audio_error string, " + AUDIO_DDL
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, content, STEP_BYTES):
            out = []
            for p, raw in zip(*(batch.column(c).to_pylist() for c in (path, content)), strict=True):
                row = dict.fromkeys(names) | {"path": p, "audio_error": None}
                try:
                    row |= audio_metrics(*decode_wav(raw), t)
                except Exception as e:  # a file that can't be decoded is a finding, not a failure
                    row["audio_error"] = (str(e) or type(e).__name__)[:200]
                out.append(row)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["path", "audio_error", *names]), schema, preserve_index=False)

    return df.select(path, content).mapInArrow(run, ddl)


def clipping_ratio(samples: Column, t: Thresholds = DEFAULTS) -> Column:
    """Share of samples (array<double>) at or beyond the clip level."""
    return F.try_divide(F.size(F.filter(samples, lambda x: F.abs(x) >= t.clip_level)).cast("double"), F.size(samples))


def temporal_snr(means: DataFrame, clip: str, value: str) -> DataFrame:
    """Mean of a clip's per-frame patch means over their standard deviation."""
    return means.groupBy(clip).agg(F.count("*").alias("n_frames"), (F.avg(value) / F.greatest(F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.lit(1e-12))).alias("temporal_snr"))


def action_window(amplitudes: DataFrame, clip: str, frame: str, value: str, pad: int = 2, t: Thresholds = DEFAULTS) -> DataFrame:
    """First and last frame whose amplitude reaches a share of the clip's mean, padded within the clip."""
    by = Window.partitionBy(clip)
    active = F.when(F.col(value) >= t.action_ratio * F.avg(value).over(by), F.col(frame))
    per = amplitudes.select(clip, F.col(frame).alias("_f"), active.alias("_a"), F.col(value).alias("_v"))
    return per.groupBy(clip).agg(F.max("_v").alias("max_amplitude"), F.avg("_v").alias("mean_amplitude"), F.greatest(F.min("_f"), F.min("_a") - pad).alias("start_frame"), F.least(F.max("_f"), F.max("_a") + pad).alias("end_frame"))


def video_info(df: DataFrame) -> DataFrame:
    """path, status, frame count, fps, size and duration; `unavailable` without a decoder."""
    ddl = "path string, status string, n_frames long, fps double, width long, height long, duration_seconds double"
    has, schema = available()["video"], to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "content", STEP_BYTES):
            out = []
            for p, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                row = {"path": p, "status": "unavailable", "n_frames": None, "fps": None, "width": None, "height": None, "duration_seconds": None}
                if has:
                    import tempfile

                    import cv2

                    with tempfile.NamedTemporaryFile(suffix=".mp4") as f:
                        f.write(raw)
                        f.flush()
                        v = cv2.VideoCapture(f.name)
                        fps, n = v.get(cv2.CAP_PROP_FPS), int(v.get(cv2.CAP_PROP_FRAME_COUNT))
                        row |= {"status": "ok" if fps > 0 else "no frame rate", "n_frames": n, "fps": fps, "width": int(v.get(3)), "height": int(v.get(4)), "duration_seconds": n / fps if fps > 0 else None}
                out.append(row)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=schema.names), schema, preserve_index=False)

    return df.select("path", "content").mapInArrow(run, ddl)
