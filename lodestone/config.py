"""Thresholds and vocabularies of the audit operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Defaults of every check; pass another instance to a call to change them."""

    max_asset_rows: int = 50
    rare_proportion: float = 0.01
    rare_count: int = 5
    noise_min_class: int = 10
    outlier_min_samples: int = 5
    mild: float = 1.5
    extreme: float = 3.0
    mad_z: float = 3.5
    near_constant: float = 1e-6
    spread_orders: float = 2.0
    high_skew: float = 2.0
    log_skew: float = 1.5
    dominant_ratio: float = 10.0
    co_missing: float = 0.5
    token_min_count: int = 3
    token_purity: float = 0.9
    token_bonus: float = 0.2
    proxy_purity: float = 0.8
    numeric_proxy_purity: float = 0.75
    proxy_unique: int = 30
    deciles: int = 10
    risk_high: float = 0.85
    risk_medium: float = 0.55
    nesting: float = 0.95
    profile_coverage: float = 0.5
    eda_coverage: float = 0.8
    identifier_unique: float = 0.9
    dominant_extension: float = 0.9
    ambiguous_role: float = 0.4
    norm_tolerance: float = 0.15
    split_drift: float = 0.2
    gap_steps: float = 1.0
    seasonal_js: float = 0.1
    missing_group: float = 0.2
    joint_confidence: float = 0.3
    min_joints: int = 10
    sample_rate: int = 22050
    silence_db: float = 60.0
    clip_level: float = 0.999
    action_ratio: float = 0.5


DEFAULTS = Thresholds()

# Column-name hints, file suffixes, split names and joints decide results and must be these.
PATH_HINTS = (
    "path", "filepath", "file_path", "filename", "file", "uri", "url", "source", "video", "image", "img", "frame", "clip",
    "sequence", "json_path", "npz_path", "npy_path", "audio", "sound", "recording", "speech", "waveform",
)
LABEL_HINTS = ("label", "target", "class", "y", "ground_truth", "gt", "annotation", "category", "event", "action", "activity", "fall")
GROUP_HINTS = (
    "split", "group", "subject", "subject_id", "person_id", "session", "session_id", "camera", "camera_id", "scene",
    "environment", "site", "fold", "partition",
)
TEMPORAL_HINTS = (
    "frame", "frame_id", "frame_idx", "timestamp", "time", "start", "end", "fps", "duration", "clip_id", "sequence_id",
    "sample_rate", "sr", "n_samples",
)
ID_HINTS = ("id", "sample_id", "uuid", "uid", "record_id", "row_id", "index", "name")
FILE_SUFFIXES = (
    ".csv", ".json", ".jsonl", ".mp4", ".avi", ".mov", ".mkv", ".jpg", ".jpeg", ".png", ".bmp", ".webp", ".npy", ".npz",
    ".pkl", ".pickle", ".txt", ".tsv", ".parquet", ".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac",
)
TEXT_SUFFIXES = (".txt", ".md", ".log", ".json", ".jsonl", ".csv", ".tsv")
AUDIO_SUFFIXES = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac")
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
TEXT_HINTS = (
    "text", "transcript", "caption", "sentence", "document", "content", "utterance", "review", "comment", "description",
    "body", "prompt", "response",
)
SPLIT_RANK = {"train": 0, "training": 0, "val": 1, "valid": 1, "validation": 1, "test": 2, "testing": 2, "eval": 2}
SPLIT_LIKE = ("split", "fold", "partition")
TIME_ORDER = ("time", "timestamp", "date", "frame", "index", "step", "seq", "sample")
DATE_LIKE = ("date", "time", "timestamp", "datetime", "created", "recorded", "year", "month")
SKELETON_TOKENS = ("keypoint", "keypoints", "skeleton", "joint", "bbox", "fps")
AUDIO_TOKENS = ("audio", "sound", "recording", "speech", "waveform")
TEMPORAL_TOKENS = ("fps", "duration", "timestamp")
LIMBS = (("left_shoulder_elbow", 5, 7), ("right_shoulder_elbow", 6, 8), ("left_hip_knee", 11, 13), ("right_hip_knee", 12, 14))
