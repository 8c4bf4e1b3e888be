"""Defaults of the scan operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanOptions:
    """Thresholds and limits that operators take when nothing else is given."""

    exact: bool = True
    perceptual: bool = True
    feature: bool = False
    video: bool = False
    semantic: bool = False
    cross_doc: bool = False
    perceptual_threshold: int = 10
    blend_full: float = 0.8
    blend_top: float = 0.2
    multi_account_min_top: float = 2.0
    multi_account_ratio: float = 1.5
    top_crop: float = 0.08
    feature_ratio: float = 0.75
    feature_min_score: float = 0.15
    video_interval: float = 2.0
    video_threshold: int = 10
    semantic_threshold: float = 0.85
    ela_quality: int = 90
    ela_gain: float = 20.0
    noise_sigma: float = 3.0
    edge_low: float = 50.0
    edge_high: float = 150.0
    alarm_similarity: float = 0.98
    alarm_share: float = 0.05
    retention_days: int = 30
    max_file_bytes: int = 500 * 1024 * 1024
    max_member_bytes: int = 1024**3
    max_archive_bytes: int = 30 * 1024**3
    min_scope_files: int = 2
