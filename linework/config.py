"""Parameters of the operators. The defaults are the values that results must be computed with."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Preprocessing:
    max_side: int = 2048
    min_resize_side: int = 900
    min_side: int = 32
    grow_from: float = 1.05
    clahe_below_std: float = 55.0
    clahe_clip: float = 2.0
    clahe_tiles: int = 8
    blur_above_variance: float = 750.0
    deskew_max: float = 15.0
    deskew_min: float = 0.7
    deskew_min_ink: int = 100
    sauvola_window: int = 25
    sauvola_k: float = 0.2
    sauvola_range: float = 128.0
    adaptive_offset: int = 11
    edge_scan: float = 0.08
    edge_ink: float = 0.60
    ruling_share: float = 0.30
    ruling_min: int = 60
    notch_percentile: float = 99.5
    notch_radius: int = 10
    tophat_share: float = 0.25
    #: Fixed: what a binary page is scored by. Ink share wanted and its bounds, sizes of specks and blobs, parts wanted; weights of ink,
    #: specks, blobs and few parts; the score of a page that can't be read.
    score_ink: float = 0.085
    score_least_ink: float = 0.002
    score_most_ink: float = 0.65
    score_speck: int = 2
    score_blob: float = 0.01
    score_parts: int = 8
    score_weights: tuple[float, ...] = (12.0, 1.8, 4.0, 2.0)
    score_unfit: float = -1000.0


@dataclass(frozen=True)
class Detection:
    mask_threshold: float = 0.5
    region_threshold: float = 0.4
    region_min_side: int = 32
    instance_score: float = 0.5
    min_pixel_ratio: float = 0.005
    smooth_window: int = 11
    valley_depth: float = 0.35
    seam: int = 3
    padding: int = 4
    min_height: int = 8
    min_width: int = 8
    group_ratio: float = 0.4
    strip_group_ratio: float = 0.6
    strip_gap: int = 8
    merge_overlap: float = 0.3
    hard_variance: float = 0.18
    bleed_height: float = 2.5
    bleed_width: float = 0.80
    bleed_edge_area: float = 0.02
    bleed_reach: float = 0.35
    peak_share: float = 0.15
    peak_tolerance: float = 0.70
    tall_ratio: float = 1.8
    word_area: float = 0.0002


@dataclass(frozen=True)
class Recognition:
    batch: int = 4
    line_floor: float = 0.05
    token_floor: float = 0.10
    word_floor: float = 0.75
    review_confidence: float = 0.70
    review_cer: float = 0.30
    route_confidence: float = 0.6
    risk_confidence: float = 0.45
    risk_ratio: float = 2.5
    risk_min_words: int = 3
    illegible: str = "[illegible]"
    illegible_line: str = "[illegible line]"


@dataclass(frozen=True)
class Postprocessing:
    spell_correction: bool = True
    low_confidence: float = 0.75
    max_edit_distance: int = 2
    prefix: int = 7


@dataclass(frozen=True)
class Training:
    oversample: int = 3
    focal_gamma: float = 2.0
    ignore_index: int = -100
    max_text: int = 128
    patience: int = 3
    seed: int = 42


@dataclass(frozen=True)
class Config:
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    detection: Detection = field(default_factory=Detection)
    recognition: Recognition = field(default_factory=Recognition)
    postprocessing: Postprocessing = field(default_factory=Postprocessing)
    training: Training = field(default_factory=Training)


CONFIG = Config()
