"""They have to equal the published ones for results to be comparable."""

# --- fixed values -----------------------------------------------------------------------------

# label sets of the three nested regions
REGION_LABELS = {
    "wt": (1, 2, 3),
    "tc": (1, 3),
    "et": (3,),
}

# report order of the regions
REGIONS = ("et", "tc", "wt")

# keys of the regions in per-fold summary documents
SUMMARY_KEYS = {
    "wt": "(1, 2, 3)",
    "tc": "(1, 3)",
    "et": "(3,)",
}

# allowed labels of a finished segmentation
ALLOWED_LABELS = (0, 1, 2, 3)

# image modalities and their channel codes
MODALITIES = {
    "t1n": "0000",
    "t1c": "0001",
    "t2f": "0002",
    "t2w": "0003",
}

# volume file suffix
VOLUME_SUFFIX = ".nii.gz"

# region decision threshold and the baseline operating point of the ET rule
DECISION_THRESHOLD = 0.5
BASELINE_THRESHOLD = 0.5
BASELINE_MIN_VOXELS = 1

# operating-point grid
GRID_THRESHOLDS = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
GRID_MIN_VOXELS = (1, 5, 10, 25, 50)

# surface agreement tolerance in millimetres
SURFACE_TOLERANCE = 1.0

# components of at least this many voxels count as large
LARGE_COMPONENT = 10

# metric families of a score table
METRIC_FAMILIES = ("global_dsc", "global_nsd", "global_hd95", "all_instance_f1")
PRIMARY_FAMILIES = ("global_dsc", "global_nsd")

# score configurations and their contrasts: name -> (left, right)
CONFIGURATIONS = ("f1_notta", "f1_tta", "f5_notta", "f5_tta", "resenc_f5_tta")
COMPARISONS = {
    "f1_tta_minus_f1_notta": ("f1_tta", "f1_notta"),
    "f5_tta_minus_f5_notta": ("f5_tta", "f5_notta"),
    "f5_notta_minus_f1_notta": ("f5_notta", "f1_notta"),
    "f5_tta_minus_f1_tta": ("f5_tta", "f1_tta"),
    "resenc_f5_tta_minus_plain_f5_tta": ("resenc_f5_tta", "f5_tta"),
}

# group codes and display names of acquisition domains
DOMAIN_NAMES = {
    "GLI": "Domain A (q1/s0)",
    "SSA": "Domain B (q2/s1)",
    "MEN": "Domain C (q0/s2)",
    "PED": "Domain D (q1/s1)",
}
UNKNOWN_GROUP = "UNKNOWN"
UNKNOWN_DOMAIN = "Unknown domain"

# failure definitions
FAILURE_PERCENTILES = (5, 10, 20)
ET_FAILURE_BELOW = 0.5
WT_FAILURE_BELOW = 0.8

# case features used in association tables
MORPHOLOGY_FEATURES = (
    "log_wt_volume",
    "log_tc_volume",
    "log_et_volume",
    "tc_wt_ratio",
    "et_wt_ratio",
    "wt_components_10",
    "tc_components_10",
    "et_components_10",
    "wt_largest_fraction",
    "tc_largest_fraction",
    "et_largest_fraction",
    "wt_compactness",
    "tc_compactness",
    "et_compactness",
    "wt_extent",
    "wt_span_x",
    "wt_span_y",
    "wt_span_z",
    "wt_centroid_x",
    "wt_centroid_y",
    "wt_centroid_z",
)
OUTCOMES = ("mean_dice", "wt_dice", "tc_dice", "et_dice")

# targeted hypotheses: (label, feature, outcome, controls)
PARTIAL_HYPOTHESES = (
    ("ET volume", "log_et_volume", "mean_dice", ("log_wt_volume",)),
    ("ET/WT ratio", "et_wt_ratio", "mean_dice", ("log_et_volume", "log_wt_volume")),
    ("Largest ET fraction", "et_largest_fraction", "mean_dice", ("log_et_volume", "log_wt_volume")),
    ("ET components", "et_components_10", "mean_dice", ("log_et_volume", "log_wt_volume")),
)

# resampling
SEED = 20260729
REPLICATES = 10_000
REPLICATES_SHORT = 2_000
INTERVAL = (0.025, 0.975)

# equal ensemble weights of five folds
ENSEMBLE_WEIGHTS = (0.2, 0.2, 0.2, 0.2, 0.2)

# --- end of fixed values ----------------------------------------------------------------------
