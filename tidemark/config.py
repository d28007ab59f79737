"""Fixed values of the index family: thresholds, calibrations, maps and window defaults."""

from __future__ import annotations

# --- Fixed values -------------------------------------------------------------------------
# The constants below must hold exactly these numbers, otherwise scores and features differ.

VERSIONS = ("V1", "V2", "V3", "V4", "V5", "V6", "V7")
RESOURCE_VERSIONS = ("V4", "V5", "V6", "V7")
MODES = ("strict", "proxy", "hybrid")
COMPONENTS = ("A", "Gamma", "H", "V", "Q", "K")
SENSITIVITY_COMPONENTS = ("A", "Gamma", "H", "V")

EPSILON = 1e-8
SEARCH_EPSILON = 1e-9
MIN_SIGNAL_SAMPLES = 256
MIN_BEATS = 7
MIN_RR_COUNT = 6
MIN_RR_SPECTRUM = 8
RR_RATE = 4.0
RR_LIMITS = (0.3, 2.0)
HISTOGRAM_BINS = 30
PAIR_HISTOGRAM_BINS = 60
SENSITIVITY_DELTA = 0.05
SENSITIVITY_FLOOR = 0.01
GAMMA_SCALE = 1e12

# Static and dynamic window length / step in seconds per dataset.
STATIC_WINDOWS = {
    "wesad": (30.0, 30.0),
    "dreamer": (10.0, 10.0),
    "deap": (10.0, 10.0),
    "case": (10.0, 10.0),
    "eva_med": (4.0, 4.0),
    "ds002722": (21.0, 21.0),
    "ds002724": (21.0, 21.0),
}
DYNAMIC_WINDOWS = {
    "wesad": (10.0, 5.0),
    "dreamer": (5.0, 2.5),
    "deap": (5.0, 2.5),
    "case": (5.0, 2.0),
    "eva_med": (4.0, 2.0),
    "ds002722": (8.0, 4.0),
    "ds002724": (8.0, 4.0),
}

EEG_BANDS = {"full": (1.0, 45.0), "alpha": (8.0, 13.0), "gamma": (30.0, 45.0)}
HRV_BANDS = {"lf": (0.04, 0.15), "hf": (0.15, 0.40)}
ECG_FILTER = (5.0, 18.0)
PPG_FILTER = (0.5, 5.0)

STATE_THRESHOLDS = {
    "dreamer": (2.5, 3.5),
    "deap": (4.5, 5.5),
    "case": (3.5, 6.5),
    "eva_med": (2.5, 3.5),
    "ds002722": (3.5, 5.5),
    "ds002724": (3.5, 5.5),
}
REPORT_RANGES = {
    "dreamer": (1.0, 5.0),
    "deap": (1.0, 9.0),
    "case": (0.5, 9.5),
    "eva_med": (1.0, 9.0),
    "ds002722": (0.0, 9.0),
    "ds002724": (0.0, 9.0),
}
LABEL_LOAD = {
    "baseline": 0.0,
    "rest": 0.0,
    "calm": 0.0,
    "amusement": 0.35,
    "neutral": 0.40,
    "disbalance": 0.60,
    "activated": 0.70,
    "stress": 1.0,
    "stress_like": 1.0,
}
MOTIVATION_BY_LABEL = {"amusement": 0.90, "baseline": 0.65, "disbalance": 0.40, "stress": 0.20}
STRESS_BY_LABEL = {"baseline": 0.15, "amusement": 0.25, "disbalance": 0.55, "stress": 0.90}
DOPAMINE_RANGE = (25.0, 80.0)
CORTISOL_RANGE = (8.0, 25.0)
LABEL_ORDER = ("baseline", "amusement", "disbalance", "stress", "meditation")
TRACK_LABELS = {1: "baseline", 2: "stress", 3: "amusement", 4: "meditation"}
KEPT_TRACK_LABELS = ("baseline", "stress", "amusement")
STIMULUS_LABELS = {
    "startvid": "baseline",
    "endvid": "baseline",
    "bluvid": "baseline",
    "relaxed-1": "baseline",
    "relaxed-2": "baseline",
    "scary-1": "stress",
    "scary-2": "stress",
    "amusing-1": "disbalance",
    "amusing-2": "disbalance",
    "boring-1": "disbalance",
    "boring-2": "disbalance",
}
# Trial types 1..9 form a 3 x 3 grid: valence varies fastest, arousal slowest.
TARGET_LEVELS = (1.5, 4.5, 7.5)
TARGET_NAMES = ("LVLA", "NVLA", "HVLA", "LVNA", "NVNA", "HVNA", "LVHA", "NVHA", "HVHA")

FEATURES = (
    "eeg_left_power",
    "eeg_right_power",
    "eeg_gamma_power",
    "eeg_alpha_left",
    "eeg_alpha_right",
    "alpha_asymmetry",
    "gamma_alpha_ratio",
    "hrv_hf",
    "hrv_lf",
    "hrv_hf_lf",
    "hrv_lf_hf",
    "heart_rate",
    "hrv_rmssd",
    "hrv_sdnn",
    "stress_label",
    "valence",
    "arousal",
    "dominance",
    "liking",
)
EEG_FEATURES = FEATURES[:7]
CARDIAC_FEATURES = FEATURES[7:14]
COMPARISON_FEATURES = (
    "eeg_left_power",
    "eeg_right_power",
    "eeg_gamma_power",
    "eeg_alpha_left",
    "eeg_alpha_right",
    "hrv_hf",
    "hrv_lf",
    "hrv_hf_lf",
    "hrv_lf_hf",
    "stress_label",
    "valence",
    "arousal",
)

WEIGHTS = {
    "V1": {"A": 0.35, "Gamma": 0.25, "H": 0.30, "V": 0.10},
    "V2": {"A": 0.35, "Gamma": 0.25, "H": 0.30, "V": 0.10},
    "V3": {"A": 0.35, "Gamma": 0.25, "H": 0.30, "V": 0.10},
    "V4": {"A": 0.10, "Gamma": 0.05, "V": 0.25, "Q": 0.60},
    "V5": {"A": 0.12, "Gamma": 0.07, "V": 0.24, "Q": 0.57},
    "V6": {"A": 0.14, "Gamma": 0.08, "V": 0.24, "Q": 0.54},
    "V7": {"A": 0.15, "Gamma": 0.08, "V": 0.24, "Q": 0.53},
}

PERMEABILITY = {"alpha": 1.2, "beta": 0.24, "fatigue_k": 5.0, "fatigue_s0": 0.6, "valence_beta": 2.0}

# centre, width of every tanh transform shared by V4..V7
CALIBRATION = {
    "alpha_asymmetry": (0.0006126058755668, 0.0005296436866331),
    "total_asymmetry": (-0.029885183821534496, 0.028709543894737545),
    "gamma_log": (1.5434688675501878, 0.8496713486963336),
    "gamma_alpha_log": (0.0003674266913414713, 0.00043434484108849444),
    "heart_rate": (118.74019555606847, 46.71845481469046),
    "hf_lf_log": (0.9675457417400027, 1.2220370048971366),
}
V4_PROXY_WEIGHT = 0.35

V5 = {
    "q_linear_gain": 1.4,
    "q_coherence_gain": 0.55,
    "q_mismatch_penalty": 0.50,
    "q_gamma_penalty": 0.18,
    "q_proxy_weight": 0.25,
    "q_signed_power": 0.82,
    "q_synergy_gain": 0.42,
    "q_energy_gain": 0.28,
    "q_conflict_gain": 0.24,
    "q_gamma_v_penalty": 0.16,
    "output_center": 0.08,
    "output_gain": 2.6,
    "output_curve": 0.80,
    "output_balance_coupling": 0.18,
    "output_gamma_brake": 0.06,
    "output_contrast_mix": 0.35,
    "output_signed_power": 0.84,
    "output_regime_gain": 0.52,
    "output_energy_gain": 0.34,
    "output_conflict_gain": 0.22,
    "output_gamma_cross_penalty": 0.10,
}
V6 = {
    "shape_power": 0.78,
    "gamma_shape_power": 1.05,
    "gate_temperature": 1.65,
    "q_proxy_weight": 0.18,
    "reg_q_base": 0.76,
    "reg_q_amp": 0.18,
    "mob_q_base": 0.50,
    "mob_q_amp": 0.14,
    "dep_q_base": 0.18,
    "dep_q_amp": 0.16,
    "reg_score_base": 0.80,
    "reg_score_amp": 0.16,
    "mob_score_base": 0.54,
    "mob_score_amp": 0.12,
    "dep_score_base": 0.20,
    "dep_score_amp": 0.16,
    "transition_entropy_weight": 0.08,
    "regime_balance_weight": 0.05,
    "conflict_penalty": 0.10,
}
V7 = {
    "temperature": 1.75,
    "level_weight": 1.00,
    "structure_weight": 0.42,
    "energy_weight": 0.32,
    "component_gain": 1.15,
    "q_gain": 1.85,
    "q_proxy_weight": 0.15,
    "q_coherence_penalty": 0.48,
    "q_gamma_penalty": 0.20,
    "gate_temperature": 1.55,
    "reg_score_base": 0.80,
    "reg_score_amp": 0.16,
    "mob_score_base": 0.53,
    "mob_score_amp": 0.12,
    "dep_score_base": 0.20,
    "dep_score_amp": 0.15,
    "transition_entropy_weight": 0.08,
    "regime_balance_weight": 0.05,
    "conflict_penalty": 0.09,
}
V7_BY_DATASET = {
    "dreamer": {
        "temperature": 0.9298847019451314,
        "structure_weight": 0.32447089642619953,
        "energy_weight": 0.2318303047775378,
        "component_gain": 1.1105332584571976,
        "q_gain": 2.6049273216939297,
        "q_coherence_penalty": 0.7319484783158632,
        "q_gamma_penalty": 0.25866560912379244,
        "gate_temperature": 1.136308633470851,
        "reg_score_base": 0.8654101037471308,
        "reg_score_amp": 0.17480463463286533,
        "mob_score_base": 0.45896753729627837,
        "mob_score_amp": 0.13777127163378194,
        "dep_score_base": 0.1967023282007362,
        "dep_score_amp": 0.1415090086598715,
        "transition_entropy_weight": 0.035697242886134434,
        "regime_balance_weight": 0.06219651310141984,
        "conflict_penalty": 0.05399045325613091,
    },
}
V7_WEIGHTS_BY_DATASET = {
    "dreamer": {
        "A": 0.17120302234851265,
        "Gamma": 0.05182915508006668,
        "V": 0.27522905070616915,
        "Q": 0.5017387718652515,
    },
}

DYNAMICS = {
    "frame": 5,
    "max_records": 4,
    "min_points": 6,
    "ewma_alpha": 0.35,
    "fast_alpha": 0.42,
    "resource_alpha": max(0.35 * 0.85, 0.1),
    "volatility_frame": 4,
    "volatility_scale": 0.035,
    "blend": 0.60,
    "weight_min": 0.10,
    "weight_max": 0.70,
    "response_base": 0.48,
    "response_scale": 0.22,
    "response_volatility": 0.10,
    "recovery_base": 0.12,
    "recovery_scale": 0.10,
    "recovery_volatility": -0.04,
    "gain_min": 0.08,
    "gain_max": 0.85,
}

UTILITY_WEIGHTS = {
    "effect_size": 0.24,
    "inverse_overlap": 0.18,
    "relative_sensitivity": 0.18,
    "arousal_correlation": 0.12,
    "valence_correlation": 0.12,
    "stability": 0.08,
    "coverage": 0.08,
}
RELIABILITY = {"min_valid": 20, "high": 0.6, "medium": 0.3}

# Electrode names by hemisphere. The dreamer list pairs left and right sites in acquisition order.
DREAMER_LEFT = ("AF3", "F7", "F3", "FC5", "T7", "P7", "O1")
DREAMER_RIGHT = ("AF4", "F8", "F4", "FC6", "T8", "P8", "O2")
DREAMER_CHANNELS = DREAMER_LEFT + ("O2", "P8", "T8", "FC6", "F4", "F8", "AF4")
DEAP_CHANNELS = (
    "Fp1 AF3 F3 F7 FC5 FC1 C3 T7 CP5 CP1 P3 P7 PO3 O1 Oz Pz "
    "Fp2 AF4 Fz F4 F8 FC6 FC2 Cz C4 T8 CP6 CP2 P4 P8 PO4 O2"
).split()
DEAP_PERIPHERAL = "hEOG vEOG zEMG tEMG GSR Respiration Plethysmograph Temperature".split()
BCMI_CHANNELS = (
    "FP1 FPz FP2 F7 F3 Fz F4 F8 FT9 FC5 FC1 FC2 FC6 FT10 T7 C3 Cz C4 T8 TP9 "
    "CP5 CP1 CP2 CP6 TP10 P7 P3 Pz P4 P8 O1 O2"
).split()
EVA_MED_LEFT = (
    "FP1 AF3 AF7 F1 F3 F5 F7 FC1 FC3 FC5 FT7 C1 C3 C5 T7 CP1 CP3 CP5 TP7 P1 P3 P5 P7 PO3 PO5 O1"
).split()
EVA_MED_RIGHT = (
    "FP2 AF4 AF8 F2 F4 F6 F8 FC2 FC4 FC6 FT8 C2 C4 C6 T8 CP2 CP4 CP6 TP8 P2 P4 P6 P8 PO4 PO6 O2"
).split()
# --- End of fixed values --------------------------------------------------------------------


def hemisphere(channel: str) -> str:
    """10-20 naming rule: odd electrode numbers are left, even ones right, 'z' the midline."""
    digits = "".join(ch for ch in channel if ch.isdigit())
    if not digits:
        return "mid"
    return "left" if int(digits) % 2 else "right"


def channel_rows() -> list[tuple[str, str, int, str]]:
    """(dataset, channel, position, side) for every montage; sides follow the naming rule."""
    montages = {
        "dreamer": DREAMER_CHANNELS,
        "deap": DEAP_CHANNELS,
        "ds002722": BCMI_CHANNELS,
        "ds002724": BCMI_CHANNELS,
        "eva_med": [*EVA_MED_LEFT, *EVA_MED_RIGHT],
    }
    return [
        (dataset, channel, position, hemisphere(channel))
        for dataset, channels in montages.items()
        for position, channel in enumerate(channels)
    ]
