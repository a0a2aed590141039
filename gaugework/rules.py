"""Fixed values of the evidence contracts, one place for all generations."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: metrics of the current contract ------------------------
# (id, aggregation, direction, scope)
METRICS = (
    ("first_renderable_ms", "median", "lower-is-better", "interactive-workload-only"),
    ("pipeline_ttft_ms", "median", "lower-is-better", "all-workloads"),
    ("request_completion_ms", "median", "lower-is-better", "interactive-workload-only"),
    ("prefill_tokens_per_second", "median", "higher-is-better", "all-workloads"),
    ("decode_tokens_per_second", "median", "higher-is-better", "all-workloads"),
    ("peak_physical_footprint_mib", "maximum", "lower-is-better", "all-workloads"),
    (
        "decode_first_to_last_percent_change",
        "derived",
        "closer-to-zero-is-better",
        "sustained-workload-only",
    ),
)
INTERACTIVE = "power.text.short-interaction"
SUSTAINED = "power.text.sustained-generation"
# (view id, workload id, primary metric)
VIEWS = (
    ("interactive-responsiveness", INTERACTIVE, "first_renderable_ms"),
    ("sustained-generation", SUSTAINED, "decode_tokens_per_second"),
)
MINIMUM_ELIGIBLE_ATTEMPTS = 3
WARMUP_ATTEMPTS = 1
MEASURED_ATTEMPTS = 5
MAXIMUM_PROBE_EVENTS = 32
REPRODUCED_CONTRIBUTORS = 2
WEIGHTED_CONTRIBUTORS = 3
HIGH_VARIATION_PERCENT = 10.0
MAXIMUM_PACKAGES_PER_BATCH = 10

# ---- fixed values: environment admission of the current contract ----------
ADMISSION = {
    "battery_state": "unplugged",
    "minimum_battery_percent": 30,
    "low_power_mode": False,
    "start_thermal_states": ("nominal",),
    "thermal_assistance": "none",
}

# ---- fixed values: decision policy ----------------------------------------
HARD_CHECKS = (
    "structuralValidity",
    "contractConformance",
    "digestIntegrity",
    "runnerCertificate",
    "appRelease",
    "intakeState",
    "contributor",
)
MANUAL_CHECKS = ("contributor",)

# ---- fixed values: thermal states, mildest first, and attempt outcomes ----
THERMAL_ORDER = ("nominal", "fair", "serious", "critical", "unknown")
OUTCOMES = ("completed", "failed", "cancelled", "outOfMemory", "notRun")
STOP_REASONS = ("endOfSequence", "outputTokenLimit")
OUTCOME_REASONS = {
    "failed": (
        "runtime_error",
        "adapter_error",
        "model_input_error",
        "evidence_capture_error",
        "process_terminated_unclassified",
    ),
    "cancelled": ("user_cancelled", "system_cancelled"),
    "outOfMemory": ("runtime_out_of_memory", "os_memory_termination"),
    "notRun": (
        "thermal_state_critical_before_attempt",
        "prior_attempt_unrecoverable",
        "session_cancelled",
        "environment_admission_failed",
    ),
}

# ---- fixed values: evidence levels and review transitions -----------------
ACCEPTED_LEVELS = ("community-submitted", "reproduced", "verified", "maintainer-reference")
# (review type, previous level, assigned level)
REVIEW_TRANSITIONS = (
    ("initial-review", "unreviewed", "community-submitted"),
    ("reproduction-review", "community-submitted", "reproduced"),
    ("verification-review", "community-submitted", "verified"),
    ("verification-review", "reproduced", "verified"),
    ("maintainer-reference-review", "unreviewed", "maintainer-reference"),
    ("maintainer-reference-review", "community-submitted", "maintainer-reference"),
)

# ---- fixed values: response policy of the interactive workload ------------
MAXIMUM_SENTENCES = 2
CONCEPT_TERM_GROUPS = (
    ("safe", "safely", "secure", "securely", "saved", "stored", "kept", "preserved"),
    ("device", "iphone", "phone", "local", "locally"),
    (
        "sync",
        "syncs",
        "synchronization",
        "synchronize",
        "synchronizes",
        "upload",
        "uploads",
    ),
    (
        "connect",
        "connected",
        "connection",
        "connectivity",
        "reconnect",
        "reconnected",
        "network",
        "online",
    ),
    ("after", "once", "resume", "resumes", "return", "returns", "when"),
)
CONTRADICTION_PHRASES = (
    "cannot sync when connectivity returns",
    "never sync when connectivity returns",
    "note is lost",
    "note was deleted",
    "not saved",
    "not stored",
    "will not sync",
    "won't sync",
)

# ---- fixed values: white space of the renderability rules -----------------
WHITE_SPACE = (
    r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SEPARATOR_CONTROLS = r"\x{1C}-\x{1F}"


@dataclass(frozen=True)
class RuleSet:
    """Where the evidence generations differ."""

    median_minimum: int
    strict_token_times: bool
    tolerance: float
    degradation: str
    minimum_battery_percent: int
    space_includes_separator_controls: bool


PILOT = RuleSet(1, True, 1e-6, "first-last-completed", 50, False)
RELEASE_ONE = RuleSet(3, False, 1e-9, "attempt-one-and-five", 50, False)
CURRENT = RuleSet(3, False, 1e-9, "first-last-eligible", 30, True)
GENERATIONS = {"pilot": PILOT, "release-1": RELEASE_ONE, "current": CURRENT}
