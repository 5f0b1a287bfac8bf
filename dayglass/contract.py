"""The feature contract: column names, raw log schemas, column roles, parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names, order and roles of the fifteen features.
LOGON_FEATURES = (
    "total_event_buckets",
    "off_hours_ratio",
    "unique_systems_accessed",
    "failed_login_ratio",
    "active_orphan_sessions",
)
HTTP_FEATURES = (
    "url_visits",
    "upload_event_count",
    "keyword_match_indicator",
    "unique_external_domains",
    "after_hours_browsing",
)
EMAIL_FEATURES = (
    "emails_sent",
    "external_recipients",
    "after_hours_emails",
    "attachments_sent",
    "large_attachment_count",
)
FEATURES = LOGON_FEATURES + HTTP_FEATURES + EMAIL_FEATURES

SOURCES = {"logon": LOGON_FEATURES, "http": HTTP_FEATURES, "email": EMAIL_FEATURES}

# Unknown (null) rather than zero when their source is silent for a user-day.
UNKNOWN_IF_SILENT = {
    "off_hours_ratio": "logon",
    "failed_login_ratio": "logon",
    "after_hours_browsing": "http",
    "after_hours_emails": "email",
    "external_recipients": "email",
}

KEY = ("user", "activity_date")

STATUS_COLUMNS = (
    "data_quality_risk",
    "mad_critical_flag",
    "iso_forest_flag",
    "confirmed_threat",
    "high_risk_review",
    "telemetry_gap_flag",
)
ALERT_COLUMNS = ("confirmed_threat", "high_risk_review", "telemetry_gap_flag")

EVENT_TIME_FORMAT = "M/d/yyyy H:mm:ss"  # also reads zero-padded fields
SYSTEM_ACCOUNT = "SYSTEM"


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LOGON_LOG = _strings("id", "date", "user", "pc", "activity")
HTTP_LOG = _strings("id", "date", "user", "url", "pc", "activity")
EMAIL_LOG = _strings(
    "id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachment_count", "content"
)
# Assumed: the survey names these logs, but not their columns.
DEVICE_LOG = _strings("id", "date", "user", "pc", "activity")
FILE_LOG = _strings("id", "date", "user", "pc", "filename", "content")


@dataclass(frozen=True)
class Params:
    """Detector settings; the defaults are the fixed values of the method."""

    mad_threshold: float = 3.5
    missing_data_tolerance: float = 0.18
    iso_flag_percentile: float = 1.0
    mad_flag_percentile: float = 90.0
    critical_flag_ratio: float | None = None  # set: wins over the fitted value
    contamination: float | None = 0.02  # None: offset -0.5, the "auto" convention
    min_history_days: int = 5
    min_active_ratios: int = 30
    default_critical_ratio: float = 0.15
    trees: int = 200
    subsample: int = 256
    seed: int = 42
    mad_scale: str = "normal"  # or "raw"
    route_on: str = "history"  # or "live": rows of the user in the scored batch
    features: tuple[str, ...] | None = FEATURES  # None: fit takes all numeric columns

    def __post_init__(self) -> None:
        if self.features is not None:
            object.__setattr__(self, "features", tuple(self.features))  # a list when read from JSON
            taken = {*KEY, *[c.removesuffix("_flag") for c in STATUS_COLUMNS]}
            wrong = [f for f in self.features if not f.isidentifier() or f.lower() in taken]
            if wrong or not self.features or len({f.lower() for f in self.features}) < len(self.features):
                raise ValueError(f"features must be different plain names beside the key, not {self.features}")
        if self.mad_scale not in ("normal", "raw"):
            raise ValueError(f"mad_scale must be 'normal' or 'raw', not {self.mad_scale!r}")
        if self.route_on not in ("history", "live"):
            raise ValueError(f"route_on must be 'history' or 'live', not {self.route_on!r}")


# The grids of the what-if tables.
RATIO_GRID = (0.01, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.50)
TOLERANCE_GRID = (0.05, 0.10, 0.15, 0.18, 0.20, 0.25, 0.30)
SCORE_PERCENTILE_GRID = (1, 2, 5, 10, 20, 50)
