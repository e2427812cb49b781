"""Declarative descriptions of series, phase rules, features and training."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values of the epidemic-phase domain.
GROWING, STABLE, DECLINING, CONTAINED = "Growing", "Stable/Peak", "Declining", "Contained"
PHASE_ORDER = (GROWING, STABLE, DECLINING, CONTAINED)
PHASES = tuple(sorted(PHASE_ORDER))

# Populations of the three countries with a curve.
POPULATIONS = {"Guinea": 12_000_000, "Liberia": 4_500_000, "Sierra Leone": 7_000_000}

# Model names, their kinds and the display order of the metric table.
MODEL_KINDS = {
    "SEIR": "Mechanistic",
    "Random Forest": "Machine Learning",
    "Gradient Boosting": "Machine Learning",
    "Logistic Regression": "Machine Learning",
    "MLP": "Deep Learning",
}
SUBSET_SUFFIX = "TOP-3"
MODEL_ORDER = ("SEIR", "SEIR (TOP-3)", "Random Forest", "Gradient Boosting", "Logistic Regression", "MLP")

# Column names of the single-country daily report and their short forms.
DETAILED_REPORT_COLUMNS = {
    "Cumulative_Confirmed_Cases": "cum_cases",
    "Cumulative_Confirmed_Deaths": "cum_deaths",
    "Survivors": "survivors",
    "Probable_Cases": "probable",
    "Suspected_cases": "suspected",
    "In_Treatment_Centers": "in_treatment",
}


def new_name(cumulative: str) -> str:
    """``cum_cases`` -> ``new_cases``."""
    return "new_" + cumulative.removeprefix("cum_")


@dataclass(frozen=True)
class SeriesSpec:
    """How a table of cumulative reports is read as keyed time series.

    keys           columns that identify one series
    time           report time at a calendar grain (a date, or a timestamp truncated to the hour),
                   so that a de-duplicated series is no longer than its calendar
    bucket         rollup grain: 'week' (Monday start) or 'day'
    cumulative     monotone counters; each yields an increment column
    gauges         levels that are carried by their last value
    clip_negative  counters whose negative increments become 0
    fill           'zero' treats a missing counter as 0 before differencing,
                   'carry' repeats the last known value
    gaps           'skip' keeps observed buckets only, 'fill' inserts the missing ones
    grain          what report times are cut to first: 'hour', 'day' or another calendar unit;
                   None takes them as they are
    """

    keys: tuple[str, ...] = ("country",)
    time: str = "date"
    bucket: str = "week"
    cumulative: tuple[str, ...] = ("cum_cases", "cum_deaths")
    gauges: tuple[str, ...] = ()
    clip_negative: tuple[str, ...] = ("cum_cases",)
    fill: str = "zero"
    gaps: str = "skip"
    grain: str | None = None

    def __post_init__(self):
        if not self.keys:
            raise ValueError("a series needs at least one key column; add a constant one")
        if self.bucket not in ("week", "day"):
            raise ValueError(f"unknown bucket {self.bucket!r}")
        if self.fill not in ("zero", "carry"):
            raise ValueError(f"unknown fill {self.fill!r}")
        if self.gaps not in ("skip", "fill"):
            raise ValueError(f"unknown gaps {self.gaps!r}")

    @property
    def bucket_days(self) -> int:
        return 7 if self.bucket == "week" else 1

    @property
    def increments(self) -> tuple[str, ...]:
        return tuple(new_name(c) for c in self.cumulative)

    def with_(self, **changes) -> "SeriesSpec":
        return replace(self, **changes)


MULTI_COUNTRY = SeriesSpec()
SINGLE_COUNTRY = SeriesSpec(
    gauges=("survivors", "probable", "suspected", "in_treatment"),
    clip_negative=("cum_cases", "cum_deaths"),
)


@dataclass(frozen=True)
class PhaseRule:
    """Thresholds of the past-against-future moving-average rule."""

    floor: float = 2.0
    up: float = 1.25
    down: float = 0.75
    past_rows: int = 3
    future_rows: int = 3


# Display labels of the features.
LABELS = {
    "country_enc": "Country (encoded)",
    "days_into_epidemic": "Days since outbreak start",
    "new_cases_lag1": "New cases (lag 1 {unit})",
    "new_cases_lag2": "New cases (lag 2 {unit})",
    "new_cases_lag3": "New cases (lag 3 {unit})",
    "new_deaths_lag1": "New deaths (lag 1 {unit})",
    "new_deaths_lag2": "New deaths (lag 2 {unit})",
    "new_deaths_lag3": "New deaths (lag 3 {unit})",
    "cases_3w_avg": "{n}-week avg cases",
    "deaths_3w_avg": "{n}-week avg deaths",
    "case_growth_rate": "Case growth rate",
    "death_growth_rate": "Death growth rate",
    "cum_cases_lag1": "Cumulative cases (lag 1 {unit})",
    "cum_deaths_lag1": "Cumulative deaths (lag 1 {unit})",
    "survivors_lag1": "Survivors (lag 1 {unit})",
    "in_treatment_lag1": "In treatment (lag 1 {unit})",
}


@dataclass(frozen=True)
class FeatureSpec:
    """Lag and average features built from past buckets only."""

    lags: tuple[int, ...] = (1, 2, 3)
    mean_rows: int = 3
    growth_limit: float = 5.0
    level_lags: tuple[str, ...] = ("cum_cases", "cum_deaths")
    encode_key: bool = True

    def columns(self) -> list[str]:
        cols = ["country_enc"] if self.encode_key else []
        cols += ["days_into_epidemic"]
        cols += [f"new_cases_lag{k}" for k in self.lags]
        cols += [f"new_deaths_lag{k}" for k in self.lags]
        cols += [f"cases_{self.mean_rows}w_avg", f"deaths_{self.mean_rows}w_avg"]
        cols += ["case_growth_rate", "death_growth_rate"]
        cols += [f"{c}_lag1" for c in self.level_lags]
        return cols

    def labels(self, unit: str = "wk") -> dict[str, str]:
        """Feature column -> display label; ``unit`` names the bucket of a lag."""
        return {c: LABELS.get(c, c).format(n=self.mean_rows, unit=unit) for c in self.columns()}


MULTI_COUNTRY_FEATURES = FeatureSpec()
SINGLE_COUNTRY_FEATURES = FeatureSpec(
    level_lags=("cum_cases", "cum_deaths", "survivors", "in_treatment"), encode_key=False
)


@dataclass(frozen=True)
class ModelSettings:
    """Training settings of the four classifiers."""

    rf_trees: int = 300
    rf_depth: int = 8
    gbt_rounds: int = 200
    gbt_depth: int = 4
    gbt_rate: float = 0.05
    lr_c: float = 1.0
    lr_iterations: int = 1000
    mlp_hidden: tuple[int, ...] = (128, 64, 32)
    mlp_iterations: int = 200
    validation: float = 0.15
    seed: int = 42
    loss_steps: tuple[int, ...] = field(default=(1, 2, 5, 10, 20, 50, 100, 200))
