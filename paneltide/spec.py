"""What a panel looks like: keys, time, value column and column roles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Column roles of a daily weather snapshot feed, after header
# normalisation, and the physical range each reading must fall in.
METRICS = (
    "temperature_celsius",
    "feels_like_celsius",
    "wind_kph",
    "wind_degree",
    "pressure_mb",
    "precip_mm",
    "humidity",
    "cloud",
    "visibility_km",
    "uv_index",
    "gust_kph",
)
CONCENTRATIONS = (
    "air_quality_carbon_monoxide",
    "air_quality_ozone",
    "air_quality_nitrogen_dioxide",
    "air_quality_sulphur_dioxide",
    "air_quality_pm2_5",
    "air_quality_pm10",
)
INDICES = ("air_quality_us_epa_index", "air_quality_gb_defra_index")
CATEGORICAL = (
    "country",
    "location_name",
    "timezone",
    "condition_text",
    "wind_direction",
    "moon_phase",
)
IMPERIAL_TWINS = (
    "temperature_fahrenheit",
    "feels_like_fahrenheit",
    "wind_mph",
    "pressure_in",
    "precip_in",
    "visibility_miles",
    "gust_mph",
)
REDUNDANT = ("last_updated_epoch",)
LEAKY = ("temperature_fahrenheit", "feels_like_celsius", "feels_like_fahrenheit")
LAGGED_EXOGENOUS = ("humidity", "pressure_mb", "cloud", "wind_kph", "precip_mm")
BOUNDS = {
    "temperature_celsius": (-90.0, 60.0),
    "feels_like_celsius": (-95.0, 75.0),
    "humidity": (0.0, 100.0),
    "cloud": (0.0, 100.0),
    "wind_degree": (0.0, 360.0),
    "wind_kph": (0.0, 500.0),
    "gust_kph": (0.0, 600.0),
    "pressure_mb": (850.0, 1090.0),
    "precip_mm": (0.0, 2000.0),
    "uv_index": (0.0, 20.0),
    "visibility_km": (0.0, 100.0),
}

# Modelling defaults.
LAGS = (1, 2, 3, 7, 14)
WINDOWS = (3, 7, 14)
HORIZON = 7
SEASON = 7
FOLDS = 4
MIN_TRAIN_DAYS = 60
Z_THRESHOLD = 3.5
MAD_SCALE = 0.6745
CONTAMINATION = 0.01


@dataclass(frozen=True)
class PanelSpec:
    """Names the columns an operator works on; every operator takes one."""

    keys: tuple[str, ...] = ("country", "location_name")
    time: str = "last_updated"
    value: str = "temperature_celsius"
    # Total order among rows of one (keys, time); without it ties fall back to
    # all remaining columns.
    order: tuple[str, ...] = ()
    # Whether ``order`` tells any two rows of one (keys, time) apart; readers of few columns then skip the rest.
    total: bool = False
    country: str = "country"
    latitude: str = "latitude"
    longitude: str = "longitude"
    metrics: tuple[str, ...] = METRICS
    concentrations: tuple[str, ...] = CONCENTRATIONS
    indices: tuple[str, ...] = INDICES
    categorical: tuple[str, ...] = CATEGORICAL
    structural_zero: tuple[str, ...] = ("precip_mm",)
    exogenous: tuple[str, ...] = LAGGED_EXOGENOUS
    leaky: tuple[str, ...] = LEAKY
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(BOUNDS))

    @property
    def grain(self) -> list[str]:
        return [*self.keys, self.time]

    @property
    def pollutants(self) -> tuple[str, ...]:
        return self.concentrations + self.indices

    def but(self, **changes) -> PanelSpec:
        return replace(self, **changes)


WEATHER = PanelSpec()


def present(df, columns) -> list[str]:
    """The given columns that exist in ``df``, in the given order."""
    have = set(df.columns)
    return [c for c in columns if c in have]
