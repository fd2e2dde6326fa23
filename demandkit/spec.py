"""Schema-level configuration: column roles, feature settings, validation.

Nothing here touches data; these are pure functions over column names and
arguments, evaluated on the driver before a plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Default column names of a sales fact and its measures.
DEFAULT_DATE = "DATE"
DEFAULT_CENTER = "CENTER NAME"
DEFAULT_ITEM = "ITEM"
DEFAULT_TARGET = "PAY WEIGHT"
NUMERIC_COLUMNS = ("BOX", "NET", "ICE/WATER", "PAY WEIGHT", "RATE", "AMOUNT")
CATEGORICAL_COLUMNS = ("VEHICLE NO", "CENTER NAME", "PARTY NAME", "ITEM")
UNKNOWN = "Unknown"

# Keywords used to find column roles in an uploaded table
# (lower-cased substring match, first matching column wins).
ROLE_KEYWORDS = {
    "date": ("date", "time"),
    "center": ("center", "location", "store"),
    "item": ("item", "product", "fish"),
    "target": ("weight", "quantity", "demand", "qty"),
}

# Labels used when an uploaded table lacks a role.
ALL_LOCATIONS = "All Locations"
ALL_PRODUCTS = "All Products"


@dataclass(frozen=True)
class PanelSpec:
    """Names of the columns that play each role in a sales fact.

    ``measures`` lists the extra columns carried into the daily aggregate
    with their aggregation: ``"sum"`` measures are filled with 0 on days
    without sales, ``"mean"`` measures with the mean of observed daily
    values.
    """

    date: str = DEFAULT_DATE
    center: str = DEFAULT_CENTER
    item: str = DEFAULT_ITEM
    target: str = DEFAULT_TARGET
    measures: tuple[tuple[str, str], ...] = (("AMOUNT", "sum"), ("RATE", "mean"), ("BOX", "sum"))

    @property
    def keys(self) -> tuple[str, str]:
        return (self.center, self.item)

    @property
    def grain(self) -> tuple[str, str, str]:
        return (self.date, self.center, self.item)

    @property
    def required(self) -> tuple[str, str, str, str]:
        return (self.date, self.center, self.item, self.target)

    @property
    def measure_names(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.measures)

    def with_measures(self, measures) -> "PanelSpec":
        return replace(self, measures=tuple(measures))


@dataclass(frozen=True)
class FeatureConfig:
    """Feature settings (lags, rolling windows, cyclical terms).

    ``exclude_current`` shifts rolling frames to end at the previous row,
    removing the target leakage of the default (current row included).
    """

    lags: tuple[int, ...] = (1, 3, 7)
    windows: tuple[int, ...] = (7, 14)
    seasonal: bool = True
    exclude_current: bool = False
    stats: tuple[str, ...] = field(default=("mean", "std", "min", "max"))

    def __post_init__(self):
        if any(k < 1 for k in self.lags):
            raise ValueError(f"lags must be >= 1, got {self.lags}")
        if any(w < 1 for w in self.windows):
            raise ValueError(f"windows must be >= 1, got {self.windows}")
        unknown = set(self.stats) - {"mean", "std", "min", "max"}
        if unknown:
            raise ValueError(f"unknown rolling statistics: {sorted(unknown)}")


def require_columns(columns, required) -> None:
    """Raise ``KeyError`` naming every required column that is absent."""
    present = set(columns)
    missing = [c for c in required if c not in present]
    if missing:
        raise KeyError(f"the table lacks {missing}, needed for its series and target")


def detect_roles(columns) -> dict[str, str | None]:
    """Map roles to the first column whose lower-cased name holds a keyword."""
    roles: dict[str, str | None] = {}
    for role, words in ROLE_KEYWORDS.items():
        roles[role] = next((c for c in columns if any(w in c.lower() for w in words)), None)
    return roles


def validate_horizon(days: int | None = None, months: int | None = None) -> None:
    """Reject forecast horizons outside 1..365 days or 1..24 months."""
    if days is not None and not 1 <= days <= 365:
        raise ValueError(f"forecast horizon must be within 1..365 days, got {days}")
    if months is not None and not 1 <= months <= 24:
        raise ValueError(f"forecast horizon must be within 1..24 months, got {months}")


def validate_model(name: str, available) -> None:
    if name not in available:
        raise ValueError(f"no model called {name!r}; there are {sorted(available)}")


def feature_columns(columns, spec: PanelSpec) -> list[str]:
    """All columns except the date, the two series keys and the target."""
    excluded = set(spec.required)
    return [c for c in columns if c not in excluded]
