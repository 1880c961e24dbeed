"""Decision constants in one place."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Canon:
    as_of: date = date(2024, 1, 30)
    timezone: str = "Asia/Kolkata"
    currency: str = "INR"
    # Window lengths in days and purchase floors by window.
    windows: tuple[int, ...] = (7, 14, 28, 56)
    floors: tuple[int, ...] = (12, 20, 30, 45)
    z: float = 1.645
    target_roas: float = 0.5
    max_change_percent: float = 20.0
    learning_conversions: int = 50
    learning_days: int = 7
    material_change_percent: float = 20.0
    calibration_width: float = 0.1
    calibration_min_n: int = 10
    hamming_limit: int = 10
    rolling_days: int = 14
    order_window_days: int = 60


CANON = Canon()
#: Minor-unit exponents other than 2.
EXPONENTS = {"JPY": 0, "KRW": 0, "VND": 0, "CLP": 0, "BHD": 3, "KWD": 3, "OMR": 3, "JOD": 3, "TND": 3}
