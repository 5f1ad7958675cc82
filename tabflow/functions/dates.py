"""Calendar parts of ``dd/MM/yy HH`` sensor timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SENSOR_FORMAT = "dd/MM/yy HH"
# Raw ranges of the parts, for the optional full-period scaling.
PERIODS = {"time": 24, "day": 31, "month": 12}


def datetime_parts(c: Column, fmt: str = SENSOR_FORMAT) -> dict[str, Column]:
    """Hour (``time``), day and month as integers; NULL when the text does not parse."""
    ts = F.try_to_timestamp(c, F.lit(fmt))
    return {"time": F.hour(ts), "day": F.dayofmonth(ts), "month": F.month(ts)}


def datetime_cyclic(c: Column, fmt: str = SENSOR_FORMAT, scaled: bool = False) -> dict[str, Column]:
    """Sine and cosine of each part.

    The raw integer is the angle in radians. ``scaled=True`` maps the part's period to a full
    circle instead.
    """
    out = {}
    for name, part in datetime_parts(c, fmt).items():
        angle = part.cast("double")
        if scaled:
            angle = angle * F.lit(2 * math.pi / PERIODS[name])
        out[f"{name}_sine"] = F.sin(angle)
        out[f"{name}_cosine"] = F.cos(angle)
    return out
