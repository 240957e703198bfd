"""Profile knobs as constant lookup expressions: three profiles, so no join is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linesieve.functions import patterns as P

STRICT, SAFE, MAX = "strict", "safe", "max"
PROFILES = [STRICT, SAFE, MAX]


def knob(name: str, profile="profile") -> Column:
    """Value of one knob for the row's profile; profiles without their own value use ``max``."""
    profile = F.col(profile) if isinstance(profile, str) else profile
    values = P.KNOBS[name]
    return F.when(profile == SAFE, F.lit(values[SAFE])).otherwise(F.lit(values[MAX]))
