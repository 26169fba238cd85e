"""Build parameters and ladder overrides from TOML; a missing or unknown key is an error."""

from __future__ import annotations

import dataclasses
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclasses.dataclass(frozen=True)
class Params:
    """Of the surface: search radius (m), barrier and gradient of the first pass, memory (MB), smoothing, contour step."""

    radius_m: float
    barrier: int
    grad_min: float
    max_mem_mb: int
    smooth: int
    contour_step: float

    @classmethod
    def load(cls, path: str | Path) -> Params:
        given = tomllib.loads(Path(path).read_text())
        names = [f.name for f in dataclasses.fields(cls)]
        if wrong := sorted(set(names) ^ set(given)):
            raise KeyError(f"missing or unknown: {', '.join(wrong)}")
        return cls(**{f.name: {"float": float, "int": int}[f.type](given[f.name]) for f in dataclasses.fields(cls)})


def ladder_overrides(spark: SparkSession, path: str | Path) -> DataFrame:
    """square, interval, phase of tables [N00E000] with interval and, if not 0, phase."""
    rows = [(k, float(v["interval"]), float(v.get("phase", 0))) for k, v in tomllib.loads(Path(path).read_text()).items()]
    return spark.createDataFrame(rows, "square string, interval double, phase double")
