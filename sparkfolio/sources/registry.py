"""Configuration: sources to read, targets, settings."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

SOURCE = "name STRING, base_url STRING, list_url STRING, level STRING, method STRING, interval_sec DOUBLE, daily_max INT, enabled BOOLEAN"


def enabled_sources(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Sources that are switched on; whole numbers will do where fractions are expected."""
    kinds = {name: {"DOUBLE": float, "INT": int, "BOOLEAN": bool}.get(kind, str) for name, kind in (x.split() for x in SOURCE.split(", "))}
    row = lambda e: tuple(None if e.get(n) is None else kind(e[n]) for n, kind in kinds.items())
    return spark.createDataFrame([row(e) for e in entries if e.get("enabled", True)], SOURCE)


def targets(entries: list[dict], only: str = "") -> list[dict]:
    return [e for e in entries if only in e["title"]]


@dataclass(frozen=True)
class Settings:
    page_size: int = 10
    history: int = 40
    interval_sec: float = 5.0
    daily_max: int = 500

    @classmethod
    def load(cls, path: str) -> Settings:
        """Known keys of a JSON file; a missing or broken file gives the defaults."""
        try:
            with open(path, encoding="utf-8") as f:
                said = json.load(f)
            return cls(**{k: v for k, v in said.items() if k in {x.name for x in fields(cls)}})
        except (OSError, ValueError, AttributeError):
            return cls()

    def save(self, path: str) -> None:
        """Replace the file as a whole."""
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as f:
            json.dump(asdict(self), f, ensure_ascii=False)
        os.replace(f.name, path)
