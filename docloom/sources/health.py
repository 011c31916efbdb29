"""What a run has to work with: packages, settings, manifest, paths."""

from __future__ import annotations

import importlib
import os
from dataclasses import asdict

from pyspark.sql import SparkSession

from docloom.config import SETTINGS, Settings

from . import manifest


def check(spark: SparkSession, manifest_path: str, folders: dict[str, str] | None = None, settings: Settings = SETTINGS, key_name: str = "DOCLOOM_API_KEY") -> dict:
    """Findings as data; ``ok`` is False if the manifest cannot be used. A key's value is never shown."""
    versions = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            versions[name] = importlib.import_module(name).__version__
        except ImportError:
            versions[name] = None
    found = {
        "versions": versions,
        "settings": asdict(settings),
        "key_present": bool(os.environ.get(key_name)),
        "folders": {k: os.path.exists(v) for k, v in (folders or {}).items()},
    }
    try:
        rows = manifest.load(spark, manifest_path)
        found["by_scheme"] = {r["scheme"]: r["n"] for r in manifest.counts_by_scheme(rows).collect()}
        return found | {"ok": True}
    except Exception as e:  # any failure of the manifest is a finding
        return found | {"ok": False, "error": str(e)}
