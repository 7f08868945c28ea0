"""tablematch: compare a source table with a target table on Spark."""

from tablematch.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
