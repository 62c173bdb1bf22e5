"""basketry: retail order analytics as composable Spark DataFrame functions."""

from basketry.config import Settings

__all__ = ["Settings"]
