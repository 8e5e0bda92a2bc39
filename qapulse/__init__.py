"""Lazy PySpark analytics over question-and-answer community archives."""

from qapulse.constants import RELEASE, START

__all__ = ["RELEASE", "START"]
