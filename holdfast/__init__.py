"""Next-best-action analytics as lazy Spark DataFrame operators."""

from holdfast.config import SETTINGS, Settings
from holdfast.session import make_session, tune

__all__ = ["SETTINGS", "Settings", "make_session", "tune"]
