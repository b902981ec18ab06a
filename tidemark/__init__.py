"""tidemark: PySpark operators for populations of continuously observed entities."""

from tidemark.config import RuleConfig
from tidemark.session import build_session, tune

__all__ = ["RuleConfig", "build_session", "tune"]
