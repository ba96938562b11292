"""Agent-traffic security analytics as Spark DataFrame operators."""

from tracewarden.session import build_session

__all__ = ["build_session"]
