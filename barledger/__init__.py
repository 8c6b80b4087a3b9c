"""Bars, rule states and evidence as Spark DataFrame operators."""

from barledger.session import build_session, checkpoint_root, materialise

__all__ = ["build_session", "checkpoint_root", "materialise"]
