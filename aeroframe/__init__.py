"""Analytics over aerodynamic simulation results, written as Spark DataFrame jobs."""

from aeroframe.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
