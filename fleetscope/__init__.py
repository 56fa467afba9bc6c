"""fleetscope: endpoint-telemetry analytics for whole fleets, on Spark DataFrames and streams."""

from fleetscope.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
__version__ = "0.1.0"
