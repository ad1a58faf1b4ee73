"""What most programs need: ``from stridemill.prelude import *``."""

from .errors import EngineError, InvalidParameter, LengthMismatch, OutOfBounds, StartFailed, UnsupportedPlatform
from .operators.edits import Edit, edited
from .operators.fold import fold_python, fold_total, fold_with_scratch
from .operators.iterate import iterate
from .operators.quantiles import kth, quantiles, ranks_of
from .operators.scans import Scan, cost_slices, numbered, scan, scan_python
from .operators.sharded import ShardedVector
from .operators.temporal import asof_join, interval_counts, interval_join
from .operators.vector import PositionalVector
from .plans.schedule import Dynamic, Schedule, Static, Weighted
from .runtime import Action, discard, scratch, session, started, stored_as, terminate
from .sources.frame import KEY, IndexedFrame

__all__ = [
    "KEY", "Action", "Dynamic", "Edit", "EngineError", "IndexedFrame", "InvalidParameter", "LengthMismatch", "OutOfBounds", "PositionalVector", "Scan", "Schedule", "ShardedVector",
    "StartFailed", "Static", "UnsupportedPlatform", "Weighted", "asof_join", "cost_slices", "discard", "edited", "fold_python", "fold_total", "fold_with_scratch", "interval_counts",
    "interval_join", "iterate", "kth", "numbered", "quantiles", "ranks_of", "scan", "scan_python", "scratch", "session", "started", "stored_as", "terminate",
]
