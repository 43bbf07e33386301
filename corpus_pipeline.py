"""The corpus pipeline over `documents`: its stages in order, and run(), which applies them all.

The stages are defined beside the operators that they call; nothing here runs without that subpackage. SQL cannot
express the result, which depends on a trained network and on packing.
"""

from veilspark.llm.pipeline import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
