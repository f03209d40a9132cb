"""The corpus pipeline of ``inkwell.llm.pipeline``, under the name by which it is run."""

from inkwell.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
