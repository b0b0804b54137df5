"""The corpus pipeline: (name, function) of its stages, and a run of all of them over the documents table."""

from tidemark.llm.pipeline import ORACLE_SQL, QUERIES, STAGES, run

__all__ = ["ORACLE_SQL", "QUERIES", "STAGES", "run"]
