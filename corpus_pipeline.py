"""The pipeline from raw documents to packed sequences; its stages are in recurscan.llm.pipeline."""

from recurscan.llm.pipeline import ORACLE_SQL, STAGES, oracle_sql, queries, run

__all__ = ["ORACLE_SQL", "STAGES", "oracle_sql", "queries", "run"]
