"""From raw documents to packed training sequences: the stages of ``tessera.llm.pipeline``."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
