"""The corpus pipeline: language ID, toxicity, near-duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from colforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
