"""Every query of the library (the corpus operators add theirs in __spark_entry__)."""

from __future__ import annotations

from braidwork.plans import design_queries, file_queries, graph_queries, log_queries, sequence_queries, study_queries, vector_queries

PARTS = (graph_queries, vector_queries, log_queries, sequence_queries, design_queries, study_queries, file_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
