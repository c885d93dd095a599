"""Every registered query of the engine, with its DuckDB SQL beside it."""

from __future__ import annotations

from stemma.plans import chains, domain, families, graphs
from stemma.plans.registry import ORACLES, QUERIES

hmm_log_marginal = chains.hmm_log_marginal

__all__ = ["ORACLES", "QUERIES", "chains", "domain", "families", "graphs", "hmm_log_marginal"]
