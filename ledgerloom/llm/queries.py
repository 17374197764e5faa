"""The queries of this subpackage and the SQL that DuckDB checks them with, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.ann import op6_pruned_graph
from ledgerloom.llm.bpe import op8_backtracking_bpe
from ledgerloom.llm.chat import OP3_SQL, op3_snapshot_collapse
from ledgerloom.llm.html_text import op7_min_cut
from ledgerloom.llm.near_dups import op9_bagminhash
from ledgerloom.llm.packing import op2_bounded_space
from ledgerloom.llm.pii import op1_boosted_candidates
from ledgerloom.llm.quality import op4_divergence
from ledgerloom.llm.substring import OP10_SQL, op10_super_kmers
from ledgerloom.llm.warc import OP5_SQL, op5_boundary_chain


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_boosted_candidates": op1_boosted_candidates,
        "op2_bounded_space": op2_bounded_space,
        "op3_snapshot_collapse": op3_snapshot_collapse,
        "op4_divergence": op4_divergence,
        "op5_boundary_chain": op5_boundary_chain,
        "op6_pruned_graph": op6_pruned_graph,
        "op7_min_cut": op7_min_cut,
        "op8_backtracking_bpe": op8_backtracking_bpe,
        "op9_bagminhash": op9_bagminhash,
        "op10_super_kmers": op10_super_kmers,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_snapshot_collapse": OP3_SQL, "op5_boundary_chain": OP5_SQL, "op10_super_kmers": OP10_SQL}
