"""Training-data operators: one module per operator, each with a general
function on DataFrames and a thin registered query ``opN_<name>``.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when the folder is present."""

from __future__ import annotations

from panelkit.llm.common import ORACLES, QUERIES


def load_all() -> tuple[dict, dict]:
    """Import every operator module; return (queries, oracles)."""
    from panelkit.llm import (  # noqa: F401
        bpe_prefix,
        decontaminate,
        exact_dedup,
        hash_tree,
        license_rules,
        quality_ordinal,
        secret_markov,
        simhash_bk,
        source_divergence,
        token_counts,
        toxicity_ordinal,
        turn_repair,
        warc_salvage,
    )

    return QUERIES, ORACLES
