"""The registered corpus queries and the SQL that states their results, where SQL can."""

from __future__ import annotations

import importlib

#: query -> module of this package that holds it
WHERE = {
    "op1_chat_format": "chat",
    "op2_url_filter": "url_filter",
    "op3_quality_rules": "quality_rules",
    "op4_exact_dedup": "exact_dedup",
    "op5_sentencepiece": "sentencepiece_codec",
    "op6_license_scan": "license_scan",
    "op7_source_mix": "mixing",
    "op8_suffix_tree_score": "suffix_tree_lm",
    "op9_ngram_jaccard": "jaccard_join",
    "op10_language_id": "langid",
    "op11_edit_fingerprint": "edit_embedding",
    "op12_hard_negatives": "hard_negatives",
    "op13_token_alignment": "token_alignment",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in WHERE.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .chat import OP1_SQL
    from .exact_dedup import OP4_SQL
    from .hard_negatives import OP12_SQL
    from .jaccard_join import OP9_SQL

    return {"op1_chat_format": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op9_ngram_jaccard": OP9_SQL, "op12_hard_negatives": OP12_SQL}
