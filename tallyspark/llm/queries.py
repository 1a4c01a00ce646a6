"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (decontaminate, embedding_dedup, mixing, near_dedup, periodic_runs, prefix_trie, quality, sanitise, secrets, suffix_dedup, token_files,
               url_filter, warc)


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_quality": quality.op2_quality,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_mix": mixing.op4_mix,
        "op5_tokens": token_files.op5_tokens,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_warc": warc.op7_warc,
        "op8_vectors": embedding_dedup.op8_vectors,
        "op9_secrets": secrets.op9_secrets,
        "op10_urls": url_filter.op10_urls,
        "op11_private": sanitise.op11_private,
        "op12_runs": periodic_runs.op12_runs,
        "op13_trie": prefix_trie.op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mix": mixing.OP4_SQL, "op7_warc": warc.OP7_SQL, "op8_vectors": embedding_dedup.OP8_SQL,
            "op11_private": sanitise.OP11_SQL, "op13_trie": prefix_trie.OP13_SQL}
