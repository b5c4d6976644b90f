"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from sparkloom.llm import bagminhash, bpe_stream, fertility, filter_audit, fingerprint, hmm, html_extract, mixing, oracles, prefix_trie, sharding, simhash, token_count, token_store


def queries() -> dict:
    return {
        "op1_fertility": fertility.query,
        "op2_bagminhash": bagminhash.query,
        "op3_hidden_markov": hmm.query,
        "op4_token_store": token_store.query,
        "op5_html_extract": html_extract.query,
        "op6_bpe_stream": bpe_stream.query,
        "op7_pfair_mix": mixing.query,
        "op8_virtual_slots": sharding.query,
        "op9_weighted_sampling": fingerprint.query,
        "op10_token_count": token_count.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_filter_audit": filter_audit.query,
        "op13_simhash": simhash.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
