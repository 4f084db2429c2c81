"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, licenses, line_dedup, packing, prefix_trie, quality_rules, secrets, simhash, spelling, substring_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_secrets": secrets.op2_secrets,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_warc": warc.op7_warc,
        "op8_packing": packing.op8_packing,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_simhash": simhash.op10_simhash,
        "op11_bpe": bpe.op11_bpe,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": secrets.SQL,
        "op4_line_dedup": line_dedup.SQL,
        "op5_substring_dedup": substring_dedup.SQL,
        "op6_quality_rules": quality_rules.SQL,
        "op7_warc": warc.SQL,
        "op9_decontaminate": decontaminate.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
        "op13_spelling": spelling.SQL,
    }
