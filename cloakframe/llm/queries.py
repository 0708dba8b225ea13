"""The queries of this subpackage and, where SQL can express them, the SQL for their results."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, lang_id, line_dedup, mixing, rans, sharding, simhash, warc


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op1_line_dedup_single": line_dedup.op1_line_dedup_single,
        "op2_bpe": bpe.op2_bpe,
        "op3_nearest_neighbours": ann.op3_nearest_neighbours,
        "op4_sharding": sharding.op4_sharding,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_language_id": lang_id.op6_language_id,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_files": rans.op8_token_files,
        "op9_warc": warc.op9_warc,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op1_line_dedup_single": line_dedup.SINGLE_ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op9_warc": warc.ORACLE,
    }
