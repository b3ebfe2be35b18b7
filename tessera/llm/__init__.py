"""Operators for training-data pipelines, apart from the rest of the library.

``queries()`` and ``oracle_sql()`` list them for the driver.  Nothing outside
this subpackage imports it.
"""


def queries() -> dict:
    from . import bilinear, bpe, chat, mixing, mpeg, quality, repeats, rindex, simhash, toxicity

    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_lm_score": bilinear.op2_lm_score,
        "op3_suffix_array_dedup": rindex.op3_suffix_array_dedup,
        "op4_chat_format": chat.op4_chat_format,
        "op5_substring_dedup": repeats.op5_substring_dedup,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_mixing": mixing.op7_mixing,
        "op8_mpeg_audio": mpeg.op8_mpeg_audio,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    from . import chat, quality, repeats

    return {"op4_chat_format": chat.OP4_SQL, "op5_substring_dedup": repeats.OP5_SQL, "op6_quality_rules": quality.OP6_SQL}
