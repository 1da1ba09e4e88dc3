"""Queries and oracle SQL of the corpus operators."""

from . import chat, decontaminate, fingerprints, jaccard, mixing, nearest, periods, pii, quality, repair, substrings, tokens


def queries() -> dict:
    return {
        "op1_simhash": fingerprints.op1,
        "op2_ngram_jaccard": jaccard.op2,
        "op3_pii_surrogates": pii.op3,
        "op4_repeated_substrings": substrings.op4,
        "op5_pareto_mix": mixing.op5,
        "op6_decontamination": decontaminate.op6,
        "op7_token_counts": tokens.op7,
        "op8_token_ids": tokens.op8,
        "op9_chat_format": chat.op9,
        "op10_quality": quality.op10,
        "op11_conversation_repair": repair.op11,
        "op12_periodic_runs": periods.op12,
        "op13_nearest": nearest.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_pareto_mix": mixing.ORACLE, "op9_chat_format": chat.ORACLE, "op11_conversation_repair": repair.ORACLE}
