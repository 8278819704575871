"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from dnsloom.llm import ann, decontam, embdedup, jaccard, lexsearch, licenses, mixing, quality, secrets, spelling, substring, suffixdedup, tokens


def queries() -> dict:
    return {
        "op1_nearest_neighbours": ann.op1_nearest_neighbours,
        "op2_quality": quality.op2_quality,
        "op3_suffix_dedup": suffixdedup.op3_suffix_dedup,
        "op4_secrets": secrets.op4_secrets,
        "op5_mixing": mixing.op5_mixing,
        "op6_token_output": tokens.op6_token_output,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_licenses": licenses.op8_licenses,
        "op9_substring_dedup": substring.op9_substring_dedup,
        "op10_jaccard_join": jaccard.op10_jaccard_join,
        "op11_lexical_search": lexsearch.op11_lexical_search,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_embedding_dedup": embdedup.op13_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest_neighbours": ann.OP1_SQL,
        "op4_secrets": secrets.OP4_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op7_decontamination": decontam.OP7_SQL,
        "op9_substring_dedup": substring.OP9_SQL,
        "op10_jaccard_join": jaccard.OP10_SQL,
        "op11_lexical_search": lexsearch.OP11_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
        "op13_embedding_dedup": embdedup.OP13_SQL,
    }
