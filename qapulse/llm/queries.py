"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from qapulse.llm import bits, divergence, lexical, revisits
from qapulse.llm.bits import op1_top_k
from qapulse.llm.debruijn import op4_substring_dedup
from qapulse.llm.decontam import op6_decontaminate
from qapulse.llm.divergence import op11_source_divergence
from qapulse.llm.language import op2_language
from qapulse.llm.lexical import op13_lexical_search
from qapulse.llm.packing import op9_packing
from qapulse.llm.probminhash import op8_near_duplicates
from qapulse.llm.revisits import op3_revisits
from qapulse.llm.secrets import op7_secrets
from qapulse.llm.suffixes import op5_suffix_dedup
from qapulse.llm.tokens_orc import op10_tokens_orc
from qapulse.llm.urls import op12_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k,
        op2_language,
        op3_revisits,
        op4_substring_dedup,
        op5_suffix_dedup,
        op6_decontaminate,
        op7_secrets,
        op8_near_duplicates,
        op9_packing,
        op10_tokens_orc,
        op11_source_divergence,
        op12_url_filters,
        op13_lexical_search,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

#: The others cannot be said in SQL; tests compare them with brute force.
ORACLE = {
    "op1_top_k": bits.ORACLE,
    "op3_revisits": revisits.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
