"""The subpackage's registered queries and, where SQL can state them, their DuckDB forms."""

from __future__ import annotations

from textpairs.llm import chat_rotation, collocations, ranked_search, suffix_dedup
from textpairs.llm.chat_rotation import op6_chat_rotation
from textpairs.llm.collocations import op13_collocations
from textpairs.llm.decontaminate import op2_decontaminate
from textpairs.llm.exchange import small_batches
from textpairs.llm.jaccard_join import op3_jaccard_join
from textpairs.llm.language_id import op4_language_id
from textpairs.llm.license_scan import op8_license_scan
from textpairs.llm.lm_scoring import op9_lm_score
from textpairs.llm.packing import op1_best_fit_packing
from textpairs.llm.quality_rules import op5_quality_rules
from textpairs.llm.ranked_search import op11_ranked_search
from textpairs.llm.substring_dedup import op10_substring_dedup
from textpairs.llm.suffix_dedup import op12_suffix_dedup
from textpairs.llm.toxicity import op7_toxicity


def _small_batches(query):
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


_ALL = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_rotation": op6_chat_rotation,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_lm_score": op9_lm_score,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

QUERIES = {name: _small_batches(query) for name, query in _ALL.items()}

ORACLE: dict[str, str] = {
    "op6_chat_rotation": chat_rotation.ORACLE_SQL,
    "op11_ranked_search": ranked_search.ORACLE_SQL,
    "op12_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
