"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from panelkit.llm.op1_substring_dedup import OP1_SQL, op1_substring_dedup
from panelkit.llm.op2_token_store import op2_token_store
from panelkit.llm.op3_shards import op3_shards
from panelkit.llm.op4_fingerprints import op4_fingerprints
from panelkit.llm.op5_mixing import op5_temperature_mix
from panelkit.llm.op6_url_filters import OP6_SQL, op6_url_filters
from panelkit.llm.op7_jaccard_join import OP7_SQL, op7_jaccard_join
from panelkit.llm.op8_private_data import op8_private_data
from panelkit.llm.op9_toxicity import op9_toxicity
from panelkit.llm.op10_decontaminate import op10_decontaminate
from panelkit.llm.op11_simhash import op11_simhash_near_dedup
from panelkit.llm.op12_prefix_trie import OP12_SQL, op12_prefix_trie
from panelkit.llm.op13_vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_store": op2_token_store,
    "op3_shards": op3_shards,
    "op4_fingerprints": op4_fingerprints,
    "op5_temperature_mix": op5_temperature_mix,
    "op6_url_filters": op6_url_filters,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_private_data": op8_private_data,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op6_url_filters": OP6_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
