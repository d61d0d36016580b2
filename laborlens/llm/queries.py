"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from laborlens.llm import phrases, warc
from laborlens.llm.attention_lm import op7_attention_lm
from laborlens.llm.decontam import op2_template_decontamination
from laborlens.llm.fingerprint import op10_locally_consistent
from laborlens.llm.near_dup import op8_min_max_hashing
from laborlens.llm.packing import op9_cost_packing
from laborlens.llm.secrets import op6_secret_scan
from laborlens.llm.spelling import op13_edit_composition
from laborlens.llm.substring_dup import op5_paragraph_banding
from laborlens.llm.token_counts import op3_count_viterbi
from laborlens.llm.token_files import op12_fixed_size_lists
from laborlens.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_template_decontamination": op2_template_decontamination,
    "op3_count_viterbi": op3_count_viterbi,
    "op4_toxicity": op4_toxicity,
    "op5_paragraph_banding": op5_paragraph_banding,
    "op6_secret_scan": op6_secret_scan,
    "op7_attention_lm": op7_attention_lm,
    "op8_min_max_hashing": op8_min_max_hashing,
    "op9_cost_packing": op9_cost_packing,
    "op10_locally_consistent": op10_locally_consistent,
    "op11_trie_collocations": phrases.op11_trie_collocations,
    "op12_fixed_size_lists": op12_fixed_size_lists,
    "op13_edit_composition": op13_edit_composition,
}
SQL: dict[str, str] = {"op1_warc": warc.SQL, "op11_trie_collocations": phrases.SQL}
