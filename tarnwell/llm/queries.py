"""The subpackage's queries and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from tarnwell.llm.bwt_dedup import OP5_SQL, op5_suffix_array_dedup
from tarnwell.llm.decontam import OP3_SQL, op3_benchmark_decontamination
from tarnwell.llm.exact_topk import OP11_SQL, op11_exact_topk
from tarnwell.llm.html_extract import op9_html_extraction
from tarnwell.llm.licenses import op8_license_scans
from tarnwell.llm.lm_scoring import op2_lm_scoring
from tarnwell.llm.merkle import OP12_SQL, op12_merkle_manifest
from tarnwell.llm.minhash import OP7_SQL, op7_minhash_near_dedup
from tarnwell.llm.mixing import op10_mix_sources
from tarnwell.llm.quality_rules import op1_quality_rules
from tarnwell.llm.rlz_dedup import OP4_SQL, op4_substring_dedup
from tarnwell.llm.spelling import OP13_SQL, op13_spelling_variants
from tarnwell.llm.url_filters import OP6_SQL, op6_url_filters

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_lm_scoring, op3_benchmark_decontamination, op4_substring_dedup, op5_suffix_array_dedup, op6_url_filters, op7_minhash_near_dedup, op8_license_scans, op9_html_extraction, op10_mix_sources, op11_exact_topk, op12_merkle_manifest, op13_spelling_variants)}
SQL = {"op3_benchmark_decontamination": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_suffix_array_dedup": OP5_SQL, "op6_url_filters": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL, "op11_exact_topk": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_spelling_variants": OP13_SQL}
