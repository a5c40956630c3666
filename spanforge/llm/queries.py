"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from spanforge.llm.decontaminate import op1_benchmark_decontamination
from spanforge.llm.exact import op7_suffix_array_dedup
from spanforge.llm.extract import op4_html_extraction
from spanforge.llm.hmm import op11_lm_scoring
from spanforge.llm.lines import OP2_SQL, op2_line_dedup
from spanforge.llm.mixing import OP3_SQL, op3_mixing
from spanforge.llm.quality import op8_quality_rules
from spanforge.llm.resample import OP13_SQL, op13_importance_resampling
from spanforge.llm.simhash import op5_simhash_near_dedup
from spanforge.llm.spelling import OP12_SQL, op12_spelling_variants
from spanforge.llm.tokenfile import op10_token_id_output
from spanforge.llm.tokens import op9_token_counts
from spanforge.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_warc": op6_warc,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_token_id_output": op10_token_id_output,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES = {"op2_line_dedup": OP2_SQL, "op3_mixing": OP3_SQL, "op6_warc": OP6_SQL, "op12_spelling_variants": OP12_SQL, "op13_importance_resampling": OP13_SQL}
