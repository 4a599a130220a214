"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tesserae.llm.exact_dedup import ORACLE_OP6, op6_exact_dedup
from tesserae.llm.filter_audit import ORACLE_OP12, op12_filter_audit
from tesserae.llm.hnsw import op5_hnsw_search
from tesserae.llm.language_id import op9_language_id
from tesserae.llm.minhash_join import op8_jaccard_join
from tesserae.llm.mixing import ORACLE_OP4, op4_mix_sources
from tesserae.llm.packing import op1_best_fit_packing
from tesserae.llm.quality import op3_quality_cotraining
from tesserae.llm.ranked_search import ORACLE_OP13, op13_ranked_search
from tesserae.llm.simhash import op11_simhash_dedup
from tesserae.llm.suffix_dedup import op7_suffix_dedup
from tesserae.llm.token_counts import op10_token_counts
from tesserae.llm.warc import ORACLE_OP2, op2_warc_normalise

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_warc_normalise,
        op3_quality_cotraining,
        op4_mix_sources,
        op5_hnsw_search,
        op6_exact_dedup,
        op7_suffix_dedup,
        op8_jaccard_join,
        op9_language_id,
        op10_token_counts,
        op11_simhash_dedup,
        op12_filter_audit,
        op13_ranked_search,
    )
}
ORACLES = {"op2_warc_normalise": ORACLE_OP2, "op4_mix_sources": ORACLE_OP4, "op6_exact_dedup": ORACLE_OP6, "op12_filter_audit": ORACLE_OP12, "op13_ranked_search": ORACLE_OP13}
