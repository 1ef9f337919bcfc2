"""Queries of this subpackage by name, and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from .decontamination import op7_benchmark_decontamination
from .html_extraction import op10_html_extraction
from .jaccard_join import op5_ngram_jaccard_join
from .language_id import op2_language_id
from .lexical_tree import op13_ranked_lexical_search
from .line_dedup import op11_line_dedup
from .packing import op4_best_fit_packing
from .pii import op8_pii_surrogates
from .quality import op6_quality_classifier
from .simhash import op9_document_fingerprints
from .source_audit import op12_source_divergence_audit
from .sqltext import SQL
from .substring_dedup import op3_substring_dedup
from .toxicity import op1_toxicity

__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (
    op1_toxicity,
    op2_language_id,
    op3_substring_dedup,
    op4_best_fit_packing,
    op5_ngram_jaccard_join,
    op6_quality_classifier,
    op7_benchmark_decontamination,
    op8_pii_surrogates,
    op9_document_fingerprints,
    op10_html_extraction,
    op11_line_dedup,
    op12_source_divergence_audit,
    op13_ranked_lexical_search,
)}
