"""The queries of this subpackage by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from .byte_bpe import op6_byte_bpe
from .decontaminate import op3_decontaminate
from .divergence import ORACLE, op13_source_divergence
from .jaccard import op4_jaccard_join
from .language import op9_language_id
from .line_dedup import op10_line_dedup
from .merge_automaton import op12_merge_automaton
from .oracles import ORACLES as _ORACLES
from .pii import op2_pii_spans
from .token_files import op8_token_records
from .topk import op5_top_k
from .toxicity import op1_toxicity
from .warc import op7_warc_derivatives
from .whitening import op11_whitening

__all__ = ["ORACLES", "QUERIES"]

_FUNCTIONS = [
    op1_toxicity, op2_pii_spans, op3_decontaminate, op4_jaccard_join, op5_top_k, op6_byte_bpe, op7_warc_derivatives, op8_token_records, op9_language_id, op10_line_dedup,
    op11_whitening, op12_merge_automaton, op13_source_divergence,
]
ORACLES = _ORACLES | {"op13_source_divergence": ORACLE}
QUERIES = {f.__name__: f for f in _FUNCTIONS}
