"""The queries of this subpackage, by name, and their SQL.

The others would have to repeat hashing, compression or encoding that DuckDB
lacks: their tests hold them against plain versions instead.
"""

from __future__ import annotations

from feedlift.llm import licenses, source_audit
from feedlift.llm.alignment import op12_alignment
from feedlift.llm.decontaminate import op2_decontaminate
from feedlift.llm.language import op4_language
from feedlift.llm.licenses import op1_license_scan
from feedlift.llm.line_dedup import op5_line_dedup
from feedlift.llm.packing import op6_packing
from feedlift.llm.quality import op9_quality
from feedlift.llm.sentencepieces import op13_sentencepiece
from feedlift.llm.simhash import op8_simhash
from feedlift.llm.source_audit import op11_source_divergence
from feedlift.llm.spotsigs import op7_spotsigs
from feedlift.llm.token_counts import op10_token_counts
from feedlift.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_spotsigs": op7_spotsigs,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_alignment": op12_alignment,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLES = {
    "op1_license_scan": licenses.ORACLE,
    "op11_source_divergence": source_audit.ORACLE,
}
