"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

from revisio.llm import chat, decontamination, licenses, merkle
from revisio.llm.chat import op10_preference_format
from revisio.llm.decontamination import op9_decontamination
from revisio.llm.hmm import op11_hmm_scoring
from revisio.llm.jaccard import op7_jaccard_join
from revisio.llm.language_id import op3_language_id
from revisio.llm.licenses import op2_license_scan
from revisio.llm.merkle import op13_merkle_manifest
from revisio.llm.packing import op6_packing
from revisio.llm.quality_knn import op5_quality_knn
from revisio.llm.quality_rules import op8_quality_rules
from revisio.llm.token_counts import op1_token_counts
from revisio.llm.token_store import op4_token_store
from revisio.llm.vector_codes import op12_vector_codes

QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_license_scan, op3_language_id, op4_token_store, op5_quality_knn, op6_packing, op7_jaccard_join,
    op8_quality_rules, op9_decontamination, op10_preference_format, op11_hmm_scoring, op12_vector_codes, op13_merkle_manifest)}

#: Where SQL can state the whole result; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_license_scan": licenses.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op10_preference_format": chat.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
