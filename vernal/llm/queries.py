"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from vernal.llm.ctph import op6_fingerprints
from vernal.llm.decontaminate import op5_decontamination
from vernal.llm.html import op3_html_extraction
from vernal.llm.language_id import op10_language_id
from vernal.llm.lm import op1_lm_scoring
from vernal.llm.mixing import op9_mixing
from vernal.llm.secrets import op2_secret_scan
from vernal.llm.simhash import op8_simhash_near_dedup
from vernal.llm.tokens import op4_token_files
from vernal.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_secret_scan, op3_html_extraction, op4_token_files, op5_decontamination, op6_fingerprints, op7_toxicity, op8_simhash_near_dedup, op9_mixing, op10_language_id)}

#: None of the ten can be put in SQL whole (trained models, hashes of shingles, range coding, alignment);
#: tests/llm holds them against brute force instead.
ORACLE_SQL: dict[str, str] = {}
