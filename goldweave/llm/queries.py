"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from goldweave.llm import op2, op6, op9, op10
from goldweave.llm.op1 import op1_language
from goldweave.llm.op3 import op3_media
from goldweave.llm.op4 import op4_token_ids
from goldweave.llm.op5 import op5_packing
from goldweave.llm.op7 import op7_licenses
from goldweave.llm.op8 import op8_near_duplicates

QUERIES = {"op1_language": op1_language, "op2_toxicity": op2.op2_toxicity, "op3_media": op3_media, "op4_token_ids": op4_token_ids, "op5_packing": op5_packing, "op6_mixing": op6.op6_mixing, "op7_licenses": op7_licenses, "op8_near_duplicates": op8_near_duplicates, "op9_chat": op9.op9_chat, "op10_knn": op10.op10_knn}
ORACLE_SQL: dict[str, str] = {"op6_mixing": op6.SQL, "op10_knn": op10.SQL}
