"""The query of each text operator, and SQL for those that SQL can express."""

from __future__ import annotations

from cladelake.llm.language_id import op3_language_id
from cladelake.llm.toxicity import op6_toxicity
from cladelake.llm.mixing import OP2_SQL, op2_source_mix
from cladelake.llm.decontamination import OP5_SQL, op5_decontamination
from cladelake.llm.simhash import op4_simhash
from cladelake.llm.quality import op10_quality
from cladelake.llm.html_text import op1_main_text
from cladelake.llm.url_filter import OP7_SQL, op7_url_filter
from cladelake.llm.ann import op9_nearest
from cladelake.llm.lm_score import op8_lm_score

QUERIES = {
    "op8_lm_score": op8_lm_score,
    "op9_nearest": op9_nearest,
    "op7_url_filter": op7_url_filter,
    "op1_main_text": op1_main_text,
    "op10_quality": op10_quality,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op2_source_mix": op2_source_mix,
    "op6_toxicity": op6_toxicity,
    "op3_language_id": op3_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": OP2_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_url_filter": OP7_SQL,
}
