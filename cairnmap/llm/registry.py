"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from cairnmap.llm.decontamination import op2_decontamination
from cairnmap.llm.language_id import op4_language_id
from cairnmap.llm.line_dedup import OP6_SQL, op6_line_dedup
from cairnmap.llm.mixing import OP7_SQL, op7_mixing
from cairnmap.llm.ngram_join import op9_ngram_join
from cairnmap.llm.packing import op1_packing
from cairnmap.llm.quality_classifier import op3_quality_classifier
from cairnmap.llm.quality_rules import op10_quality_rules
from cairnmap.llm.sharding import op8_sharding
from cairnmap.llm.suffix_dedup import op5_suffix_dedup


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_decontamination": op2_decontamination,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_language_id": op4_language_id,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op8_sharding": op8_sharding,
        "op9_ngram_join": op9_ngram_join,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op7_mixing": OP7_SQL}
