"""The queries of this subpackage and their SQL, for the entry module to add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattice.llm import licenses, lines, spelling, substring
from lattice.llm.decontaminate import op5_decontaminate
from lattice.llm.language_id import op10_language_id
from lattice.llm.media import op2_media
from lattice.llm.near import op3_near_dedup
from lattice.llm.pieces import op7_pieces
from lattice.llm.privacy import op12_personal_data
from lattice.llm.quality import op4_quality
from lattice.llm.token_counts import op8_token_counts
from lattice.llm.whitening import op11_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_media": op2_media,
        "op3_near_dedup": op3_near_dedup,
        "op4_quality": op4_quality,
        "op5_decontaminate": op5_decontaminate,
        "op6_substring_dedup": substring.op6_substring_dedup,
        "op7_pieces": op7_pieces,
        "op8_token_counts": op8_token_counts,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_language_id": op10_language_id,
        "op11_whitening": op11_whitening,
        "op12_personal_data": op12_personal_data,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.sql(), "op6_substring_dedup": substring.SQL, "op9_line_dedup": lines.SQL, "op13_spelling": spelling.SQL}
