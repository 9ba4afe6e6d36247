"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from .bpe import op5
from .compression import op2
from .fertility import op6
from .jaccard import op3
from .language import op1
from .line_dedup import OP10_SQL, op10
from .phrases import OP11_SQL, op11
from .secrets import op4
from .templates import op9
from .token_files import op13
from .url_rules import OP7_SQL, op7
from .warc import OP8_SQL, op8
from .whitening import op12


def queries() -> dict:
    return {
        "op1_language_id": op1,
        "op2_quality": op2,
        "op3_jaccard_join": op3,
        "op4_secret_scan": op4,
        "op5_bpe": op5,
        "op6_quality_rules": op6,
        "op7_url_filter": op7,
        "op8_warc": op8,
        "op9_decontamination": op9,
        "op10_line_dedup": op10,
        "op11_phrases": op11,
        "op12_whitening": op12,
        "op13_token_files": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op8_warc": OP8_SQL, "op10_line_dedup": OP10_SQL, "op11_phrases": OP11_SQL}
