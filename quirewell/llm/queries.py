"""The ``opN_<name>`` queries and their DuckDB SQL, collected from the operators' modules."""

from __future__ import annotations

from .bpe import op5_bpe
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .graph_ann import op3_ann
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_extract import op2_html
from .language_id import op4_language
from .lexical_rank import OP12_SQL, op12_lexical_rank
from .near_dedup import op1_minhash
from .packing import op7_packing
from .quality import op9_quality
from .substring_dedup import op8_substring
from .token_count import op11_token_count
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_html": op2_html,
    "op3_ann": op3_ann,
    "op4_language": op4_language,
    "op5_bpe": op5_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_substring": op8_substring,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_token_count": op11_token_count,
    "op12_lexical_rank": op12_lexical_rank,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL = {"op6_exact_dedup": OP6_SQL, "op10_warc": OP10_SQL, "op12_lexical_rank": OP12_SQL, "op13_hard_negatives": OP13_SQL}
