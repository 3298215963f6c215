"""Queries of this folder's operators and the SQL that checks them."""

from .byte_bpe import op6_byte_bpe
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .decontaminate import op5_decontaminate
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op10_language_id
from .line_quality import op3_line_quality
from .near_dedup import op7_near_dedup
from .packing import op12_packing
from .ppm import op1_ppm
from .site_style_tree import op8_main_text
from .token_store import op9_token_store
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_ppm": op1_ppm,
    "op2_url_filter": op2_url_filter,
    "op3_line_quality": op3_line_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_near_dedup": op7_near_dedup,
    "op8_main_text": op8_main_text,
    "op9_token_store": op9_token_store,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_packing": op12_packing,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {"op2_url_filter": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op13_conversation_repair": OP13_SQL}
