"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .language_id import op7_language_id
from .mixing import OP8_SQL, op8_mixing
from .packing import op9_packing
from .ngram_join import OP2_SQL, op2_ngram_join
from .pii import op6_pii
from .pu_quality import op3_pu_quality
from .quality_rules import OP1_SQL, op1_quality_rules
from .token_files import op4_token_files
from .topk import OP10_SQL, op10_topk
from .warc import OP5_SQL, op5_warc

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_pu_quality, op4_token_files, op5_warc, op6_pii, op7_language_id, op8_mixing, op9_packing, op10_topk)}
ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op2_ngram_join": OP2_SQL, "op5_warc": OP5_SQL, "op8_mixing": OP8_SQL, "op10_topk": OP10_SQL}
