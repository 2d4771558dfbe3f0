"""The queries of this subpackage and their DuckDB equivalents, by name."""

from . import lines, quality, secrets, substrings, topk
from .bpe import op9_byte_bpe
from .lines import op8_lines
from .mixing import op1_mixing
from .quality import op3_quality
from .secrets import op6_secrets
from .simhash import op4_simhash
from .substrings import op10_substrings
from .token_files import op5_token_files
from .topk import op7_topk
from .toxicity import op2_toxicity

QUERIES: dict = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_quality, op4_simhash, op5_token_files, op6_secrets, op7_topk, op8_lines, op9_byte_bpe, op10_substrings)}
ORACLES: dict = {"op3_quality": quality.ORACLE, "op6_secrets": secrets.ORACLE, "op7_topk": topk.ORACLE, "op8_lines": lines.ORACLE, "op10_substrings": substrings.ORACLE}
