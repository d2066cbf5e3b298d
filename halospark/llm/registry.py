"""The subpackage's queries and their SQL, for __spark_entry__."""

from . import decontaminate, exact_dedup, fill_in_middle, mixing, warc
from .decontaminate import op1_decontaminate
from .exact_dedup import op7_exact_dedup
from .fill_in_middle import op13_fill_in_middle
from .licenses import op8_license_scan
from .lm_score import op4_lm_score
from .mixing import op5_mix_sources
from .personal_data import op11_personal_data
from .secrets import op2_secret_scan
from .simhash import op3_simhash_dedup
from .token_alignment import op12_cross_tokenizer_alignment
from .token_count import op10_token_count
from .toxicity import op9_toxicity
from .warc import op6_warc

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_secret_scan, op3_simhash_dedup, op4_lm_score, op5_mix_sources, op6_warc, op7_exact_dedup, op8_license_scan, op9_toxicity, op10_token_count, op11_personal_data, op12_cross_tokenizer_alignment, op13_fill_in_middle)}
SQL = {"op1_decontaminate": decontaminate.SQL, "op5_mix_sources": mixing.SQL, "op6_warc": warc.SQL, "op7_exact_dedup": exact_dedup.SQL, "op13_fill_in_middle": fill_in_middle.SQL}
