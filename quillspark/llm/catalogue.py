"""The queries of this subpackage."""

from __future__ import annotations

from quillspark.llm.op1_quality import op1_quality_classifier
from quillspark.llm.op10_brown import op10_brown_lm
from quillspark.llm.op2_warc import OP2_SQL, op2_warc
from quillspark.llm.op3_minhash import OP3_SQL, op3_minhash_dedup
from quillspark.llm.op4_cover import OP4_SQL, op4_cover_tree
from quillspark.llm.op5_rules import op5_quality_rules
from quillspark.llm.op6_mix import op6_mix_sources
from quillspark.llm.op7_pack import op7_best_fit_packing
from quillspark.llm.op8_count import op8_token_counts
from quillspark.llm.op9_repeats import OP9_SQL, op9_substring_dedup

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_warc, op3_minhash_dedup, op4_cover_tree, op5_quality_rules, op6_mix_sources, op7_best_fit_packing, op8_token_counts, op9_substring_dedup, op10_brown_lm)}
#: The others rest on fitted models or on choices that SQL doesn't express; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op3_minhash_dedup": OP3_SQL, "op4_cover_tree": OP4_SQL, "op9_substring_dedup": OP9_SQL}
