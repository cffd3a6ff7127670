"""The corpus queries and their SQL."""

from __future__ import annotations

from graphloom.llm.bpe import op5_byte_bpe
from graphloom.llm.chat import op3_chat_format
from graphloom.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from graphloom.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from graphloom.llm.html import op2_html_extraction
from graphloom.llm.language_id import op8_language_id
from graphloom.llm.line_dedup import OP7_SQL, op7_line_dedup
from graphloom.llm.minhash_dedup import op12_minhash_dedup
from graphloom.llm.mixing import op1_mixing
from graphloom.llm.ngram_join import op4_ngram_join
from graphloom.llm.periodic_runs import op11_periodic_runs
from graphloom.llm.sharding import op9_sharding
from graphloom.llm.topk import OP6_SQL, op6_exact_topk

QUERIES = (op1_mixing, op2_html_extraction, op3_chat_format, op4_ngram_join, op5_byte_bpe, op6_exact_topk, op7_line_dedup, op8_language_id, op9_sharding, op10_exact_dedup, op11_periodic_runs, op12_minhash_dedup, op13_fill_in_middle)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": OP6_SQL, "op7_line_dedup": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op13_fill_in_middle": OP13_SQL}
