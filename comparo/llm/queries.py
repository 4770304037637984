"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from comparo.llm.op1_topk import OP1_SQL, op1_topk
from comparo.llm.op2_substrings import OP2_SQL, op2_substrings
from comparo.llm.op3_mix import op3_mix
from comparo.llm.op4_toxicity import op4_toxicity
from comparo.llm.op5_quality import op5_quality
from comparo.llm.op6_simhash import op6_simhash
from comparo.llm.op7_pack import op7_pack
from comparo.llm.op8_pii import op8_pii
from comparo.llm.op9_host import OP9_SQL, op9_host
from comparo.llm.op10_lines import OP10_SQL, op10_lines
from comparo.llm.op11_whiten import op11_whiten
from comparo.llm.op12_repair import OP12_SQL, op12_repair
from comparo.llm.op13_chat import OP13_SQL, op13_chat

QUERIES = {f.__name__: f for f in (op1_topk, op2_substrings, op3_mix, op4_toxicity, op5_quality, op6_simhash, op7_pack, op8_pii, op9_host, op10_lines, op11_whiten, op12_repair, op13_chat)}
ORACLES = {"op1_topk": OP1_SQL, "op2_substrings": OP2_SQL, "op9_host": OP9_SQL, "op10_lines": OP10_SQL, "op12_repair": OP12_SQL, "op13_chat": OP13_SQL}
