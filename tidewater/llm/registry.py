"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewater.llm.ann import op8_ann
from tidewater.llm.classlm import op5_classlm
from tidewater.llm.langid import op2_langid
from tidewater.llm.merkle import OP12_SQL, op12_merkle
from tidewater.llm.mixing import OP4_SQL, op4_mixing
from tidewater.llm.packing import op9_packing
from tidewater.llm.passages import op6_passages
from tidewater.llm.pq import OP11_SQL, op11_embedding_dedup
from tidewater.llm.preferences import OP7_SQL, op7_preferences
from tidewater.llm.secrets import op3_secrets
from tidewater.llm.simhash import op1_simhash
from tidewater.llm.sketch import op10_sketch
from tidewater.llm.trie import OP13_SQL, op13_trie

QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_langid, op3_secrets, op4_mixing, op5_classlm, op6_passages, op7_preferences, op8_ann, op9_packing, op10_sketch, op11_embedding_dedup, op12_merkle, op13_trie,
)}
ORACLES = {"op4_mixing": OP4_SQL, "op7_preferences": OP7_SQL, "op11_embedding_dedup": OP11_SQL, "op12_merkle": OP12_SQL, "op13_trie": OP13_SQL}
