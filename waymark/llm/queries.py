"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from waymark.llm.centroids import OP12_SQL, op12_centroids
from waymark.llm.chat import OP10_SQL, op10_chat
from waymark.llm.decontam import OP7_SQL, op7_decontamination
from waymark.llm.embeddings import op5_embeddings
from waymark.llm.licenses import OP13_SQL, op13_licenses
from waymark.llm.linededup import OP1_SQL, op1_line_dedup
from waymark.llm.negatives import OP11_SQL, op11_hard_negatives
from waymark.llm.packing import op9_packing
from waymark.llm.pii import op8_pii
from waymark.llm.secrets import OP6_SQL, op6_secrets
from waymark.llm.simhash import op3_simhash
from waymark.llm.substrings import op2_substrings
from waymark.llm.toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_substrings, op3_simhash, op4_toxicity, op5_embeddings, op6_secrets, op7_decontamination, op8_pii, op9_packing, op10_chat, op11_hard_negatives, op12_centroids, op13_licenses)}
SQL = {"op1_line_dedup": OP1_SQL, "op6_secrets": OP6_SQL, "op7_decontamination": OP7_SQL, "op10_chat": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_centroids": OP12_SQL, "op13_licenses": OP13_SQL}
