"""Queries of this subpackage, by name, and SQL where it can restate one over whole tables. Tests hold the others against brute force."""

from __future__ import annotations

from tarnflow.llm.decontaminate import op9_contaminated
from tarnflow.llm.html import op6_main_text
from tarnflow.llm.jaccard import op7_jaccard_join
from tarnflow.llm.langid import op8_language
from tarnflow.llm.neighbours import op5_nearest
from tarnflow.llm.pieces import op10_sentencepiece
from tarnflow.llm.pii import op1_pii
from tarnflow.llm.prefixes import ORACLE, op11_prefix_trie
from tarnflow.llm.sketches import op12_fingerprints
from tarnflow.llm.spelling import op13_spelling
from tarnflow.llm.substrings import op2_repeated_passages
from tarnflow.llm.tokens import op3_token_counts, op4_packed_ids

QUERIES = {f.__name__: f for f in (op1_pii, op2_repeated_passages, op3_token_counts, op4_packed_ids, op5_nearest, op6_main_text, op7_jaccard_join, op8_language, op9_contaminated, op10_sentencepiece, op11_prefix_trie, op12_fingerprints, op13_spelling)}
ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": ORACLE}
