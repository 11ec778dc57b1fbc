"""Column expressions that stay inside the JVM, under one roof."""

from codexloom.operators.blocks import ordered
from codexloom.operators.citations import bracketed, document_of, is_shaped, version_holds
from codexloom.operators.metrics import citation_status, hierarchical, related
from codexloom.operators.models import json_array, json_object, quoted_verbatim, without_thoughts
from codexloom.operators.retrieval import clip, context, pack, pack_reserved, prompt
from codexloom.operators.seeding import gates, spoken, topical_phrases
from codexloom.operators.text import content_words, grounding, subphrases
from codexloom.operators.vectors import dot, max_sim, norm, normalized

__all__ = [
    "bracketed", "citation_status", "clip", "content_words", "context", "document_of", "dot", "gates", "grounding", "hierarchical", "is_shaped", "json_array", "json_object", "max_sim",
    "norm", "normalized", "ordered", "pack", "pack_reserved", "prompt", "quoted_verbatim", "related", "spoken", "subphrases", "topical_phrases", "version_holds", "without_thoughts",
]
