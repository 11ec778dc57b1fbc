"""Pieces of SQL that several modules' counterparts share."""

from __future__ import annotations

from codexloom.operators import text

#: A word, as ``operators.seeding`` takes it.
WORD_SQL = r"[\p{L}\p{N}''’-]+"
STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)


def grounding_sql(claim: str, source: str) -> str:
    """The share of ``claim``'s content words that ``source`` has; 1 if it has none."""
    c = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({claim}, '')), '[a-z0-9.$%()]+')), lambda w: len(w) > 2 AND w NOT IN ({STOP_SQL}))"
    return f"CASE WHEN len({c}) = 0 THEN 1.0 ELSE len(list_intersect({c}, list_distinct(regexp_extract_all(lower(coalesce({source}, '')), '[a-z0-9.$%()]+')))) / len({c}) END"
