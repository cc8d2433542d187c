"""DuckDB forms of those numbered queries that SQL can express over whole tables."""

from __future__ import annotations

P4_FOUND = r"""
SELECT DISTINCT chunk_id FROM chunks
WHERE len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s\x{85}\pZ\x{1c}-\x{1f}]')) > 512
"""

P3_VECTORS = """
WITH v AS (
    SELECT DISTINCT entity_id, embedding::DOUBLE[] AS e FROM entities
    WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), ranked AS (
    SELECT a.entity_id, b.entity_id AS other_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity,
           row_number() OVER (PARTITION BY a.entity_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.entity_id) AS rank
    FROM v a JOIN v b ON a.entity_id <> b.entity_id
)
"""
P3_FOUND = P3_VECTORS + """
SELECT DISTINCT least(entity_id, other_id) AS entity_id_a, greatest(entity_id, other_id) AS entity_id_b FROM ranked WHERE rank <= 5
"""


P3_NEAREST = P3_VECTORS + "SELECT entity_id, other_id, similarity, rank::INT AS rank FROM ranked WHERE rank <= 5"


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND, "p3_nearest": P3_NEAREST, "p4_found": P4_FOUND}
