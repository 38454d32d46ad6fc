"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, chat, exact_dedup, hyperminhash, jaccard_join, language_id, media, mixing, packing, pii, quality, repair, secrets

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_secrets": secrets.query,
    "op3_chat_format": chat.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_media_columns": media.query,
    "op6_mixing": mixing.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_packing": packing.query,
    "op9_pii": pii.query,
    "op10_quality": quality.query,
    "op11_alignment": alignment.query,
    "op12_conversation_repair": repair.query,
    "op13_near_dedup": hyperminhash.query,
}

def _part(name: str, *columns: str):
    """The columns of an operator's result that SQL can express."""
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).select(*columns)


def _mixed_sizes(spark, sf_dir):
    return mixing.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


# What the fixed patterns, the stored payload and the targets give, as far as SQL tells it: each over the operator's whole result.
PARTS = {
    "base_of_op2": _part("op2_secrets", "doc_id", "n_assign", "n_access", "n_hex"),
    "payload_of_op5": _part("op5_media_columns", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes"),
    "targets_of_op6": _mixed_sizes,
    "base_of_op9": _part("op9_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone"),
}

ORACLES = {
    "op3_chat_format": chat.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_alignment": alignment.query,
    "op12_conversation_repair": repair.ORACLE,
    "op13_near_dedup": hyperminhash.ORACLE,
    "base_of_op2": r"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
    "payload_of_op5": """
SELECT doc_id, n AS n_bytes, greatest(1, (n + 191) // 192) * 192 AS payload_bytes,
       sha256(t || repeat(' ', greatest(1, (n + 191) // 192) * 192 - n)) AS payload_sha256, greatest(1, (n + 191) // 192) * 192 + 44 AS media_bytes
FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
""",
    "targets_of_op6": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1] AS weight, 2.0 * source_size AS most FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(most, coalesce(weight * max(CASE WHEN level < most / weight THEN level END) OVER (), most)) AS target FROM l)
SELECT d.doc_id, d.size, t.source_size, round(t.target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
""",
    "base_of_op9": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
             list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
             list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d)
SELECT doc_id, len(email) AS n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(p) > 15 OR TRY_CAST(p AS BIGINT) > 255)) = 0)) AS n_ip,
       len(list_filter(card, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN x[i]::INT WHEN x[i]::INT > 4 THEN 2 * x[i]::INT - 9 ELSE 2 * x[i]::INT END)) % 10 = 0)) AS n_card,
       len(list_filter(phone, lambda x: length(x) BETWEEN 10 AND 15)) AS n_phone
FROM f
""",
}

QUERIES |= PARTS
