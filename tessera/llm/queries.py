"""The corpus queries and their SQL, by name. Each runs its operator over its whole table."""

from __future__ import annotations

from tessera.llm.chat import OP8_SQL, op8_chat
from tessera.llm.decontamination import OP9_SQL, op9_decontamination
from tessera.llm.media import PAYLOAD_SQL, media_payloads, op4_media
from tessera.llm.minhash import OP1_SQL, op1_minhash
from tessera.llm.mixing import op6_mixing
from tessera.llm.pii import BASE_SQL, base_personal_data, op2_pii
from tessera.llm.quality import op10_quality
from tessera.llm.sharding import OP7_SQL, op7_sharding
from tessera.llm.suffixes import OP5_SQL, op5_suffixes
from tessera.llm.warc import op3_warc

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_pii": op2_pii,
    "op3_warc": op3_warc,
    "op4_media": op4_media,
    "op5_suffixes": op5_suffixes,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_chat": op8_chat,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "pii_base": base_personal_data,
    "media_payloads": media_payloads,
}

ORACLE_SQL = {
    "op1_minhash": OP1_SQL,
    "op3_warc": """
        WITH r AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
                          max(page_id) OVER (PARTITION BY body) AS winner FROM r)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN winner END AS refers_to
        FROM d""",
    "media_payloads": PAYLOAD_SQL,
    "op5_suffixes": OP5_SQL,
    "pii_base": BASE_SQL,
    "op7_sharding": OP7_SQL,
    "op8_chat": OP8_SQL,
    "op9_decontamination": OP9_SQL,
}
