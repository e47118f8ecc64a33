"""Queries of the corpus operators and, where SQL can express them, the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm.bpe import op2_bpe
from weirflow.llm.decontaminate import op3_decontaminate
from weirflow.llm.extract import op4_extract
from weirflow.llm.quality import op5_quality
from weirflow.llm.simhash import op6_simhash
from weirflow.llm.substrings import op9_substrings
from weirflow.llm.suffixes import op8_suffixes
from weirflow.llm.tokenstore import op7_tokenstore
from weirflow.llm.toxicity import op10_toxicity
from weirflow.llm.warc import op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_bpe, op3_decontaminate, op4_extract, op5_quality, op6_simhash, op7_tokenstore, op8_suffixes, op9_substrings, op10_toxicity)
}

_OP1 = """
WITH digests AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), spelled AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4)::INT, 5) AS INT) >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest
    FROM digests
), first AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS origin FROM spelled
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM first
"""

# the windows of an item are its runs of 13 words, or all its words if it has fewer; they are looked up in the runs of equal length of every document
_OP3 = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), sized AS (
    SELECT item_id, words, least(len(words), 13) AS size FROM item WHERE len(words) > 0
), starts AS (
    SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM sized
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[pos : pos + size - 1], ' ') AS phrase FROM starts
), runs AS (
    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM doc, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
), phrases AS (
    SELECT doc_id, size, pos, array_to_string(words[pos : pos + size - 1], ' ') AS phrase FROM runs
), found AS (
    SELECT doc_id, item_id, size, pos FROM phrases JOIN windows USING (size, phrase)
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP9 = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), runs AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM doc WHERE len(words) >= 35
), windows AS (
    SELECT doc_id, pos, array_to_string(words[pos : pos + 34], ' ') AS phrase FROM runs
), repeated AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY phrase) AS n FROM windows) WHERE n > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS place FROM repeated
), placed AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM doc
), stays AS (
    SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN stays USING (doc_id)
"""

#: DuckDB has neither XXH64 nor the tokenizers, and cannot fit models; whole suffixes of long texts are too slow there.
ORACLE_SQL: dict[str, str] = {"op1_warc": _OP1, "op3_decontaminate": _OP3, "op9_substrings": _OP9}
