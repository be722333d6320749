"""The registered queries of the operators, and their reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshtide.llm import bpe, byte_repeats, collocations, conversation_trie, fingerprints, html_extraction, line_dedup, mixing, passages, quality_classifier, quality_rules, simhash, token_files
from meshtide.llm.shared import documents, labels

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_byte_repeats": lambda spark, sf: byte_repeats.digests(documents(spark, sf)),
    "op2_line_dedup": lambda spark, sf: line_dedup.digests(documents(spark, sf)),
    "op3_token_files": lambda spark, sf: token_files.digests(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json")),
    "op4_fingerprints": lambda spark, sf: fingerprints.compare_to_next(documents(spark, sf)),
    "op5_source_mixing": lambda spark, sf: mixing.digests(documents(spark, sf)),
    "op6_byte_bpe": lambda spark, sf: bpe.round_trip(
        documents(spark, sf), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "op7_quality_rules": lambda spark, sf: quality_rules.digests(documents(spark, sf), labels(spark, sf)),
    "op8_passages": lambda spark, sf: passages.digests(documents(spark, sf)),
    "op9_quality_classifier": lambda spark, sf: quality_classifier.digests(documents(spark, sf), labels(spark, sf)),
    "op10_simhash_near_dup": lambda spark, sf: simhash.digests(documents(spark, sf)),
    "op11_html_extraction": lambda spark, sf: html_extraction.main_texts(spark.read.parquet(f"{sf}/pages.parquet")),
    "op12_conversation_trie": lambda spark, sf: conversation_trie.trie(spark.read.parquet(f"{sf}/conversations.parquet")),
    "op13_collocations": lambda spark, sf: collocations.collocations(documents(spark, sf)),
}

SQL: dict[str, str] = {
    "op5_source_mixing": mixing.SQL,
    "op12_conversation_trie": conversation_trie.SQL,
    "op13_collocations": collocations.SQL,
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
held AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS stays FROM lines WHERE length(key) >= 20 GROUP BY key HAVING n >= 3),
marked AS (SELECT l.*, h.key IS NOT NULL AND h.stays <> l.doc_id AS gone FROM lines l LEFT JOIN held h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_passages": r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 19, 0))) AS p FROM split),
passage AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + 20], ' ') AS words FROM starts),
earliest AS (SELECT words, min((doc_id, p)) AS place FROM passage GROUP BY words HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM passage JOIN earliest USING (words) WHERE (doc_id, p) > place),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM later, range(20) r(i)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM split),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS text, count(*) AS n FROM words w ANTI JOIN gone USING (doc_id, p) GROUP BY w.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)""",
}
