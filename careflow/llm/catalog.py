"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.llm import (alignment, decontaminate, hnsw_dedup, lattice_lm, lexicon_codec, line_dedup, merge_replay,
                          secrets, shingle_join, structure_repair, suffix_dedup, token_counts, toxicity)
from careflow.llm.common import table

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_lm(spark, sf_dir):
    return lattice_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), tokenizer(PIECES))


def op2_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_toxicity(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_hnsw_dedup(spark, sf_dir):
    return hnsw_dedup.linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_lexicon_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = lexicon_codec.encode(docs, tokenizer(BYTE_BPE), decode=True, keep_text=False)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_shingle_join(spark, sf_dir):
    return shingle_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_benchmark_containment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op10_secret_links(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark, sf_dir):
    summaries, _ = structure_repair.repair(structure_repair.damage(table(spark, sf_dir, "conversations")))
    return summaries


def op12_merge_replay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = merge_replay.encode(docs, tokenizer(MULTI_RANKS), decode=True, keep_text=False)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.linked(docs, tokenizer(BYTE_BPE), tokenizer(PIECES), keep_groups=False, keep_text=False)


QUERIES = {f.__name__: f for f in (
    op1_lattice_lm, op2_suffix_dedup, op3_line_dedup, op4_toxicity, op5_hnsw_dedup, op6_lexicon_codec,
    op7_shingle_join, op8_benchmark_containment, op9_token_counts, op10_secret_links, op11_structure_repair,
    op12_merge_replay, op13_token_alignment,
)}

_SHINGLES = """
{name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}))"""
ORACLE: dict[str, str] = {
    "op3_line_dedup": """
WITH lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM
  (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, (often.k IS NULL OR often.last = doc_id) AS stays FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
    "op8_benchmark_containment": "WITH" + _SHINGLES.format(name="d", key="doc_id", source="documents") + ","
    + _SHINGLES.format(name="b", key="item_id", source="benchmark") + """,
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 75""",
}
