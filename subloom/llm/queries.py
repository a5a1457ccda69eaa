"""The operators as queries over the sample tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.llm.alignment import align_tokens
from subloom.llm.decontamination import contaminated
from subloom.llm.exact_dedup import exact_dedup
from subloom.llm.jaccard_join import near_duplicates
from subloom.llm.line_dedup import line_dedup
from subloom.llm.lm_scoring import score_documents
from subloom.llm.packing import pack_documents
from subloom.llm.preference import conversations, paired_by_opening, preference_format
from subloom.llm.repeats import remove_repeats
from subloom.llm.secret_scan import RULES, find_secrets, spans_text
from subloom.llm.token_counts import token_counts
from subloom.llm.toxicity import fit_toxicity, held_out, score_toxicity
from subloom.llm.whitening import whiten

# Tokens of one training sequence.
LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", "n_lines", "n_removed")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("spans")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), LIMIT)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary())
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text: start-stop, separated by commas."""
    convs = conversations(table(spark, sf_dir, "conversations"))
    out = preference_format(convs, paired_by_opening(convs))
    return out.withColumns(
        {
            name: F.array_join(
                F.transform(name, lambda x: F.concat_ws("-", x["start"], x["stop"])), ","
            )
            for name in ("chosen_spans", "rejected_spans")
        }
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("recipe")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align_tokens(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are those of the first three kinds; ``spans`` has all kinds."""
    base = [rule.kind for rule in RULES[:3]]

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[
            F.size(of([kind])).cast("long").alias(f"n_{kind}")
            for kind in base
        ],
        F.sha2(spans_text(of(base)), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_counts": op6_token_counts,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_secret_scans": op13_secret_scans,
}

OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

# Words of a text as a list, for DuckDB.
WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
)

OP9_SQL = f"""
WITH i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
s AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k,
         unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                               lambda p: array_to_string(w[p:p + 4], ' '))) AS s
  FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
r AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2),
                                    lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)
SELECT doc_id, item_id, item_shingles, count(*) AS shared,
       count(*)::DOUBLE / item_shingles AS containment
FROM r JOIN s USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles
HAVING count(*)::DOUBLE / item_shingles >= 0.75
"""

RENDER = "'<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)"

OP7_SQL = f"""
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                       ORDER BY turn, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
o AS (
  SELECT conv_id, t[1] AS opening,
         coalesce(list_sum(list_transform(list_filter(t, lambda x: x.role = 'assistant'),
                                          lambda x: length(x.text))), 0) AS said
  FROM c),
r AS (SELECT *, (row_number() OVER (PARTITION BY opening ORDER BY conv_id) - 1) // 2 AS pair FROM o),
p AS (
  SELECT list(conv_id ORDER BY said DESC, conv_id) AS ids FROM r GROUP BY opening, pair),
b AS (
  SELECT ids[1] AS chosen_id, ids[2] AS rejected_id, a.t AS a, b.t AS b
  FROM p JOIN c a ON a.conv_id = ids[1] LEFT JOIN c b ON b.conv_id = ids[2]),
n AS (
  SELECT *, CASE WHEN b IS NULL
    THEN coalesce(list_max(list_filter(range(0, len(a)), lambda i: a[i + 1].role = 'assistant')), len(a))
    ELSE coalesce(list_min(list_filter(range(0, least(len(a), len(b))),
                                       lambda i: a[i + 1] <> b[i + 1])), least(len(a), len(b)))
    END AS k FROM b),
x AS (
  SELECT chosen_id, rejected_id, k, list_transform(a[1:k], lambda t: {RENDER}) AS p,
         a[k + 1:] AS a, b[k + 1:] AS b FROM n),
y AS (
  SELECT *, list_transform(a, lambda t: {RENDER}) AS ra, list_transform(b, lambda t: {RENDER}) AS rb
  FROM x),
z AS (
  SELECT *,
    list_transform(range(0, len(a)), lambda i: coalesce(list_sum(list_transform(ra[1:i], lambda s: length(s))), 0)) AS sa,
    list_transform(range(0, len(b)), lambda i: coalesce(list_sum(list_transform(rb[1:i], lambda s: length(s))), 0)) AS sb
  FROM y)
SELECT chosen_id, rejected_id, k::INT AS n_prompt, array_to_string(p, '') AS prompt,
  array_to_string(ra, '') AS chosen,
  array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant'),
    lambda i: (sa[i] + 14)::BIGINT || '-' || (sa[i] + length(ra[i]) - 1)::BIGINT), ',') AS chosen_spans,
  array_to_string(rb, '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'assistant'),
    lambda i: (sb[i] + 14)::BIGINT || '-' || (sb[i] + length(rb[i]) - 1)::BIGINT), ',') AS rejected_spans
FROM z
"""



def _spans_sql() -> str:
    """All spans: each match is set between two marks, so that lengths give its place."""
    kinds = []
    for rank, rule in enumerate(RULES):
        pattern, picked = rule.pattern.replace("'", "''"), f", {rule.group}" if rule.group else ""
        value = f"regexp_extract(m, '{pattern}'{picked})" if rule.group else "m"
        kinds.append(f"""
  SELECT r, {rank} AS rank, '{rule.kind}' AS kind, a, a + length(m) AS b FROM (
    SELECT r, split_part(p[i], chr(57345), 1) AS m,
           list_sum(list_transform(p[:i - 1], lambda x: length(x))) - (i - 2) AS a
    FROM (SELECT r, p, unnest(range(2, len(p) + 1)) AS i FROM (
      SELECT r, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'),
                             chr(57344)) AS p FROM d)))
  WHERE length({value}) >= {rule.least}""")
    return "\n  UNION ALL".join(kinds)


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql()}),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, rank) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

ORACLE_SQL = {
    "op7_chat_formatting": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op13_secret_scans": OP13_SQL,
}
