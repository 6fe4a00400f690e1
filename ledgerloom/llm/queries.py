"""The named queries of the text operators: thin digests over their real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    chat_format,
    decontaminate,
    gap_heaps,
    lm_scores,
    packing,
    quality_rules,
    secret_scan,
    simhash_bk,
    surrogates,
    token_files,
    top_products,
    turn_repair,
    warc_archive,
)
from ledgerloom.session import pin
from ledgerloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- 3: SimHash near-dedup with BK-trees ------------------------------------------------------------------------------


@query
def op3_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


# --- 5: quality rule ledger -------------------------------------------------------------------------------------------


@query
def op5_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored once; both verdicts are bit tests on the stored bits."""
    book = pin(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    base, current = quality_rules.POLICIES[0], quality_rules.POLICIES[-1]
    bits = F.col("bits")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(bits, base)).alias("base_failed"),
        quality_rules.passes(bits, current).alias("kept"),
        "bits",
    )


_MEASURED = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) AS o(k) WHERE t.n > 1 GROUP BY r),
m AS (
  SELECT w.doc_id, w.r, len(words) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_upper_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM w LEFT JOIN c ON c.r = w.r),
n AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
          + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
          + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
          + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
          + (CASE WHEN 2 * n_upper_words > n_words THEN 16 ELSE 0 END)
          + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 32 ELSE 0 END)
          + (CASE WHEN 2 * n_letter_words < n_words THEN 64 ELSE 0 END) AS bits
  FROM n)
"""

ORACLE["op5_quality_ledger"] = _MEASURED + """
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS bits
FROM b
"""


@query
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does inside each policy version, from the stored ledger."""
    book = pin(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality_rules.ablations(book)


def _ablation_oracle() -> str:
    parts = []
    for p in quality_rules.POLICIES:
        whole = quality_rules.mask(p.rejects)
        for r in quality_rules.RULES:
            if r.name in p.rejects:
                parts.append(
                    f"SELECT '{p.version}' AS version, '{r.name}' AS rule, "
                    f"count(*) FILTER (WHERE (bits & {1 << r.bit}) <> 0) AS failed, "
                    f"count(*) FILTER (WHERE (bits & {whole}) = {1 << r.bit}) AS only, "
                    f"count(*) FILTER (WHERE (bits & {whole}) <> 0) AS rejected FROM b"
                )
    return _MEASURED + " UNION ALL ".join(parts)


ORACLE["quality_ablations"] = _ablation_oracle()


# --- 9: chat formatting -----------------------------------------------------------------------------------------------

_MARKS = "<|im_end|><|im_start|>assistant ok"


@query
def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_MARKS).alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.expand(given.unionByName(own)))


ORACLE["op9_prefix_targets"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_MARKS}' UNION ALL SELECT -1, 1, 'assistant', '{_MARKS}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
f AS (SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 1
             + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1 AS chars FROM o),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


# --- 10: secret scan --------------------------------------------------------------------------------------------------


@query
def op10_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin([r.name for r in secret_scan.RULES if r.base]))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )


# --- 7: token ids in coded files --------------------------------------------------------------------------------------


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op7_range_ans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read(token_files.write(docs, vocabulary("byte_bpe_50k.json"), 2))


# --- 8: best-fit packing ----------------------------------------------------------------------------------------------


@query
def op8_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)
    return packing.assign(cut).drop("pid")


# --- 6: context mixing ------------------------------------------------------------------------------------------------


@query
def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm_scores.held_out(F.col("doc_id"))
    model = lm_scores.train(docs.filter(~out))
    scored = lm_scores.score(docs, model)
    return scored.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


# --- 4: WARC archives and their merged index --------------------------------------------------------------------------


@query
def op4_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = warc_archive.runs(warc_archive.write(table(spark, sf_dir, "pages")))
    return warc_archive.merge(entries).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "part", "at"
    )


# --- 1: benchmark decontamination -------------------------------------------------------------------------------------


@query
def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- 2: PII surrogates ------------------------------------------------------------------------------------------------

#: Whoever runs this on real data brings a secret of their own; results under one key are stable.
SURROGATE_KEY = "example key"


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced, and how many there were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, SURROGATE_KEY, counted="n_entities")


# --- 11: exact top-k inner products -----------------------------------------------------------------------------------


@query
def op11_norm_sorted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op11_norm_sorted_products"] = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.r AS r, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q, v WHERE q.vec_id % 20 = 0 AND v.r <> q.r),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""


# --- 12: conversation structure repair --------------------------------------------------------------------------------


@query
def op12_streamed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations by a fixed rule, repairs them, and reports on every original one."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = turn_repair.digests(turn_repair.repair(turn_repair.damaged(given)))
    ids = given.select("conv_id").distinct()
    none = {"audit": "", "repaired_sha256": turn_repair.EMPTY_SHA256}
    names = [c for c in repaired.columns if c != "conv"]
    return ids.join(repaired, ids["conv_id"].eqNullSafe(repaired["conv"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(none.get(c, 0)).cast(repaired.schema[c].dataType)).alias(c) for c in names]
    )


# --- 13: centroid clustering ------------------------------------------------------------------------------------------


@query
def op13_gap_heap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows, centroids = gap_heaps.cluster(table(spark, sf_dir, "embeddings"), start)
    return gap_heaps.with_inertia(rows, centroids)


def _means_oracle(k: int = 40, rounds: int = 5, length: int = 64) -> str:
    """Plain k-means, one pair of steps per round: all distances, then componentwise floors of the means."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT c, e FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), e) - 1 AS c, e FROM v) WHERE c < {k})""",
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (
  SELECT r, min(d) AS d, arg_min(c, d * 64 + c) AS c FROM (
    SELECT r, c, list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c{t}.e) + list_inner_product(c{t}.e, c{t}.e) AS d FROM v, c{t}) GROUP BY r)"""
        )
        if t < rounds:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (
  SELECT c{t}.c, coalesce(m.e, c{t}.e) AS e FROM c{t} LEFT JOIN (
    SELECT c, list(floor(s / n) ORDER BY i) AS e FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT a{t}.c, unnest(range({length})) AS i, unnest(v.e) AS x FROM v JOIN a{t} USING (r)) GROUP BY c, i)
    GROUP BY c) AS m ON m.c = c{t}.c)"""
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(z.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} AS a USING (r) JOIN c{rounds} AS z ON z.c = a.c
"""


ORACLE["op13_gap_heap_means"] = _means_oracle()
