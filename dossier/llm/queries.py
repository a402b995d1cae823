"""The operators' registered queries and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import (
    bpe, counting, exact_dedup, hard_negatives, language, lines, neighbours, packing, phrases,
    repeats, simhash, threads, toxicity)
from dossier.llm.common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run
    return add


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of the packed sequences, their ids as a checksum."""
    return packing.pack(docs, BYTE_VOCABULARY).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query("op1_exact_dedup", """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op2_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
           FROM documents),
c AS (SELECT doc_id, pos, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS s
      FROM l WHERE trim(line) <> ''),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total,
             len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS words FROM c),
w AS (SELECT a.doc_id, a.s, a.s + 2 AS stop, a.pos AS first, z.pos AS last,
             a.t || chr(10) || b.t || chr(10) || z.t AS content
      FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.s = a.s + 1
      JOIN k z ON z.doc_id = a.doc_id AND z.s = a.s + 2
      UNION ALL SELECT a.doc_id, a.s, a.s + 1, a.pos, b.pos, a.t || chr(10) || b.t
      FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.s = a.s + 1 WHERE a.words + b.words >= 50 OR a.total = 2
      UNION ALL SELECT doc_id, s, s, pos, pos, t FROM k WHERE words >= 50 OR total = 1),
later AS (SELECT * FROM w
          QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, s) > 1),
apart AS (SELECT *, CASE WHEN s <= 1 + max(stop) OVER (PARTITION BY doc_id ORDER BY s, stop
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM later),
island AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, stop) AS n FROM apart),
runs AS (SELECT doc_id, min(first) AS first, max(last) AS last FROM island GROUP BY doc_id, n),
counts AS (SELECT doc_id, count(*) AS n_runs FROM runs GROUP BY doc_id),
kept AS (SELECT l.doc_id, count(*) AS n_kept, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
         FROM l WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = l.doc_id
                                  AND l.pos BETWEEN r.first AND r.last) GROUP BY l.doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10))) AS n_lines,
       len(string_split(coalesce(d.text, ''), chr(10))) - coalesce(k.n_kept, 0) AS n_removed,
       coalesce(n.n_runs, 0) AS n_runs, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts n USING (doc_id)""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated runs of lines."""
    removed = F.aggregate("removed_runs", F.lit(0), lambda n, r: n + r.last - r.first + 1)
    before = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", before.cast("long").alias("n_lines"))
    return lines.cut_runs(docs).select(
        "doc_id", "n_lines", removed.cast("long").alias("n_removed"),
        F.size("removed_runs").cast("long").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.encode(table(spark, sf_dir, "documents"), WORD_VOCABULARY).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories, and the documents that ``toxic`` rejects."""
    docs = table(spark, sf_dir, "documents")
    labels, categories = toxicity.categories_of(table(spark, sf_dir, "labels"))
    chain = toxicity.train(docs, labels, categories)
    cut = chain.cuts[categories.index("toxic")]
    return toxicity.score(docs, chain).select(
        "doc_id", *[F.round(f"p_{c}", 9).alias(f"p_{c}") for c in categories],
        (F.col("p_toxic") >= cut).alias("toxic"))


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query("op7_suffix_array", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS r FROM documents),
p AS (SELECT doc_id, r, unnest(range(1, len(r) - 48)) AS s FROM w WHERE len(r) >= 50),
k AS (SELECT doc_id, s, md5(array_to_string(r[s:s + 49], ' ')) AS stretch FROM p),
later AS (SELECT doc_id, s FROM k
          QUALIFY row_number() OVER (PARTITION BY stretch ORDER BY doc_id, s) > 1),
apart AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50
                    THEN 0 ELSE 1 END AS new FROM later),
island AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM apart)
SELECT doc_id, min(s) - 1 AS start_word, max(s) - min(s) + 50 AS n_words
FROM island GROUP BY doc_id, n""")
def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ``source_id``, which may be any earlier occurrence."""
    return repeats.repeated_spans(table(spark, sf_dir, "documents")).drop("source_id")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


@query("op8_chat", """
WITH m AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
own AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS words,
               turn - CASE WHEN (conv_id + turn) % 3 = 0 AND turn > 1 THEN 2 ELSE 1 END AS quoted
        FROM m),
linked AS (SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM own a
           JOIN own q ON q.conv_id = a.conv_id AND q.turn = a.quoted AND q.words <> ''
           JOIN own b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.words = q.words
           GROUP BY a.conv_id, a.turn),
tree AS (
  SELECT conv_id, turn, CAST(NULL AS BIGINT) AS parent, turn AS root, 0 AS depth FROM own
  WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM linked)
  UNION ALL
  SELECT l.conv_id, l.turn, l.parent, t.root, t.depth + 1 FROM linked l
  JOIN tree t ON t.conv_id = l.conv_id AND t.turn = l.parent)
SELECT o.conv_id, o.turn, o.role, t.parent, t.root, t.depth,
       sha256('<|' || o.role || '|>' || chr(10) || trim(o.text) || chr(10) || '<|end|>' || chr(10))
         AS formatted_sha256
FROM own o JOIN tree t USING (conv_id, turn)""".replace("WITH m", "WITH RECURSIVE m", 1))
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no quotations, so its turns are first written as mail that quotes."""
    mail = threads.as_mail(table(spark, sf_dir, "conversations"))
    return threads.conversations(mail).select(
        "conv_id", "turn", "role", "parent", "root", "depth",
        F.sha2(F.col("formatted").cast("binary"), 256).alias("formatted_sha256"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the source, the language and every line of every document."""
    return counting.count_tokens(table(spark, sf_dir, "documents"), BYTE_VOCABULARY,
                                 ["source", "lang", "text"], by_line=["text"])


@query("op11_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS s FROM w),
c AS MATERIALIZED (SELECT lang, k, array_to_string(ws[s:s + k - 1], ' ') AS phrase, count(*) AS f
      FROM g, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE s + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE f >= 30),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (
    SELECT f.lang, f.f, array_to_string(ws[b:b + size - 1], ' ') AS phrase
    FROM f, (VALUES (2), (3)) AS sizes(size), (VALUES (1), (2), (3)) AS starts(b)
    WHERE size < k AND b + size - 1 <= k) GROUP BY ALL),
cand AS (SELECT f.lang, f.k, f.phrase, f.ws, f.f AS a FROM f LEFT JOIN inside USING (lang, phrase)
         WHERE f.k > 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * f.f)),
parts AS MATERIALIZED (
  SELECT x.lang, x.phrase, x.a, b, array_to_string(x.ws[1:b], ' ') AS left_part,
         array_to_string(x.ws[b + 1:], ' ') AS right_part
  FROM cand x, (VALUES (1), (2), (3)) AS cuts(b) WHERE b < x.k),
cut AS (SELECT x.lang, x.phrase, x.a, b, l.f AS l, r.f AS r,
               (2000000::HUGEINT * x.a) // (l.f::HUGEINT + r.f) AS score
        FROM parts x JOIN f l ON l.lang = x.lang AND l.phrase = x.left_part
        JOIN f r ON r.lang = x.lang AND r.phrase = x.right_part),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, b) = 1),
ranked AS (SELECT *, row_number() OVER (
             PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op12_hard_negatives", """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
      AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved),
                               F.col("vec_id") % 50 == 0)


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language.train(docs, remainder != 2)
    return language.identify(docs, model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2,
                             F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
