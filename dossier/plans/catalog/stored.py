"""Stored analyses, intake checks and keyed inserts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import schemas
from dossier.operators import profiling
from dossier.plans import inputs as I
from dossier.plans.catalog import query
from dossier.plans.catalog.profiles import REPORT_SQL, importance, predictions
from dossier.sources import files, store

# events as stored analyses: the user is the owner, the time of the event its creation
_LABEL = ("case event_type when 'purchase' then 'Authentic' when 'view' then 'Suspicious' "
          "when 'click' then 'Potentially Fake' when 'signup' then 'Not a Resume' end")
_ERROR = "case when event_type = 'error' then 'failed' end"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
ANALYSES_SQL = (f"WITH a AS (SELECT event_id AS id, user_id AS job_id, concat('file', event_id, '.txt') AS filename, "
                f"concat('user', user_id) AS username, value / 500 AS final_match_score, {_LABEL} AS classification, "
                f"{_ERROR} AS error, ts, {_ISO} AS created_at FROM events)")


def analyses(spark, d):
    return I.table(spark, d, "events").selectExpr(
        "event_id AS id", "user_id AS job_id", "concat('file', event_id, '.txt') AS filename",
        "concat('user', user_id) AS username", "value / 500 AS final_match_score",
        f"{_LABEL} AS classification", f"{_ERROR} AS error", "ts AS created_at")


def _iso(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))


@query("s7_sanitize_documents", """SELECT doc_id, CASE WHEN text IS NULL OR length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) < 20
 THEN 'not enough text' END AS reject_reason FROM documents""")
def sanitize_docs(spark, d):
    return files.sanitize_documents(I.table(spark, d, "documents")).select("doc_id", "reject_reason")


@query("s7_sanitize_jobs", f"""WITH {I.POSTINGS_SQL} SELECT job_id, substr(trim(title), 1, 200) AS title, substr(trim(description), 1, 3000) AS description,
 CASE WHEN trim(description) = '' THEN 'no description' END AS reject_reason FROM postings""")
def sanitize_jobs(spark, d):
    return files.sanitize_jobs(I.postings(spark, d))


# pages as uploads of every kind: PDF, archive, program, empty, control characters, text
_HEADS = {0: "%PDF-1.7 ", 1: "PK\x03\x04", 2: "MZ\x90 ", 4: "\x01\x02"}
_UPLOAD = "concat('upload', page_id, element_at(array('.pdf', '.txt', '.docx', '.exe', ''), cast(page_id % 5 + 1 as int)))"
_LIMIT = 8000


@query("s4_reject_reasons", rf"""WITH p AS (SELECT page_id, page_id % 7 AS m, page_id % 5 AS e,
 CASE page_id % 7 WHEN 3 THEN 0 WHEN 0 THEN strlen(html) + 9 WHEN 1 THEN strlen(html) + 4 WHEN 2 THEN strlen(html) + 5 WHEN 4 THEN strlen(html) + 2 ELSE strlen(html) END AS n FROM pages)
SELECT page_id, n AS length, CASE WHEN n > {_LIMIT} THEN '413 too large' WHEN n = 0 THEN '400 empty' WHEN m = 2 THEN '415 unsupported type'
 WHEN m = 4 AND e IN (3, 4) THEN '415 unsupported extension' WHEN m = 1 AND e <> 2 THEN '415 zip archive' END AS reject_reason FROM p""")
def reject_reasons(spark, d):
    head = F.coalesce(*[F.when(F.col("page_id") % 7 == k, F.lit(h)) for k, h in _HEADS.items()], F.lit(""))
    content = F.when(F.col("page_id") % 7 == 3, "").otherwise(F.concat(head, "html")).cast("binary")
    files_ = I.table(spark, d, "pages").select(
        "page_id", F.expr(_UPLOAD).alias("path"), content.alias("content"))
    return files_.select(
        "page_id", F.octet_length("content").alias("length"),
        files.reject_reason(F.col("path"), F.octet_length("content"), F.col("content"), _LIMIT).alias("reject_reason"))


@query("s5_decode_text", "SELECT doc_id, length(text) AS n, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS digest FROM documents")
def decode(spark, d):
    # half of the documents are re-encoded to Latin-1 where that is possible
    content = F.when((F.col("doc_id") % 2 == 0) & ~F.col("text").rlike(r"[^\x00-\xFF]"),
                     F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return I.table(spark, d, "documents").select(
        "doc_id", F.length("text").alias("n"), F.md5(files.decode_text(content)).alias("digest"))


@query("s6_file_kind", r"""WITH e AS (SELECT page_id, regexp_extract(lower(url), '\.([^./]*)$', 1) AS extension FROM pages)
SELECT page_id, extension, CASE WHEN extension = 'pdf' THEN 'pdf' WHEN extension IN ('docx', 'doc') THEN 'docx' ELSE 'txt' END AS kind FROM e""")
def kinds(spark, d):
    url = F.col("url")
    return I.table(spark, d, "pages").select(
        "page_id", files.extension(url).alias("extension"), files.file_kind(url).alias("kind"))


@query("s8_analysis_rows", f"""{ANALYSES_SQL} SELECT id, job_id, filename, username, final_match_score, 5e-1 AS ai_plausibility_score,
 classification, created_at FROM a WHERE NOT (error IS NOT NULL AND classification IS NULL)""")
def analysis_rows(spark, d):
    kept, _ = store.split_errors(analyses(spark, d))
    return _iso(store.analysis_rows(kept)).drop("candidate_name", "full_results")


@query("p4_split_errors", f"{ANALYSES_SQL} SELECT id, error FROM a WHERE error IS NOT NULL AND classification IS NULL")
def failed(spark, d):
    return store.split_errors(analyses(spark, d))[1].select("id", "error")


@query("s9_history_page", f"""{ANALYSES_SQL} SELECT id, filename, classification, final_match_score, created_at FROM
 (SELECT * FROM a WHERE username = 'user7' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 10)""")
def history(spark, d):
    return _iso(store.history(store.evolve_schema(analyses(spark, d), schemas.ANALYSES), "user7", 50, 10)).select(
        "id", "filename", "classification", "final_match_score", "created_at")


@query("p3_owned_by", f"{ANALYSES_SQL} SELECT id, username FROM a WHERE username = 'user3'")
def owned(spark, d):
    return store.owned_by(analyses(spark, d), "user3").select("id", "username")


# deletion requests: one for every order, by the order's customer
_REQUESTS = "SELECT o_orderkey AS id, concat('user', o_custkey % 100) AS username FROM orders"


def _requests(spark, d):
    return I.table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat('user', o_custkey % 100) AS username")


@query("s10_delete_remaining", f"{ANALYSES_SQL}, q AS ({_REQUESTS}) SELECT a.id, a.username FROM a ANTI JOIN q ON a.id = q.id AND a.username = q.username")
def remaining(spark, d):
    return store.delete_analyses(analyses(spark, d), _requests(spark, d))[0].select("id", "username")


@query("s10_delete_not_found", f"{ANALYSES_SQL}, q AS ({_REQUESTS}) SELECT q.id, q.username FROM q ANTI JOIN a ON a.id = q.id AND a.username = q.username")
def not_found(spark, d):
    return store.delete_analyses(analyses(spark, d), _requests(spark, d))[1]


@query("j7_cascade_delete", f"{ANALYSES_SQL} SELECT id, job_id FROM a SEMI JOIN customer ON c_custkey = job_id AND c_acctbal >= 0")
def cascade(spark, d):
    jobs = I.table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("job_id"))
    return store.cascade_delete(analyses(spark, d), jobs).select("id", "job_id")


@query("j7_with_jobs", f"{ANALYSES_SQL} SELECT id, job_id, c_name AS title FROM a LEFT JOIN customer ON c_custkey = job_id")
def with_jobs(spark, d):
    jobs = I.table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("title"))
    return store.with_jobs(analyses(spark, d), jobs).select("id", "job_id", "title")


@query("s11_export_rows", f"{ANALYSES_SQL} SELECT id, filename, classification, final_match_score, created_at FROM a WHERE username = 'user5'")
def export(spark, d):
    return store.export_rows(analyses(spark, d), "user5")


_PER = ("SELECT '1b' AS section, CAST(label AS VARCHAR) || '.{0}' AS name, round({0}, 6) AS value FROM f "
        "UNION ALL SELECT '1b', 'macro avg.{0}', round(avg({0}), 6) FROM f "
        "UNION ALL SELECT '1b', 'weighted avg.{0}', round(sum({0} * support) / sum(support), 6) FROM f")
_WEIGHT = "SELECT '2', '{0}', round(abs(corr({0}, l_extendedprice)), 6) FROM lineitem"


@query("s12_metrics_long", f"{REPORT_SQL} " + " UNION ALL ".join(
    [_PER.format(c) for c in ("precision", "recall", "f1")]
    + ["SELECT '1', 'accuracy', round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) FROM f",
       "SELECT '1', 'f1_weighted', round(sum(f1 * support) / sum(support), 6) FROM f"]
    + [_WEIGHT.format(c) for c in ("l_quantity", "l_discount", "l_tax")]))
def metrics(spark, d):
    p = predictions(spark, d)
    return store.metrics_long(profiling.scores(p, "y", "yhat"),
                              profiling.classification_report(p, "y", "yhat"), importance(spark, d))


@query("s13_evolve_schema", "SELECT event_id, CAST(value AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS username, event_type FROM events")
def evolve(spark, d):
    target = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("username", T.StringType())])
    return store.evolve_schema(I.table(spark, d, "events").select("event_id", "value", "event_type"), target)


# incoming names repeat; the suppliers of nation 0 are registered already
@query("s15_insert_if_absent", """WITH i AS (SELECT lower(p_name) AS name, p_partkey FROM part)
SELECT name, min(p_partkey) AS p_partkey FROM i ANTI JOIN (SELECT lower(p_name) AS name FROM part WHERE p_size = 1) t USING (name) GROUP BY name""")
def insert_new(spark, d):
    part = I.table(spark, d, "part")
    incoming = part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("name"), "p_partkey")
    known = part.filter("p_size = 1").select(F.col("p_name").alias("name"))
    return store.insert_if_absent(known, incoming, "name", "p_partkey")


@query("s16_exists_by_key", "SELECT id, username FROM (" + _REQUESTS + """) q SEMI JOIN
 (SELECT event_id AS id, concat('user', user_id) AS username FROM events) a USING (id, username)""")
def exists(spark, d):
    return store.exists_by_key(_requests(spark, d), analyses(spark, d), ["id", "username"])


@query("hash_pseudonyms", "SELECT c_custkey, sha256(c_name) AS pseudonym FROM customer")
def pseudonyms(spark, d):
    from dossier.functions.text import pseudonym

    return I.table(spark, d, "customer").select("c_custkey", pseudonym(F.col("c_name")).alias("pseudonym"))
