import json

from pyspark.sql import functions as F

from dossier import schemas
from dossier.operators import profiling, ranking
from dossier.plans import screening
from dossier.sources import files, store


def test_intake(spark, tmp_path):
    samples = {
        "good.txt": "a plain text of some length".encode(), "latin.txt": "résumé with enough text".encode("latin-1"),
        "short.txt": b"tiny", "big.txt": b"x" * (files.MAX_FILE_BYTES + 1),
        "page.pdf": b"%PDF-1.4 ...", "bundle.zip": b"PK\x03\x04....", "letter.docx": b"PK\x03\x04....",
        "tool.exe": b"MZ\x90\x00\x03", "blob.bin": b"\x00\x01\x02\x03"}
    for name, data in samples.items():
        (tmp_path / name).write_bytes(data)
    accepted, rejected = files.ingest_documents(spark, str(tmp_path / "*"))
    texts = {r.path.rsplit("/", 1)[-1]: r.text for r in accepted.collect()}
    assert texts == {"good.txt": "a plain text of some length", "latin.txt": "résumé with enough text"}
    reasons = {r.path.rsplit("/", 1)[-1]: r.reject_reason for r in rejected.collect()}
    assert reasons == {
        "short.txt": "not enough text", "big.txt": "413 too large",
        "page.pdf": "no text extractor", "bundle.zip": "415 zip archive", "letter.docx": "no text extractor",
        "tool.exe": "415 unsupported type", "blob.bin": "415 unsupported extension"}


def test_empty_file(spark):
    # a file scan skips empty files, so the check is for rows from elsewhere
    rows = spark.createDataFrame([("a.txt", None, 0, bytearray())],
                                 "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
    assert [r.reject_reason for r in files.split_files(rows)[1].collect()] == ["400 empty"]


def test_taxonomy_and_metrics(spark, tmp_path):
    path = tmp_path / "taxonomy.json"
    path.write_text(json.dumps({"SKILL_KEYWORDS": ["B", "A", "B"], "GENERIC_PHRASES": ["g"],
                                "JOB_CATEGORIES": {"X": ["r1", "r2"], "Y": ["r1"]}}, indent=1))
    terms, roles = files.load_taxonomy(spark, str(path))
    assert files.skill_list(terms) == ["A", "B"]
    assert {tuple(r) for r in roles.collect()} == {("X", "r1"), ("X", "r2"), ("Y", "r1")}
    broken = tmp_path / "broken.json"
    broken.write_text("{not json")
    assert files.load_taxonomy(spark, str(broken))[0].count() == 0
    metrics = tmp_path / "metrics.json"
    metrics.write_text(json.dumps({"test_accuracy": 0.9, "feature_importance": [
        {"feature": "a", "importance": 0.1}, {"feature": "b", "importance": 0.7}]}, indent=1))
    doc = files.read_metrics(spark, str(metrics))
    assert doc.first().test_accuracy == 0.9 and doc.first().test_f1_weighted == 0.0
    assert [r.feature for r in ranking.rank_importance(files.metric_importances(doc)).collect()] == ["b", "a"]


def test_training_csv(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_bytes("classification,skills,skill_density,other\nAuthentic,\"é, b\",1.5,x\n,,,\n".encode("latin-1"))
    df = files.read_training_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string", "double", "string"]
    assert df.first().skills == "é, b" and df.first().skill_density == 1.5


def test_history_round_trip(spark, tmp_path):
    rows = spark.range(30).select(
        F.col("id"), F.concat(F.lit("user"), F.col("id") % 3).alias("username"), F.lit("Authentic").alias("classification"),
        (F.col("id") / 30).alias("final_match_score"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 6)).alias("created_at"))
    path = str(tmp_path / "analyses")
    store.write_analyses(store.analysis_rows(rows), path)
    store.write_analyses(store.analysis_rows(rows.filter("id < 0")), path)
    saved = spark.read.schema(schemas.ANALYSES).parquet(path)
    page = store.history(saved, "user1", limit=4, offset=2).collect()
    assert [r.id for r in page] == [22, 19, 16, 13]
    keys = spark.createDataFrame([(1, "user1"), (2, "user1")], "id LONG, username STRING")
    left, missing = store.delete_analyses(saved, keys)
    assert left.count() == 29 and [tuple(r) for r in missing.collect()] == [(2, "user1")]
    store.export_history(saved, "user2", str(tmp_path / "out"), "csv")
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert out.columns == ["id", "filename", "classification", "final_match_score", "created_at"] and out.count() == 10
    assert "PartitionFilters: [isnotnull(username" in store.owned_by(
        saved, "user1")._jdf.queryExecution().executedPlan().toString()


def test_insert_and_evolve(spark):
    target = spark.createDataFrame([("ann", 1)], "name STRING, n INT")
    new = spark.createDataFrame([(" Ann ", 2), ("Bob", 5), ("BOB ", 3)], "name STRING, n INT")
    assert [tuple(r) for r in store.insert_if_absent(target, new, "name", "n").collect()] == [("bob", 3)]
    wide = store.evolve_schema(target, schemas.JOBS)
    assert wide.columns == ["job_id", "title", "description", "created_at", "name", "n"]
    df = spark.createDataFrame([("x", None), (None, "Authentic"), ("y", "Fake")], "error STRING, classification STRING")
    kept, failed = store.split_errors(df)
    assert kept.count() == 2 and failed.count() == 1


def test_sanitize_and_reports(spark, tmp_path):
    jobs = spark.createDataFrame([(1, " t " + "x" * 300, " d "), (2, None, "  ")],
                                 "job_id INT, title STRING, description STRING")
    rows = files.sanitize_jobs(jobs).collect()
    assert len(rows[0].title) == 200 and rows[0].reject_reason is None and rows[1].reject_reason == "no description"
    pred = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "y INT, yhat INT")
    report = profiling.classification_report(pred, "y", "yhat")
    importance = spark.createDataFrame([("a", 0.12345678)], "feature STRING, importance DOUBLE")
    long = {(r.section, r.name): r.value for r in store.metrics_long(
        profiling.scores(pred, "y", "yhat"), report, importance).collect()}
    assert long["1", "accuracy"] == 0.666667 and long["2", "a"] == 0.123457 and long["1b", "0.precision"] == 0.5
    nested = report.agg(F.collect_list(F.struct("*")).alias("report"))
    files.write_report(nested, str(tmp_path / "report"))
    assert len(spark.read.json(str(tmp_path / "report")).first().report) == 4


def test_feature_table_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, 7, "python developer")], "doc_id LONG, job_id LONG, text STRING")
    jobs = spark.createDataFrame([(7, "", "python")], "job_id LONG, title STRING, description STRING")
    store.write_features(screening.feature_table(docs, jobs), str(tmp_path / "features"))
    assert len(spark.read.parquet(str(tmp_path / "features")).columns) == 19


def test_deletes_rewrite_only_touched_owners(spark, tmp_path):
    path = str(tmp_path / "store")
    owners = ["ann", "b/c=d", "e f", None]
    rows = spark.createDataFrame([(k, owners[k % 4], "x") for k in range(16)], "id LONG, username STRING, classification STRING")
    store.write_analyses(rows, path)

    def files_of():
        return {(r.username, r.f) for r in spark.read.schema(rows.schema).parquet(path).select(
            "username", F.input_file_name().alias("f")).distinct().collect()}

    before = files_of()
    keys = spark.createDataFrame([(4, "ann"), (4, "e f"), (99, "ann"), (1, "b/c=d"), (5, "b/c=d"), (9, "b/c=d"),
                                  (13, "b/c=d"), (3, None)], "id LONG, username STRING")
    missing = store.delete_stored(spark, path, keys, rows.schema)
    assert sorted((r.id, r.username or "") for r in missing.collect()) == [(3, ""), (4, "e f"), (99, "ann")]
    left = store.read_analyses(spark, path, rows.schema)
    assert sorted(r.id for r in left.collect()) == [0, 2, 3, 6, 7, 8, 10, 11, 12, 14, 15]
    same = lambda found: {x for x in found if x[0] in ("e f", None)}
    assert same(files_of()) == same(before) and "b/c=d" not in {o for o, _ in files_of()}
    assert store.delete_stored(spark, path, keys.limit(0), rows.schema).count() == 0
    assert left.count() == 11
    wider = spark.createDataFrame([(20, "ann", "x", 1.5)], "id LONG, username STRING, classification STRING, note DOUBLE")
    store.write_analyses(wider, path)
    both = {r.id: r.note for r in store.read_analyses(spark, path).collect()}
    assert len(both) == 12 and both[20] == 1.5 and both[0] is None
