"""What a plan sends to every task, and over how many tasks it deals its work."""

from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import matching as M
from dossier.operators import training
from dossier.plans import screening
from dossier.session import spread_rows
from dossier.sources import store


def _built_texts(spark):
    """Long texts that the optimizer takes for small ones: it knows the ids' bytes only."""
    return spark.range(50).select(F.col("id").alias("doc_id"), X.fold(F.concat(
        F.repeat(F.lit("filler words "), 40), F.lit("High School and B.Tech, phd"))).alias("folded"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _broadcast_parts(plan):
    """The subtrees below each broadcast, by indentation."""
    lines, parts = plan.splitlines(), []
    for i, line in enumerate(lines):
        at = line.find("BroadcastExchange")
        if at >= 0:
            below = []
            for later in lines[i + 1:]:
                if len(later) - len(later.lstrip(" :+-|")) <= at:
                    break
                below.append(later)
            parts.append("\n".join(below))
    return parts


def test_texts_are_never_broadcast_to_meet_a_dictionary(spark):
    dim = M.term_dimension(M.builtin_terms(spark).filter("kind = 'education'"))
    for df in (M.match_terms(_built_texts(spark), dim), M.match_terms_longest(_built_texts(spark), dim)):
        parts = _broadcast_parts(_plan(df))
        assert parts and not any("Range" in p for p in parts)


def test_large_dictionary_gives_the_same_terms(spark, monkeypatch):
    dim = M.term_dimension(M.builtin_terms(spark).filter("kind = 'education'"))
    docs = _built_texts(spark)
    held = [sorted(map(tuple, f(docs, dim).collect())) for f in (M.match_terms, M.match_terms_longest)]
    monkeypatch.setattr(M, "HELD_TERMS", 0)
    merged = [M.match_terms(docs, dim), M.match_terms_longest(docs, dim)]
    assert "BroadcastHashJoin" not in _plan(merged[0])
    assert held == [sorted(map(tuple, df.collect())) for df in merged]
    assert {r[2] for r in held[0]} == {"high school", "school", "b.tech", "phd"}


def test_exploded_words_are_never_broadcast_to_meet_collocations(spark, monkeypatch):
    docs = _built_texts(spark).withColumn("words", X.content_words(F.col("folded")))
    mined = M.candidate_phrases(docs)
    assert not any("Generate" in p for p in _broadcast_parts(_plan(mined)))
    held = sorted(map(tuple, mined.collect()))
    monkeypatch.setattr(M, "HELD_TERMS", 0)
    merged = M.candidate_phrases(docs)
    assert "Broadcast" not in _plan(merged)
    assert held == sorted(map(tuple, merged.collect())) and len(held) > 50
    assert (7, "school tech phd") in held


def test_hits_of_short_texts_are_grouped_without_a_search_for_gaps(spark, monkeypatch):
    dim = M.term_dimension(M.builtin_terms(spark).filter("kind = 'education'"))
    texts = [(1, "phd high school"), (2, "filler " * 40 + "high school of b.tech" + " phd" * 9),
             (None, "high school"), (None, "word " * 20 + "phd high school"), (2, "phd"), (3, "none")]
    docs = spark.createDataFrame(texts, "doc_id long, folded string")
    searched, clusters = [], M.hit_clusters
    monkeypatch.setattr(M, "hit_clusters", lambda hits, *rest: (
        searched.append(hits.count()) or clusters(hits, *rest)))
    held = sorted(M.match_terms_longest(docs, dim).collect(), key=str)
    monkeypatch.setattr(M, "BLOCK", 8)
    cut = sorted(M.match_terms_longest(docs, dim).collect(), key=str)
    assert searched[0] == 0 < searched[1] and held == cut and len(held) > 12


def test_rows_of_one_part_are_dealt_by_their_number(spark):
    dealt = spread_rows(spark.range(0, 1000, 1, 1).toDF("k"), rows=50)
    sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert dealt.rdd.getNumPartitions() == 20 and max(sizes) < 200


def test_facts_of_many_targets_are_merged_not_broadcast(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.col("id").alias("job_id"),
                                  F.lit("led a team").alias("text"))
    jobs = spark.range(screening.HELD_TARGETS + 1).select(
        F.col("id").alias("job_id"), F.lit("Auditor").alias("title"), F.lit("led teams").alias("description"))
    vecs = lambda df, key: df.select(key, F.array(F.lit(1.0)).alias("vec"))
    scored = screening.score(docs, jobs, doc_vectors=vecs(docs, "doc_id"), job_vectors=vecs(jobs, "job_id"))
    merges = [line for line in _plan(scored).splitlines() if "SortMergeJoin" in line]
    assert any("job_id" in line and "Inner" in line for line in merges)
    assert scored.count() == 10


def test_only_beginnings_of_terms_are_built_and_hits_read_once(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, "b b")], "doc_id INT, folded STRING")
    found = M.token_grams(docs, [1, 2], firsts=["a"]).collect()
    assert sorted((r.doc_id, r.pos, r.gram) for r in found) == [(1, 0, "a"), (1, 0, "a b"), (1, 3, "a")]
    assert M.token_grams(docs, [1]).count() == 6
    dim = M.term_dimension(M.builtin_terms(spark).filter("kind = 'education'"))
    # four branches read the hits; none goes back to the texts
    assert "Range" not in _plan(M.match_terms_longest(_built_texts(spark), dim))


def test_owners_of_few_rows_are_dealt_over_all_tasks(spark, monkeypatch):
    """Parts made by size would put all owners of a small table into one task."""
    rows = spark.range(400).select("id", (F.col("id") % 40).cast("string").alias("username"))
    dealt = store._gathered(rows)

    def tasks_of(df):
        found = {}
        for r in df.select("username", F.spark_partition_id().alias("p")).collect():
            found.setdefault(r.username, set()).add(r.p)
        return found

    found = tasks_of(dealt)
    assert all(len(p) == 1 for p in found.values()) and len(set().union(*found.values())) > 4
    assert dealt.count() == 400
    monkeypatch.setattr(store, "ROWS_PER_FILE", 100)
    hot = tasks_of(store._gathered(spark.range(400).select("id", F.when(F.col("id") >= 390, "ann").alias("username"))))
    assert len(hot["ann"]) == 1 and 1 < len(hot[None]) <= 4


def test_a_delete_reads_the_store_once(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path / "store"), []
    rows = spark.range(20).select("id", (F.col("id") % 4).cast("string").alias("username"))
    store.write_analyses(rows, path)
    once = store.write_once

    def watched(df):
        read.append(_plan(df).count(f"[file:{path}]"))
        return once(df)

    monkeypatch.setattr(store, "write_once", watched)
    missing = store.delete_stored(spark, path, rows.filter("id in (1, 5)").unionByName(
        spark.createDataFrame([(5, "0"), (None, "1")], "id long, username string")), rows.schema)
    assert sum(read) == 1 and sorted(tuple(r) for r in missing.collect() if r.id) == [(5, "0")]
    assert sorted(r.id for r in store.read_analyses(spark, path, rows.schema).collect()) == [
        k for k in range(20) if k not in (1, 5)]


def test_an_encoder_reads_its_texts_once(spark):
    words = _built_texts(spark).select("doc_id", X.content_words(F.col("folded")).alias("words"))
    done, _ = training.embed(words, "words")
    assert "Range" not in _plan(done) and done.columns == ["doc_id", "words", "vec"] and done.count() == 50
