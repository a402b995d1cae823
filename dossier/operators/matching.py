"""Dictionary matching as joins, for dictionaries of any size."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier import lexicon as L
from dossier.functions import text as X
from dossier.functions.numeric import cap, let, round_exact
from dossier.functions.terms import TermSet
from dossier.functions.vectors import cosine
from dossier.session import spread_rows, write_once

WORD = r"([a-z0-9_]+)"
TOKEN = r"([a-z0-9_]+|[^a-z0-9_\s])"


def term_dimension(terms: DataFrame) -> DataFrame:
    """(kind, term) -> dim_term with the columns the joins need."""
    low = X.fold(F.col("term"))
    quoted = F.regexp_replace(low, r"([\^$.|?*+()\[\]{}\\])", r"\\$1")
    edge = lambda ch: F.when(ch.rlike(r"\w"), F.lit(r"\b")).otherwise(F.lit(r"\B"))
    return terms.select("kind", "term").distinct().select(
        "kind", "term", low.alias("term_lc"),
        F.regexp_extract(low, WORD, 1).alias("first_token"),
        F.regexp_extract_all(low, F.lit(TOKEN)).alias("tokens"),
        F.concat(edge(F.left(low, F.lit(1))), quoted,
                 edge(F.right(low, F.lit(1)))).alias("pattern"))


def builtin_terms(spark: SparkSession, skills=None) -> DataFrame:
    """(kind, term) rows of the built-in word lists."""
    kinds = {"skill": skills or L.default_skills(), "generic": L.GENERIC_PHRASES,
             "education": L.EDUCATION_TERMS,
             "job_title": sorted({r for rs in L.JOB_CATEGORIES.values() for r in rs})}
    rows = [(kind, term) for kind, terms in kinds.items() for term in terms]
    return spark.createDataFrame(rows, "kind STRING, term STRING")


HELD_TERMS = 10_000     # terms of a dictionary that is sent to every task


def match_terms(docs: DataFrame, dim: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind, term) for every term present; overlapping terms all kept.

    ``docs`` has ``key`` and ``folded``; ``dim`` comes from ``term_dimension``.  The
    distinct words of a text meet the dictionary on the term's first word.  A term of one word
    is then found; candidates of longer terms are verified in the text.

    A dictionary of up to HELD_TERMS terms is broadcast: one pass, no shuffle.  A larger one
    is merged with narrow (key, word) rows, and its candidates meet the text again.  Either way by hint: the optimizer estimates texts
    that are built in the plan by the bytes of the file they come from, and would broadcast them.
    """
    # explode_outer: the plain form would evaluate the words a second time in a filter
    words = F.explode_outer(F.array_distinct(F.regexp_extract_all("folded", F.lit(WORD))))
    out = [key, "kind", "term"]
    whole = F.col("term_lc") == F.col("first_token")
    verifies = F.contains("folded", F.col("term_lc")) & F.rlike("folded", F.col("pattern"))
    if dim.limit(HELD_TERMS + 1).count() <= HELD_TERMS:
        met = docs.select(key, "folded", words.alias("first_token")).join(F.broadcast(dim), "first_token")
        return met.filter(whole | verifies).select(*out)
    candidates = docs.select(key, words.alias("first_token")).hint("merge").join(dim, "first_token")
    longer = candidates.filter(~whole).groupBy(key).agg(F.collect_set(F.struct(
        "kind", "term", "term_lc", "pattern")).alias("terms"))
    verified = (docs.select(key, "folded").hint("merge").join(longer, key)
                .select(key, "folded", F.inline("terms")).filter(verifies))
    return candidates.filter(whole).select(*out).unionByName(verified.select(*out))


BLOCK = 4096        # tokens of a text that are worked on together


def token_grams(docs: DataFrame, sizes: list[int], key: str = "doc_id",
                firsts: list[str] | None = None) -> DataFrame:
    """(key, pos, n_tokens, gram): the tokens from every position on, for each of ``sizes``; with
    ``firsts``, from the positions of these tokens only.

    Texts are cut into blocks of tokens first, so a row holds a bounded stretch of them.
    """
    longest, tokens = max(sizes), F.regexp_extract_all("folded", F.lit(TOKEN))
    # a filter on the number of tokens would be pushed down and extract them a second time
    last = F.greatest(F.lit(0), F.floor((F.size("_t") - 1) / F.lit(BLOCK)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(
        (b * BLOCK).alias("at"), F.slice("_t", b * BLOCK + 1, F.lit(BLOCK + longest - 1)).alias("part")))
    parts = docs.select(key, tokens.alias("_t")).select(key, F.inline_outer(cut))
    starts = F.transform(F.slice("part", 1, BLOCK), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    if firsts is not None:
        starts = F.filter(starts, lambda x: x.t.isin(firsts))
    grams = F.flatten(F.transform(starts, lambda x: F.array(*[
        F.struct((F.col("at") + x.i).alias("pos"), F.lit(n).alias("n_tokens"),
                 F.when(x.i + n <= F.size("part"), F.array_join(F.slice("part", x.i + 1, n), " "))
                 .alias("gram")) for n in sizes])))
    return parts.select(key, F.inline_outer(grams)).filter(F.col("gram").isNotNull())


def hit_clusters(hits: DataFrame, longest: int, key: str = "doc_id") -> DataFrame:
    """Adds ``cluster``: the position from which a hit is linked to it by overlapping hits.

    A text is cut where no hit lies across.  Blocks of positions are searched apart: a hit
    reaches into the next block at most, and a block without a cut takes the last one before
    it, found among one row per block.
    """
    size = max(BLOCK, longest)
    end = F.col("pos") + F.col("n_tokens")
    block = F.floor(F.col("pos") / size)
    own = hits.withColumn("_end", end).withColumn("_block", block).withColumn("_in", F.lit(False))
    over = own.filter(F.col("_end") > (F.col("_block") + 1) * size).withColumn(
        "_block", F.col("_block") + 1).withColumn("_in", F.lit(True))
    inside = Window.partitionBy(key, "_block").orderBy("pos", F.desc("_in"))
    reach = F.max("_end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    starts = own.unionByName(over).withColumn("_reach", reach).withColumn(
        "_start", F.when(~F.col("_in") & F.coalesce(F.col("_reach") <= F.col("pos"), F.lit(True)),
                         F.col("pos")))
    marked = starts.withColumn("_own", F.max("_start").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = marked.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(
        F.max("_start").alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("_key", "_b", F.max("_last").over(earlier).alias("_before"))
    linked = marked.filter(~F.col("_in")).join(
        before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    return linked.withColumn("cluster", F.coalesce("_own", "_before")).select(*hits.columns, "cluster")


def _first_come(batches):
    """Rows sorted by text, cluster and rank: a hit stays unless a token of it is taken."""
    last, taken = None, set()
    for batch in batches:
        groups = zip(*(batch.column(c).to_pylist() for c in (0, "cluster", "pos", "n_tokens")))
        kept = []
        for text, cluster, pos, n in groups:
            if (text, cluster) != last:
                last, taken = (text, cluster), set()
            span = range(pos, pos + n)
            kept.append(taken.isdisjoint(span))
            if kept[-1]:
                taken.update(span)
        yield batch.filter(pa.array(kept, pa.bool_()))


def _competing(hits: DataFrame, longest: int, key: str) -> DataFrame:
    """Adds ``cluster`` to written hits: 0 for a text whose hits all end in the first block, which
    no search for gaps has to cut, and as ``hit_clusters`` for the others."""
    size = max(BLOCK, longest)
    far = write_once(hits.filter(F.col("pos") + F.col("n_tokens") > size).select(
        F.col(key).alias("_far")).distinct())
    whole = F.lit(0).cast(hits.schema["pos"].dataType)
    among, same = held_or_merged(far), F.col(key).eqNullSafe(F.col("_far"))
    return hits.join(among, same, "left_anti").withColumn("cluster", whole).unionByName(
        hit_clusters(hits.join(among, same, "left_semi"), longest, key))


def match_terms_longest(docs: DataFrame, dim: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind, term, pos, n_tokens): terms compete, longest first, then leftmost;
    a token belongs to one term at most.

    The grams of every text meet the dictionary in one equi-join, for terms of each length; a
    dictionary that is broadcast names the tokens that begin a term, and only their grams are
    built.  Hits that overlap, directly or through others, compete in a group of their own, so a
    text with very many hits is spread over tasks; the hits of a text that ends within a block
    are one group.  They are written once: the groups of long texts read them four times.
    """
    small = dim.select("kind", "term", F.size("tokens").alias("n_tokens"),
                       F.array_join("tokens", " ").alias("gram"),
                       F.get("tokens", F.lit(0)).alias("first_token")).filter("n_tokens > 0")
    # as many rows as there are lengths of terms
    sizes = sorted(r[0] for r in small.select("n_tokens").distinct().collect()) or [1]
    # by hint, as in ``match_terms``: the estimate of the grams knows nothing of the texts
    if small.limit(HELD_TERMS + 1).count() <= HELD_TERMS:
        firsts = [r[0] for r in small.select("first_token").distinct().collect()]
        met = token_grams(docs, sizes, key, firsts).join(F.broadcast(small), ["n_tokens", "gram"])
    else:
        met = token_grams(docs, sizes, key).hint("merge").join(small, ["n_tokens", "gram"])
    hits = write_once(met.select(key, "kind", "term", "pos", "n_tokens"))
    groups = _competing(hits, max(sizes), key)
    ranked = groups.repartition(key, "cluster").sortWithinPartitions(
        key, "cluster", F.desc("n_tokens"), "pos", "kind", "term")
    return ranked.mapInArrow(_first_come, ranked.schema).drop("cluster")


def generic_phrase_score(folded: Column, phrases=None, words: Column | None = None) -> Column:
    """Distinct stock phrases per hundred words (at least one hundred), cap 1; ``words``: their
    number, when it is known."""
    hits = TermSet(phrases or L.GENERIC_PHRASES).count(folded)
    return let(X.word_count(folded) if words is None else words, lambda words: F.when(words == 0, F.lit(0.0)).otherwise(
        round_exact(cap(hits / F.greatest(words * F.lit(0.01), F.lit(1.0)), 1.0), 4)))


SEEDS, AT_ONCE = 1000, 16


def nearest_seed(vectors: DataFrame, seeds: DataFrame, threshold: float = 0.82,
                 block: int = SEEDS) -> DataFrame:
    """Adds best_seed, best_sim and admitted (best_sim > threshold).

    ``vectors`` has ``vec``; ``seeds`` has (seed_id, vec), in any number: they are broadcast in
    blocks of ``block``, AT_ONCE blocks to a pass, and every pass keeps a vector's best so far.
    The vectors are never shuffled.
    """
    names = vectors.columns
    best = vectors.select("*", F.lit(None).cast("struct<sim:double,neg_id:bigint>").alias("_best"))
    own = seeds.select("seed_id", "vec").distinct()
    blocks = -(-own.count() // block)
    for number in range(blocks):
        held = own.filter(F.pmod(F.xxhash64("seed_id", "vec"), F.lit(blocks)) == number).groupBy().agg(
            F.array_sort(F.collect_list(F.struct("seed_id", "vec"))).alias("_seeds"))
        found = F.array_max(F.transform("_seeds", lambda s: F.struct(
            cosine(F.col("vec"), s.vec).alias("sim"), (-s.seed_id).alias("neg_id"))))
        best = best.join(F.broadcast(held), F.lit(True)).select(     # one row of about ``block`` seeds
            *names, F.greatest("_best", found).alias("_best"))
        if number % AT_ONCE == AT_ONCE - 1 and number + 1 < blocks:
            best = write_once(best)
    return best.select(
        *names, (-F.col("_best.neg_id")).alias("best_seed"), F.col("_best.sim").alias("best_sim"),
        F.coalesce(F.col("_best.sim") > threshold, F.lit(False)).alias("admitted"))


def _pairs(docs: DataFrame, key: str) -> DataFrame:
    """(key, pos, a, b): neighbouring words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.struct(
        i.alias("pos"), F.get("words", i).alias("a"), F.get("words", i + 1).alias("b")))
    return docs.filter(F.size("words") > 1).select(key, F.inline(pairs))


def held_or_merged(df: DataFrame) -> DataFrame:
    """A written table, hinted for a join: one of up to HELD_TERMS rows is broadcast, a larger one
    merged.  The estimate of exploded rows on the other side knows nothing of their number."""
    return F.broadcast(df) if df.limit(HELD_TERMS + 1).count() <= HELD_TERMS else df.hint("merge")


def collocations(docs: DataFrame, key: str = "doc_id", least: int = 5, score: float = 3.0
                 ) -> DataFrame:
    """(a, b): words that stand together ``least`` times or more, and ``score`` times as often as
    their own counts would have it; written once."""
    counts = docs.select(F.explode("words").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))     # one row
    return write_once(
        _pairs(docs, key).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
        .filter(F.col("together") >= least)
        .join(counts.hint("merge"), "a").withColumnRenamed("n", "na")
        .join(counts.withColumnsRenamed({"a": "b", "n": "nb"}).hint("merge"), "b")
        .join(F.broadcast(total), F.lit(True))
        .filter(F.col("together") * F.col("all") >= score * F.col("na") * F.col("nb"))
        .select("a", "b"))


def _phrases(docs: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, phrase): words, collocations of ``held`` and their chains of three, repeats too."""
    found = write_once(_pairs(docs, key).join(held_or_merged(held), ["a", "b"]).select(
        key, "pos", "a", "b"))
    two = found.select(key, F.concat_ws(" ", "a", "b").alias("phrase"))
    later = found.select(key, (F.col("pos") - 1).alias("pos"), F.col("b").alias("c"))
    three = found.join(later.hint("merge"), [key, "pos"]).select(
        key, F.concat_ws(" ", "a", "b", "c").alias("phrase"))
    one = docs.select(key, F.explode("words").alias("phrase"))
    return one.unionByName(two).unionByName(three)


def candidate_phrases(docs: DataFrame, key: str = "doc_id", least: int = 5, score: float = 3.0
                      ) -> DataFrame:
    """(key, phrase): words and collocations of the texts.

    ``docs`` has ``words``, an array.  Two neighbouring words are a collocation when they
    stand together ``least`` times or more, and ``score`` times as often as their own counts
    would have it; three are one when both pairs are.
    """
    return _phrases(docs, collocations(docs, key, least, score), key).distinct()


def admit_terms(docs: DataFrame, dim: DataFrame, embed, seeds=None, key: str = "doc_id",
                threshold: float = 0.82, least: int = 5, score: float = 3.0) -> DataFrame:
    """(key, term): terms that the dictionary lacks, mined from texts in which it finds none.

    ``docs`` has (key, folded), and ``words`` when its content words are known.  Collocations are
    those of all texts.  Candidate phrases are embedded and admitted when they are close enough to
    one of ``seeds`` (the built-in list).  ``embed`` maps a table with ``words`` (array) to the
    same table with ``vec``; every distinct phrase is encoded once, and only admitted ones are
    looked up in the texts again.
    """
    spark = docs.sparkSession
    worded = docs.select(key, "words") if "words" in docs.columns else write_once(
        docs.select(key, X.content_words(F.col("folded")).alias("words")))
    known = match_terms(docs, dim, key).select(key).distinct()
    fresh = write_once(worded.join(known.hint("merge"), key, "left_anti"))
    mined = _phrases(fresh, collocations(worded, key, least, score), key)
    encoded = lambda df: embed(df.withColumn("words", F.split(F.lower("phrase"), " ")))
    listed = spark.createDataFrame(list(enumerate(seeds or L.SEED_PHRASES)), "seed_id long, phrase string")
    distinct = spread_rows(write_once(mined.select("phrase").distinct()))
    close = write_once(admit_phrases(
        encoded(distinct).select(F.lit(0).alias("_one"), "phrase", "vec"),
        spark.createDataFrame([], "_one int"), dim, encoded(listed).select("seed_id", "vec"), "_one",
        threshold).select("term"))
    return mined.select(key, F.initcap("phrase").alias("term")).join(
        held_or_merged(close), "term").select(key, "term").distinct()


def admit_phrases(phrases: DataFrame, matched: DataFrame, dim: DataFrame, seeds: DataFrame,
                  key: str = "doc_id", threshold: float = 0.82) -> DataFrame:
    """(key, term): new terms of documents in which no known term was found.

    ``phrases`` holds (key, phrase, vec).  A phrase of 3 to 25 characters that is not in the
    dictionary is admitted when it is close enough to a seed; it is title-cased.
    """
    text = F.lower(F.trim("phrase"))
    fresh = (phrases.withColumn("term_lc", text)
             .filter(F.length("term_lc").between(3, 25))
             .join(dim.select("term_lc").distinct(), "term_lc", "left_anti")
             .join(matched.select(key).distinct(), key, "left_anti"))
    close = nearest_seed(fresh, seeds, threshold).filter("admitted")
    return close.select(key, F.initcap("term_lc").alias("term")).distinct()


def relevant_categories(target_folded: Column, categories=None) -> Column:
    """Categories with a role that shares a whitespace token with the target."""
    table = X.constant(
        [{"name": name, "tokens": sorted({t for r in roles for t in r.lower().split()})}
         for name, roles in (categories or L.JOB_CATEGORIES).items()],
        "array<struct<name:string,tokens:array<string>>>")
    words = F.array_distinct(F.regexp_extract_all(target_folded, F.lit(r"(\S+)")))
    return let(words, lambda ws: F.transform(
        F.filter(table, lambda c: F.arrays_overlap(ws, c.tokens)), lambda c: c["name"]))


def mentioned_roles(folded: Column, categories=None) -> Column:
    """Array of (category, role) for every role that occurs as a substring.

    Roles share few last words, so those are looked for first.
    """
    by_last = defaultdict(list)
    for name, roles in (categories or L.JOB_CATEGORIES).items():
        for role in roles:
            by_last[role.lower().split()[-1]].append(
                {"category": name, "role": role, "low": role.lower()})
    table = X.constant(
        [{"last": last, "roles": roles} for last, roles in by_last.items()],
        "array<struct<last:string,roles:array<struct<category:string,role:string,low:string>>>>")
    return let(folded, lambda t: F.flatten(F.transform(
        F.filter(table, lambda x: F.contains(t, x["last"])),
        lambda x: F.filter(x["roles"], lambda r: F.contains(t, r["low"])))))


def mentioned_categories(folded: Column, categories=None) -> Column:
    """Categories with a role that occurs in the text as a substring."""
    return F.array_distinct(F.transform(
        mentioned_roles(folded, categories), lambda r: r["category"]))


def role_mentions(docs: DataFrame, categories=None, key: str = "doc_id") -> DataFrame:
    """(key, category, role) for every role found in the text as a substring."""
    found = mentioned_roles(F.col("folded"), categories)
    return docs.select(key, F.inline_outer(found)).select(key, "category", "role").filter(
        F.col("role").isNotNull())
