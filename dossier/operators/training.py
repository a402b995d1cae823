"""Splits, tree models, grid search and model cards with pyspark.ml."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, IDF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.functions.numeric import clip01, let
from dossier.session import write_once

# fixed values: the boosted model in use
BOOSTED_BEST = {"maxDepth": 5, "stepSize": 0.2, "maxIter": 50, "subsamplingRate": 0.8}

HASH_BITS = 60


def stable_hash(key: Column, seed: int) -> Column:
    """A 60-bit hash of (key, seed) that any engine with MD5 can repeat."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def smallest_cutoffs(df: DataFrame, label: str, value: str, wanted: dict) -> dict:
    """Per label the value of rank ``wanted[label]`` (1-based), values being hashes.

    A histogram on the leading bits finds the bin of that rank, the next bits split
    that bin, and so on: each pass reads the table once and returns one row per
    label, so no label is ever sorted or held in one task.
    """
    step, state = 15, {k: (0, 0, n) for k, n in wanted.items() if n > 0}
    for shift in range(HASH_BITS - step, -1, -step):
        prefix = F.shiftright(value, shift + step)
        inside = F.lit(False)
        for lab, (lead, _, _) in state.items():
            inside = inside | ((F.col(label) == F.lit(lab)) & (prefix == F.lit(lead)))
        bins = df.filter(inside).groupBy(label, F.shiftright(value, shift).alias("bin")).agg(
            F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(label).orderBy("bin"))
        need = F.coalesce(*[F.when(F.col(label) == F.lit(lab), F.lit(n))
                            for lab, (_, _, n) in state.items()])
        rows = (bins.withColumn("upto", upto).filter(F.col("upto") >= need)
                .groupBy(label).agg(F.min(F.struct("bin", "upto", "n")).alias("b")).collect())
        state = {r[label]: (r.b.bin, 0, state[r[label]][2] - (r.b.upto - r.b.n)) for r in rows}
    return {lab: lead for lab, (lead, _, _) in state.items()}


def stratified_split(df: DataFrame, label: str, key: str, frac: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_train``: exactly floor(frac * n + 0.5) rows of every label, chosen
    by a seeded hash of the unique ``key``."""
    hashed = df.withColumn("_h", stable_hash(F.col(key), seed))
    sizes = {r[0]: int(r[1] * frac + 0.5) for r in
             df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    cut = smallest_cutoffs(hashed, label, "_h", sizes)
    limit = F.coalesce(*[F.when(F.col(label) == F.lit(lab), F.lit(v)) for lab, v in cut.items()],
                       F.lit(-1))
    return hashed.withColumn("is_train", F.col("_h") <= limit).drop("_h")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds n / (k * n_label)."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n, k = sum(sizes.values()), len(sizes)
    return df.withColumn(out, F.coalesce(*[
        F.when(F.col(label) == F.lit(lab), F.lit(n / (k * m))) for lab, m in sizes.items()]))


def assembler(features) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def fit_tree(train: DataFrame, features, label: str = "label", balanced: bool = True,
             **params) -> PipelineModel:
    """Decision tree; by default with balanced class weights."""
    tree = DecisionTreeClassifier(labelCol=label, featuresCol="features", seed=42, **params)
    if balanced:
        train = balanced_weights(train, label)
        tree = tree.setWeightCol("weight")
    return Pipeline(stages=[assembler(features), tree]).fit(train)


def fit_boosted(train: DataFrame, features, label: str = "label", parallelism: int = 3,
                **params) -> PipelineModel:
    """Boosted trees, one model per class against the rest."""
    gbt = GBTClassifier(seed=42, **{**BOOSTED_BEST, **params})
    rest = OneVsRest(classifier=gbt, labelCol=label, featuresCol="features",
                     parallelism=parallelism)
    return Pipeline(stages=[assembler(features), rest]).fit(train)


def fit_forest(train: DataFrame, features, label: str = "label", **params) -> PipelineModel:
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", seed=42, **params)
    return Pipeline(stages=[assembler(features), forest]).fit(train)


def grid_search(train: DataFrame, features, grid: dict, label: str = "label", key: str = "doc_id",
                folds: int = 5, parallelism: int = 4, estimator=None):
    """Cross-validated search of any estimator on weighted F1; folds come from a stable hash.

    Every point is fitted anew; ``boosting`` searches trees with one fit for many points.  Rows
    are weighted by class ('balanced') or not ('equal').
    """
    train = balanced_weights(train, label, "balanced").withColumn("equal", F.lit(1.0))
    est = estimator or DecisionTreeClassifier(labelCol=label, featuresCol="features", seed=42)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    data = assembler(features).transform(train).withColumn(
        "fold", F.pmod(stable_hash(F.col(key), 7), F.lit(folds)).cast("int"))
    search = CrossValidator(
        estimator=est, estimatorParamMaps=builder.build(), numFolds=folds, foldCol="fold",
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"),
        parallelism=parallelism, seed=42)
    return search.fit(data)


def class_probabilities(predicted: DataFrame, raw: str = "rawPrediction") -> DataFrame:
    """Adds p0..p2: one-vs-rest margins through the logistic curve, made to sum to 1."""
    margins = vector_to_array(raw)
    sig = F.transform(margins, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-m)))
    out = predicted.withColumn("_s", sig).withColumn(
        "_t", F.aggregate("_s", F.lit(0.0), lambda a, v: a + v))
    return out.select(*predicted.columns, *[
        (F.get("_s", F.lit(i)) / F.col("_t")).alias(f"p{i}") for i in range(3)])


def importances(model, features) -> DataFrame:
    """(feature, importance) of a fitted tree stage (mean over one-vs-rest members)."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    members = stage.models if hasattr(stage, "models") else [stage]
    rows = [(name, float(sum(m.featureImportances[i] for m in members) / len(members)))
            for i, name in enumerate(features)]
    return SparkSession.active().createDataFrame(rows, "feature STRING, importance DOUBLE")


def model_card(model, features, scores: DataFrame, params: dict) -> DataFrame:
    """(section, name, value): scores, parameters and importances in long form."""
    wide = scores.select(F.inline(F.array(*[
        F.struct(F.lit("score").alias("section"), F.lit(c).alias("name"),
                 F.col(c).cast("string").alias("value")) for c in scores.columns])))
    spark = scores.sparkSession
    given = spark.createDataFrame(
        [("param", k, str(v)) for k, v in params.items()], wide.schema)
    weights = importances(model, features).select(
        F.lit("importance").alias("section"), F.col("feature").alias("name"),
        F.format_number("importance", 6).alias("value"))
    return wide.unionByName(given).unionByName(weights)


def leaf_paths(model, features) -> list[tuple]:
    """(leaf, class, root share, contributions) of a fitted decision tree.

    Every split on the way to a leaf gives its feature the change in the class share.  Leaves
    are numbered from left to right, as the model numbers them; their number is bounded by the
    tree's depth.
    """
    tree = model.stages[-1] if isinstance(model, PipelineModel) else model
    root, rows = tree._call_java("rootNode"), []

    def shares(node) -> list[float]:
        stats = list(node.impurityStats().stats())
        whole = sum(stats) or 1.0
        return [v / whole for v in stats]

    base, leaf = shares(root), 0
    pending = [(root, [[0.0] * len(features) for _ in base])]
    while pending:
        node, so_far = pending.pop()
        if node.subtreeDepth() == 0:
            rows += [(float(leaf), k, base[k], steps) for k, steps in enumerate(so_far)]
            leaf += 1
            continue
        f, here = node.split().featureIndex(), shares(node)
        for child in (node.rightChild(), node.leftChild()):     # the left one is taken up first
            moved = [list(steps) for steps in so_far]
            for k, (old, new) in enumerate(zip(here, shares(child))):
                moved[k][f] += new - old
            pending.append((child, moved))
    return rows


def path_contributions(df: DataFrame, model, features, label: str = "prediction") -> DataFrame:
    """Rows scored by a fitted decision tree, with root_share and ``contributions``: an array of
    (feature, value, contribution) toward the class ``label``.

    Path attribution, an approximation of Shapley values: root_share plus the contributions
    is the class share of the row's leaf.  The row meets its leaf's entry in a join.
    """
    tree = model.stages[-1]
    tree.setLeafCol("_leaf")
    paths = df.sparkSession.createDataFrame(
        leaf_paths(model, features),
        "_leaf DOUBLE, _class INT, root_share DOUBLE, _steps ARRAY<DOUBLE>")
    scored = model.transform(df).withColumn("_class", F.col(label).cast("int"))
    values = F.array(*[F.col(n).cast("double") for n in features])
    names = F.array(*[F.lit(n) for n in features])
    parts = F.transform(
        F.arrays_zip(names.alias("feature"), values.alias("value"), F.col("_steps").alias("steps")),
        lambda x: F.struct(x.feature.alias("feature"), x.value.alias("value"),
                           x.steps.alias("contribution")))
    return scored.join(paths, ["_leaf", "_class"]).withColumn("contributions", parts).drop(
        "_leaf", "_class", "_steps")


def word_bucket(word: Column, size: int) -> Column:
    """The hash bucket of a word: MD5, so that any engine can repeat it."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int"), F.lit(size))


def word_buckets(words: Column, size: int) -> Column:
    """The hash bucket of every word, as text."""
    return F.transform(words, lambda w: word_bucket(w, size).cast("string"))


def fit_weights(docs: DataFrame, words: str, size: int = 256) -> list[float]:
    """Inverse document frequencies of hashed words, one per bucket, learned in one pass.

    ``words`` is an array of words, or of (w, c) entries for words with their counts.
    """
    name = (lambda x: x.w) if "struct" in dict(docs.dtypes)[words] else (lambda x: x)
    own = F.array_distinct(F.transform(words, lambda x: word_bucket(name(x), size)))
    # every document also counts once under -1, so the pass yields their number
    found = dict(tuple(r) for r in docs.select(F.explode(F.array_append(
        F.coalesce(own, F.array().cast("array<int>")), F.lit(-1))).alias("b")).groupBy("b").agg(
        F.count(F.lit(1))).collect())
    return [math.log((found.get(-1, 0) + 1) / (found.get(b, 0) + 1)) for b in range(size)]


def _weights(weights: list[float]) -> Column:
    return F.array(*[F.lit(w) for w in weights])


def hash_words(docs: DataFrame, words: str, weights: list[float], out: str) -> DataFrame:
    """Adds ``out``: the buckets and counts of a row's words, sorted, and the length of their
    weighted vector; the vector itself is never formed.  ``words`` holds (w, c) entries."""
    size = len(weights)
    cells = F.sort_array(F.transform(words, lambda x: F.struct(
        word_bucket(x.w, size).alias("b"), x.c.cast("double").alias("c"))))
    start = F.struct(F.lit(-1).alias("b"), F.lit(0.0).alias("n"), F.lit(0.0).alias("square"))
    table = F.col("_weights")

    def ended(a: Column) -> Column:
        y = a.n * F.coalesce(F.get(table, a.b), F.lit(0.0))
        return a.square + y * y

    def step(a: Column, x: Column) -> Column:
        same = a.b == x.b
        return F.struct(x.b.alias("b"), F.when(same, a.n + x.c).otherwise(x.c).alias("n"),
                        F.when(same, a.square).otherwise(ended(a)).alias("square"))

    return (docs.withColumn("_cells", cells).withColumn("_weights", _weights(weights))
            .withColumn(out, F.struct(
                F.col("_cells").alias("cells"),
                F.sqrt(F.aggregate("_cells", start, step, ended)).alias("length")))
            .drop("_cells", "_weights"))


def embed_weighted(docs: DataFrame, words: str, weights: list[float], out: str) -> DataFrame:
    """Adds ``out``, the unit vector of a row's distinct words times the weights again, ready for
    the product with ``hash_words``: a map that holds the buckets of the row's words alone."""
    size = len(weights)
    hashed = docs.withColumn("_b", F.sort_array(F.array_compact(F.coalesce(
        F.transform(words, lambda w: word_bucket(w, size)), F.array().cast("array<int>")))))
    cells = F.transform(F.array_distinct("_b"), lambda b: let(F.get(_weights(weights), b), lambda w: F.struct(
        b.alias("b"), w.alias("w"),
        (w * (F.size("_b") - F.size(F.array_remove("_b", b)))).alias("y"))))
    done = hashed.withColumn("_y", cells)
    length = F.sqrt(F.aggregate("_y", F.lit(0.0), lambda a, x: a + x.y * x.y))
    return done.withColumn("_n", length).withColumn(out, F.map_from_entries(F.transform("_y", lambda x: F.struct(
        x.b, F.when(F.col("_n") > 0, x.y * x.w / F.col("_n")).otherwise(F.lit(0.0)))))).drop("_b", "_y", "_n")


def hashed_cosine(hashed: Column, vector: Column) -> Column:
    """Cosine of a row of ``hash_words`` with a vector of ``embed_weighted``, in [0, 1]."""
    dot = F.aggregate(hashed.cells, F.lit(0.0), lambda a, x: a + x.c * F.coalesce(
        F.try_element_at(vector, x.b), F.lit(0.0)))
    return F.when(hashed.length > 0, clip01(dot / hashed.length)).otherwise(F.lit(0.0))


def fit_encoder(docs: DataFrame, words: str, size: int = 256) -> PipelineModel:
    """Inverse document frequencies of hashed words, learned in one pass over ``docs``."""
    return _fit_buckets(docs.select(word_buckets(F.col(words), size).alias("_b")), size)


def _fit_buckets(hashed: DataFrame, size: int) -> PipelineModel:
    counts = CountVectorizerModel.from_vocabulary(
        [str(b) for b in range(size)], inputCol="_b", outputCol="_tf")
    return Pipeline(stages=[counts, IDF(inputCol="_tf", outputCol="_idf"),
                            Normalizer(inputCol="_idf", outputCol="_unit")]).fit(hashed)


def embed(docs: DataFrame, words: str, out: str = "vec", size: int = 256,
          model: PipelineModel | None = None) -> tuple[DataFrame, PipelineModel]:
    """Unit vectors from hashed word counts weighted by inverse document frequency.

    ``words`` is an array of words, or of (w, c) entries for words with their counts.  Any other
    encoder can take its place: the scores need an array column only.  Returns the
    documents with ``out`` (array of double) and the fitted weights.  To be fitted here, the
    documents are written once with their buckets: two passes read them.
    """
    counted = "struct" in dict(docs.dtypes)[words]
    size = len(model.stages[0].vocabulary) if model is not None else size
    if counted:
        hashed = F.flatten(F.zip_with(
            word_buckets(F.transform(words, lambda x: x.w), size), F.col(words),
            lambda b, x: F.array_repeat(b, x.c)))
    else:
        hashed = word_buckets(F.col(words), size)
    held = docs.withColumn("_b", hashed)
    if model is None:
        held = write_once(held)
        model = _fit_buckets(held.select("_b"), size)
    done = model.transform(held)
    return done.withColumn(out, vector_to_array("_unit")).drop("_b", "_tf", "_idf", "_unit"), model


def embed_distinct(docs: DataFrame, text: str, encode) -> DataFrame:
    """Encode every distinct text once and join the vector back.

    ``encode`` maps a table with (text) to (text, vec).  Texts meet on their 256-bit digest,
    not on their content.
    """
    keyed = docs.withColumn("_k", F.sha2(F.col(text), 256))
    distinct = keyed.groupBy("_k").agg(F.any_value(text).alias(text)).select(text)
    vectors = encode(distinct).select(F.sha2(F.col(text), 256).alias("_k"), "vec")
    return keyed.join(vectors, "_k", "left").drop("_k")
