"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other.  Each category has a logistic model on
the words of a text and on the log-odds of the categories before it; for training, those
come from out-of-fold models, so a later model sees its predecessors as reliable as they
are on new texts.

The chain is fitted on at most ``sample_rows`` labelled rows, taken by a hash of the id.
Scoring is row by row over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import text_of, whole_row, written
from dossier.llm.wordhash import mixed, ranges

SAMPLE_ROWS, MAX_FEATURES, LEAST_DOCUMENTS = 8000, 40_000, 5
CHOSEN, FOLDS, ROUNDS, PENALTY, RATE = 600, 3, 80, 0.5, 0.2
ROWS = 128
PREFIXES = (4, 5)

_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(b).isalnum() for b in range(128)]
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word of lower-cased texts: the word, and its first bytes."""
    raws = [t.lower().encode() for t in texts]
    raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _LETTER[raw])).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    row = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), start, side="right")
    rows, found, values = [row], [ranges(_BYTE[raw], start, stop, 0x9FB21C651E98DF25)], _BYTE[raw]
    for size in PREFIXES:
        long = stop - start > size
        head = ranges(values, start[long], start[long] + size, 0x9FB21C651E98DF25)
        rows.append(row[long])
        found.append(mixed(head + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(found).view(np.int64)


def _known(names: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every feature among the sorted names, and whether it is there."""
    if not len(names):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    place = np.minimum(np.searchsorted(names, found), len(names) - 1)
    return place, names[place] == found


def _distinct(rows: np.ndarray, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.unique(rows * width + columns), width)


@dataclass
class Linear:
    """A logistic model on the presence of features and on earlier log-odds."""
    weights: np.ndarray     # of all features, mostly zero
    earlier: np.ndarray
    bias: float

    def odds(self, rows, columns, n: int, before: np.ndarray) -> np.ndarray:
        out = np.bincount(rows, self.weights[columns], n) + self.bias
        return out + before @ self.earlier if before.shape[1] else out


def fit_linear(rows, columns, width: int, before: np.ndarray, target: np.ndarray) -> Linear:
    """Penalised logistic regression by Adam on the features that tell most, as judged on
    these rows alone; one class only gives a constant model."""
    n, positive = len(target), int(target.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    weights = np.zeros(width)
    if positive in (0, n):
        return Linear(weights, np.zeros(before.shape[1]), bias)
    on = np.bincount(columns[target[rows]], minlength=width)
    off = np.bincount(columns[~target[rows]], minlength=width)
    spread = np.sqrt(1 / (on + 0.5) + 1 / (off + 0.5))
    score = np.abs(np.log((on + 0.5) / (positive - on + 0.5))
                   - np.log((off + 0.5) / (n - positive - off + 0.5))) / spread
    score[on + off < LEAST_DOCUMENTS] = 0
    chosen = np.sort(np.argsort(-score, kind="stable")[:CHOSEN])
    place = np.full(width, -1)
    place[chosen] = np.arange(len(chosen))
    held = place[columns] >= 0
    r, c, k = rows[held], place[columns[held]], len(chosen)
    wanted = target.astype(float)
    theta, m, v = np.zeros(k + before.shape[1] + 1), 0.0, 0.0
    theta[-1] = bias
    for step in range(1, ROUNDS + 1):
        odds = np.bincount(r, theta[c], n) + before @ theta[k:-1] + theta[-1]
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - wanted
        slope = np.concatenate((np.bincount(c, error[r], k), before.T @ error, [error.sum()]))
        slope[:-1] += PENALTY * theta[:-1]
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope ** 2
        theta = theta - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights[chosen] = theta[:k]
    return Linear(weights, theta[k:-1], float(theta[-1]))


@dataclass
class Chain:
    categories: list[str]
    features: np.ndarray    # sorted
    models: list[Linear]
    cuts: list[float]       # probability from which a text belongs to the category

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """One row per text, one column per category."""
        n = len(texts)
        rows, found = features(texts)
        columns, held = _known(self.features, found)
        rows, columns = _distinct(rows[held], columns[held], max(len(self.features), 1))
        odds = np.zeros((n, 0))
        for model in self.models:
            own = model.odds(rows, columns, n, odds)
            odds = np.column_stack((odds, np.clip(own, -30, 30)))
        return 1 / (1 + np.exp(-odds))


def best_cut(odds: np.ndarray, target: np.ndarray) -> float:
    """The probability that parts out-of-fold predictions with the greatest F1, halfway (in
    log-odds) to the next lower prediction; one half when a class is missing."""
    if not target.any() or target.all():
        return 0.5
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(target[order])
    f1 = 2 * hits / (np.arange(1, len(odds) + 1) + target.sum())
    at = int(np.argmax(f1))
    lower = odds[order[at + 1]] if at + 1 < len(odds) else odds[order[at]]
    return float(1 / (1 + np.exp(-(odds[order[at]] + lower) / 2)))


def fit_chain(sample: list[tuple[np.ndarray, np.ndarray, list]], categories: list[str],
              names: np.ndarray, folds: int = FOLDS) -> Chain:
    """``sample``: (fold, feature columns, labels or None) per row."""
    fold = np.array([s[0] for s in sample], np.int64)
    sizes = [len(s[1]) for s in sample]
    rows = np.repeat(np.arange(len(sample)), sizes)
    columns = np.concatenate([s[1] for s in sample]) if sample else np.zeros(0, np.int64)
    odds, models, cuts = np.zeros((len(sample), 0)), [], []

    def fitted(use: np.ndarray, target) -> Linear:
        place = np.cumsum(use) - 1
        held = use[rows]
        return fit_linear(place[rows[held]], columns[held], len(names), odds[use], target[use])

    for k in range(len(categories)):
        labelled = np.array([s[2][k] is not None for s in sample], bool)
        target = np.array([bool(s[2][k]) for s in sample], bool)
        models.append(fitted(labelled, target))
        own = np.zeros(len(sample))
        for part in range(folds):
            out = fold == part
            if out.any():
                model = fitted(labelled & ~out, target)
                own[out] = model.odds(rows, columns, len(sample), odds)[out]
        cuts.append(best_cut(own[labelled], target[labelled]))
        odds = np.column_stack((odds, np.clip(own, -30, 30)))
    return Chain(list(categories), names, models, cuts)


def train(docs: DataFrame, labels: DataFrame, categories: list[str],
          sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS, id_col: str = "doc_id",
          text_col: str = "text") -> Chain:
    """Fit the chain on documents with labels (``id_col`` and one 0/1 column per category).

    At most ``sample_rows`` labelled ids are used, those of least hash; a null id is
    unlabelled, a null label leaves its row out of that category's models.  Ids with
    several label rows count once (the greatest label).  Without labels all
    probabilities are one half.
    """
    chosen = F.broadcast(
        labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(F.array(*[F.max(F.col(c).cast("int")) for c in categories]).alias("labels"))
        .withColumn("rank", F.xxhash64(F.lit("sample"), "id")).orderBy("rank", "id")
        .limit(sample_rows))
    rows = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
            .join(chosen, "id")
            .select(F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold"), "labels",
                    "body"))

    def extract(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                row, found = features(batch.column("body").to_pylist())
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                new = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(found) != 0)))[:len(row)]
                row, found = row[new], found[new]
                stops = np.searchsorted(row, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("fold"), batch.column("labels"),
                     pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(found))],
                    ["fold", "labels", "found"])

    sample = written(rows.mapInArrow(extract, "fold int, labels array<int>, found array<long>"))
    frequent = (sample.select(F.explode("found").alias("f")).groupBy("f")
                .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS)
                .orderBy(F.desc("n"), "f").limit(MAX_FEATURES).select("f").toArrow())
    names = np.sort(frequent.column("f").to_numpy())
    sent = sample.sparkSession.sparkContext.broadcast(names)

    def known(batches):
        for batch in batches:
            lists = batch.column("found")
            found, stops = lists.values.to_numpy(), lists.offsets.to_numpy()
            columns, held = _known(sent.value, found)
            upto = np.concatenate(([0], np.cumsum(held)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), batch.column("labels"), pa.ListArray.from_arrays(
                    pa.array(upto[stops] - upto[stops[0]], pa.int32()),
                    pa.array(columns[held][upto[stops[0]]:], pa.int32()))],
                ["fold", "labels", "columns"])

    matrix = sample.mapInArrow(known, "fold int, labels array<int>, columns array<int>").toArrow()
    fitted = [(f, np.array(c, np.int64), lab) for f, lab, c in zip(
        matrix.column("fold").to_pylist(), matrix.column("labels").to_pylist(),
        matrix.column("columns").to_pylist())]
    return fit_chain(fitted, categories, names, folds)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text",
          prefix: str = "p_") -> DataFrame:
    """(id, one probability per category): one row per row, ids and rows repeated or null too.

    A null text counts as empty; an empty text gets the models' bias.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    names = [f"{prefix}{c}" for c in chain.categories]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                p = sent.value.probabilities(batch.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(p[:, k]) for k in range(len(names)))],
                    ["id", *names])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"`{n}` double" for n in names)
                           ).withColumnRenamed("id", id_col)


def reject(docs: DataFrame, chain: Chain, category: str = "toxic",
           threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose probability of ``category`` is below ``threshold``
    (by default the cut found on out-of-fold predictions)."""
    rows = docs.select(whole_row(docs.columns).alias("row"), text_of(text_col).alias("body"))
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    at_category = chain.categories.index(category)
    threshold = chain.cuts[at_category] if threshold is None else threshold

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                p = sent.value.probabilities(batch.column("body").to_pylist())[:, at_category]
                kept = batch.column("row").filter(pa.array(p < threshold))
                yield pa.RecordBatch.from_arrays(kept.flatten(), [f.name for f in kept.type])

    return rows.mapInArrow(run, docs.schema)


def categories_of(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The chain's categories from a table of (doc_id, quality, toxic): low quality, toxic,
    and toxic in good prose, which a quality filter would not remove."""
    return labels.select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic",
        ((F.col("quality") == 1) & (F.col("toxic") == 1)).cast("int").alias("toxic_prose")
    ), ["low_quality", "toxic", "toxic_prose"]
