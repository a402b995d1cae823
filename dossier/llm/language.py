"""Language identification by averaged hashed subword embeddings.

A text's lower-cased words, with a mark at both ends, are cut into grams of 2 to 4 characters; every
gram hashes to one of ``BUCKETS`` embeddings, and a softmax over the mean embedding gives the
languages' probabilities.  Embeddings and softmax are learned together by stochastic gradient
descent in numpy, on whole texts and on short cut-outs of them.

Part of the sample takes no part in the descent.  On it a temperature is chosen that makes the
probabilities honest, and the probability below which a prediction is rejected: the least one
from which on at most ``WRONG`` of the accepted predictions are wrong.

The model is fitted on at most ``sample_rows`` labelled rows, as many of every language as of any
other; prediction runs row by row over whole texts.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import SALTS, written

SAMPLE_ROWS, CUTS, CUT_LENGTH = 3000, 3, 60
BUCKETS, SIZE, LONGEST = 1 << 14, 16, 4
EPOCHS, BATCH, RATE = 6, 32, 4.0
HELD_BACK, WRONG = 5, 0.01
STRETCH, ROWS = 1 << 20, 256
UNKNOWN = "und"


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of every code point: 2 a letter, 1 a mark that belongs to a word, 0 anything else."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)],
                    np.uint8)


def grams(codes: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the grams that begin at the first ``starts`` code points; what is no part of
    a word is 0, and a gram may have it at its ends only."""
    padded = np.concatenate((codes, np.zeros(LONGEST, np.uint32)))
    inside, found = padded > 0, []
    mixed = padded[:starts] * np.uint32(0x9E3779B1)
    within = np.ones(starts, bool)
    for size in range(2, LONGEST + 1):
        last = padded[size - 1:starts + size - 1]
        mixed = (mixed ^ last) * np.uint32(0x85EBCA6B)
        mixed = mixed ^ (mixed >> np.uint32(15))
        if size > 2:
            within = within & inside[size - 2:starts + size - 2]
            real = within
        else:
            real = inside[:starts] | inside[1:starts + 1]
        found.append(np.where(real, ((mixed + np.uint32(size)) * np.uint32(0xC2B2AE35))
                              >> np.uint32(32 - 14), BUCKETS).astype(np.int32))
    return np.stack(found, axis=1)


def _stretches(texts: list[str]):
    """(text number of every place, code points and what follows them, places) of the texts,
    about STRETCH characters at a time; and whether a text has a letter."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), STRETCH):
            # a place needs the three characters after it; a text starts and ends outside a word
            part = (" " if at == 0 else "") + low[at:at + STRETCH]
            after = low[at + STRETCH:at + STRETCH + LONGEST - 1]
            if after:
                if parts:
                    yield rows, parts, ""
                yield [(row, len(part))], [part], after
                rows, parts, held = [], [], 0
                continue
            part += " "
            rows.append((row, len(part)))
            parts.append(part)
            held += len(part)
            if held >= STRETCH:
                yield rows, parts, ""
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts, ""


def spread(texts: list[str]):
    """Yield (row of every run of places, first place of the run, buckets of the places, code
    point classes); together they hold every place of every text once."""
    classes = _classes()
    for rows, parts, after in _stretches(texts):
        raw = np.frombuffer(("".join(parts) + after).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = classes[raw]
        places = len(raw) - len(after)
        first = np.cumsum([0] + [n for _, n in rows[:-1]])
        yield (np.array([r for r, _ in rows]), first,
               grams(np.where(kind > 0, raw, 0).astype(np.uint32), places), kind[:places])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray       # (BUCKETS + 1, languages): what a gram adds to the mean's logits
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of whole texts, and whether a text has a letter."""
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        letter = np.zeros(len(texts), bool)
        for rows, first, buckets, kind in spread(texts):
            added = self.table[buckets[:, 0]]
            for size in range(1, buckets.shape[1]):
                added += self.table[buckets[:, size]]
            np.add.at(sums, rows, np.add.reduceat(added, first, axis=0, dtype=float))
            np.add.at(n, rows, np.add.reduceat((buckets < BUCKETS).sum(axis=1), first))
            np.logical_or.at(letter, rows, np.maximum.reduceat(kind, first) == 2)
        return sums / np.maximum(n, 1)[:, None] + self.bias, letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and calibrated probabilities; ``und`` with 0 where there is no letter."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, letter = self.logits([t or "" for t in texts])
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return ([self.languages[b] if has else UNKNOWN for b, has in zip(best, letter)],
                np.where(letter, p[np.arange(len(p)), best], 0.0))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dense(examples: list, width: int = BUCKETS) -> np.ndarray:
    """Mean counts of a few examples, one row each."""
    out = np.zeros((len(examples), width), np.float32)
    for row, (buckets, counts) in enumerate(examples):
        out[row, buckets] = counts / counts.sum()
    return out


def descend(examples: list, target: np.ndarray, classes: int, epochs: int = EPOCHS,
            rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(what a bucket adds to the logits, bias): embeddings and softmax by stochastic descent."""
    chance = np.random.default_rng(11)
    embeddings = chance.uniform(-1, 1, (BUCKETS, SIZE)).astype(np.float32) / SIZE
    weights, bias = np.zeros((SIZE, classes), np.float32), np.zeros(classes, np.float32)
    steps, done = max(epochs * -(-len(examples) // BATCH), 1), 0
    for _ in range(epochs):
        order = chance.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            means = _dense([examples[r] for r in rows])
            hidden = means @ embeddings
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            pace = rate * (1 - done / steps)
            back = error @ weights.T
            weights -= pace / len(rows) * hidden.T @ error
            bias -= 0.1 * pace / len(rows) * error.sum(axis=0)
            used = np.flatnonzero(means.any(axis=0))
            # buckets are met rarely, so their steps are longer
            embeddings[used] -= pace * 20 / len(rows) * means[:, used].T @ back
            done += 1
    return embeddings @ weights, bias


def temperature_of(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature under which the targets are most probable."""
    def loss(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(target)), target]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high = np.log(0.02), np.log(20.0)
    for _ in range(40):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def threshold_of(score: np.ndarray, right: np.ndarray, wrong: float = WRONG) -> float:
    """The least probability from which on at most ``wrong`` of the predictions are wrong."""
    order = np.argsort(-score, kind="stable")
    ends = np.append(score[order][1:] != score[order][:-1], True)   # equal scores stand together
    share = np.cumsum(~right[order]) / np.arange(1, len(score) + 1)
    good = np.flatnonzero(ends & (share <= wrong))
    if not len(good):
        return float(np.nextafter(score.max(initial=1.0), 2.0))
    return 0.0 if good[-1] == len(score) - 1 else float(score[order[good[-1]]])


def fit(examples: list, names: list[str], held_back: np.ndarray) -> Model:
    """``examples``: (buckets, counts); ``held_back`` ones only calibrate."""
    languages = sorted(set(names))
    target = np.array([languages.index(x) for x in names], int)
    used = np.flatnonzero(~held_back)
    if not len(languages) or not len(used):
        used = np.arange(len(names))
    table, bias = descend([examples[k] for k in used], target[used], len(languages))
    model = Model(languages, np.vstack((table, np.zeros((1, len(languages))))).astype(np.float32),
                  bias.astype(float))
    kept = np.flatnonzero(held_back)
    if len(languages) > 1 and len(kept):
        logits = np.vstack([_dense([examples[k]]) @ table + bias for k in kept])
        model.temperature = temperature_of(logits, target[kept])
        p = softmax(logits / model.temperature)
        model.threshold = threshold_of(p.max(axis=1), p.argmax(axis=1) == target[kept])
    return model


def _examples(text: str):
    """The whole text and a few short cut-outs, as (buckets, counts)."""
    step = max(len(text) // CUTS, 1)
    for part in [text, *(text[at:at + CUT_LENGTH] for at in range(0, len(text), step))][:CUTS + 1]:
        counts = np.zeros(BUCKETS + 1, np.int64)
        for _, _, buckets, _ in spread([part]):
            counts += np.bincount(buckets.ravel(), minlength=BUCKETS + 1)
        held = np.flatnonzero(counts[:BUCKETS])
        if len(held):
            yield held, counts[held]


def train(docs: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with an id, a text and a language for which ``usable`` holds.

    At most ``sample_rows`` ids are used: of every language those of least hash, in turn.  Ids
    with several rows count once (the least language and text).  Without such rows the
    model knows no language.
    """
    rows = docs.filter(usable if usable is not None else F.lit(True)).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("body")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("body").isNotNull())
    ranked = rows.select("lang", "id", F.xxhash64(F.lit("sample"), "id").alias("rank"))
    # a language is first cut in SALTS parts, so the last sort of a language is bounded
    part = Window.partitionBy("lang", F.pmod(F.col("rank"), F.lit(SALTS))).orderBy("rank", "id")
    whole = Window.partitionBy("lang").orderBy("rank", "id")
    turn = F.row_number()
    chosen = (ranked.distinct().withColumn("turn", turn.over(part))
              .filter(F.col("turn") <= sample_rows)
              .withColumn("turn", turn.over(whole)).filter(F.col("turn") <= sample_rows)
              .orderBy("turn", "rank", "lang", "id").limit(sample_rows).select("id").distinct())
    sample = (rows.join(F.broadcast(chosen), "id").groupBy("id")
              .agg(F.min(F.struct("lang", "body")).alias("row"))
              .select("id", "row.lang", "row.body"))

    def extract(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                found = list(_examples(one.column("body")[0].as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [one.column(c).take(pa.array([0] * len(found))) for c in ("id", "lang")]
                        + [pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())),
                           pa.array([n for _, n in found], pa.list_(pa.int64()))],
                        ["id", "lang", "buckets", "counts"])

    got = written(sample.mapInArrow(
        extract, "id string, lang string, buckets array<int>, counts array<long>")).withColumn(
        "held", F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(HELD_BACK)) == 0).orderBy(
        F.xxhash64("id"), "id", F.xxhash64("buckets"), F.xxhash64("counts")).toArrow()
    examples = [(b.values.to_numpy(), n.values.to_numpy().astype(float)) for b, n in zip(
        got.column("buckets"), got.column("counts"))]
    return fit(examples, got.column("lang").to_pylist(),
               np.array(got.column("held").to_pylist(), bool))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected): one row per row, ids and rows repeated or null too.

    ``lang_pred`` is the most probable language, ``score`` its calibrated probability; ``rejected``
    marks scores below the model's threshold.  A null text or one without a letter, and every
    text under a model without languages, gives ``und``, 0 and rejected.  Whole texts count,
    whatever their length, in stretches of bounded size; no other column is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                names, score = sent.value.predict(batch.column("body").to_pylist())
                rejected = (score < sent.value.threshold) | (np.array(names, object) == UNKNOWN)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(names, pa.string()), pa.array(score),
                     pa.array(rejected.astype(bool))], ["id", "lang_pred", "score", "rejected"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed(
        "id", id_col)
