"""Repeated passages by sparse suffix arrays.

Only suffixes at minimiser positions are retained: a position whose k-word hash is least in
some window of ``window`` such hashes.  The choice depends on content alone, so every
repeat of ``length`` words holds a retained suffix at the same place in each copy, with
its first ``length - window + 1`` words inside the repeat.

The suffixes are sorted by (hash of those first words, document, place) in ranges, and each is
compared with its neighbours.  Those with an equal neighbour are extended left and right:
every stretch of ``length`` words around them is compared in full length (by a 96-bit
hash) with all others, and a word is a repeat when it lies in a stretch that occurs
earlier, in the order of (document, place).  Nothing is paired: a stretch needs only the
first place where it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import text_of, whole_row, written
from dossier.llm.wordhash import Words, mixed, ranges, sliding

LENGTH, WINDOW, GRAM = 50, 30, 5
ROWS, ROWS_OUT, SEEN, GATHERED = 128, 1 << 16, 1 << 20, 1 << 19
NO_ID = (1 << 63) - 1


class Sampled:
    """Retained suffixes of a batch of texts, with the words laid out so that ``window``
    empty places follow each text."""

    def __init__(self, texts: list[bytes], length: int, window: int):
        words = Words(texts)
        counts = np.diff(words.first)
        self.words, self.counts, self.length = words, counts, length
        self.block = length - window + 1
        place = np.repeat(np.arange(len(texts)) * window, counts) + np.arange(len(words.hash))
        self.origin = words.first[:-1] + np.arange(len(texts)) * window
        total = len(words.hash) + len(texts) * window
        self.value = np.zeros(total, np.uint64)
        self.value[place] = words.hash
        self.text = np.repeat(np.arange(len(texts)), counts + window)
        left = np.repeat(self.origin + counts, counts + window) - np.arange(total)
        self.whole = left >= length                     # a stretch can start here
        self.retained = np.zeros(0, np.int64)
        if not self.whole.any():
            return
        # the minima of all windows that start a stretch; least positions reach their window
        at = np.arange(max(total - GRAM + 1, 0))
        grams = ranges(self.value, at, at + GRAM, 0xD6E8FEB86659FD93)
        least = sliding(grams, window, np.minimum)
        least = np.where(self.whole[:len(least)], least, 0)
        reach = sliding(np.concatenate((np.zeros(window - 1, np.uint64), least,
                                        np.zeros(window - 1, np.uint64))), window, np.maximum)
        n = min(len(reach), len(grams))
        self.grams, self.least = grams, least
        self.retained = np.flatnonzero((reach[:n] == grams[:n]) & (left[:n] >= self.block))

    def blocks(self) -> np.ndarray:
        return ranges(self.value, self.retained, self.retained + self.block, 0xA0761D6478BD642F)

    def stretches(self, candidate: np.ndarray) -> np.ndarray:
        """Starts of the stretches in which the minimum of every window is a candidate.

        Such a minimum is retained in every copy of the stretch, whatever stands around it;
        one whose block ends outside the stretch says nothing.
        """
        start = np.flatnonzero(self.whole)
        which = np.searchsorted(self.retained, start)
        open_ = np.arange(len(start))
        while len(open_):
            wrong = self.grams[self.retained[which[open_]]] != self.least[start[open_]]
            open_ = open_[wrong]
            which[open_] += 1
        # the minima stand in ascending order: those of a stretch's windows are a slice
        place = self.retained[which]
        inner = self.block - GRAM + 1                   # windows that a stretch holds
        stop = np.minimum(np.arange(len(start)) + inner, np.searchsorted(
            place, start + self.length - self.block, side="right"))
        other = np.concatenate(([0], np.cumsum(~candidate[which])))
        return start[other[stop] == other[:-1]]


def _chunks(columns: dict):
    """Record batches of bounded length."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS_OUT):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[at:at + ROWS_OUT])
                                          for k, v in columns.items()})


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, body): rows equal in id and text share a mark and count as one document."""
    own, body = F.col(id_col).cast("long"), text_of(text_col)
    return docs.select(F.coalesce(own, F.lit(NO_ID)).alias("id"),
                       F.xxhash64(own, body).alias("mark"), body.alias("body"))


def _once(batches):
    """The batches without rows whose mark the task has seen, as far as ``SEEN`` marks go."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for k, mark in enumerate(batch.column("mark").to_pylist()):
            if mark not in seen:
                new.append(k)
                seen.add(mark)
        if len(seen) > SEEN:
            seen.clear()
        yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _candidates(rows: DataFrame, length: int, window: int) -> DataFrame:
    """(mark, places): retained suffixes that equal a neighbour in the sorted order; a mark has
    a place once, however many rows share the mark.

    A suffix at the edge of a range has a neighbour in another range, which is not seen: it
    counts as a candidate, and the full comparison that follows decides.
    """
    def retain(batches):
        for whole in _once(batches):
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = Sampled([t.encode() for t in batch.column("body").to_pylist()],
                                length, window)
                keep = found.retained
                marks = batch.column("mark").to_numpy()
                yield from _chunks({
                    "block": _signed(found.blocks()) if len(keep) else np.zeros(0, np.int64),
                    "mark": marks[found.text[keep]] if len(keep) else np.zeros(0, np.int64),
                    "place": (keep - found.origin[found.text[keep]]).astype(np.int32)
                    if len(keep) else np.zeros(0, np.int32)})

    def compare(batches):
        held = None
        for batch in batches:
            block, mark, place = (batch.column(c).to_numpy() for c in ("block", "mark", "place"))
            if not len(block):
                continue
            if held is not None:
                block, mark, place = (np.concatenate((h, x)) for h, x in
                                      zip(held, (block, mark, place)))
            new = np.concatenate(([True], (block[1:] != block[:-1]) | (mark[1:] != mark[:-1])
                                  | (place[1:] != place[:-1])))
            block, mark, place = block[new], mark[new], place[new]
            equal = block[1:] == block[:-1]
            near = np.concatenate(([held is None or held_equal], equal)) | np.concatenate(
                (equal, [False]))
            held, held_equal = (block[-1:], mark[-1:], place[-1:]), bool(near[-1])
            pick = np.flatnonzero(near[:-1])
            yield from _chunks({"mark": mark[pick], "place": place[pick]})
        if held is not None:
            yield from _chunks({"mark": held[1], "place": held[2]})

    suffixes = written(rows.mapInArrow(retain, "block long, mark long, place int"))
    near = (suffixes.repartitionByRange("block", "mark", "place")
            .sortWithinPartitions("block", "mark", "place")
            .mapInArrow(compare, "mark long, place int"))
    return near.groupBy("mark").agg(F.collect_list("place").alias("places"))


def _stretches(rows: DataFrame, candidates: DataFrame, length: int, window: int) -> DataFrame:
    """Stretches around candidates: (h1, h2, id, mark, start, stop, source, done).

    Of every GATHERED stretches of a task, each content is listed once, at its first place among
    them; its later places are repeats already (done) and come as runs.  So a passage that a
    third of all documents share sends few rows per task to the comparison, and a task's memory
    does not grow with its texts.
    """
    def run(batches):
        parts, gathered = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = Sampled([t.encode() for t in batch.column("body").to_pylist()],
                                length, window)
                if not len(found.retained):
                    continue
                wanted = np.zeros(len(found.value), bool)
                for origin, places in zip(found.origin, batch.column("places").to_pylist()):
                    wanted[origin + np.array(places, np.int64)] = True
                start = found.stretches(wanted[found.retained])
                text = found.text[start]
                parts.append((
                    _signed(ranges(found.value, start, start + length, 0xE7037ED1A0B428DB)),
                    (_signed(ranges(mixed(found.value), start, start + length, 0x8EBC6AF09C88C6E3))
                     >> 32).astype(np.int32),
                    batch.column("id").to_numpy()[text], batch.column("mark").to_numpy()[text],
                    (start - found.origin[text]).astype(np.int32)))
                gathered += len(start)
                if gathered >= GATHERED:
                    yield from listed(parts)
                    parts, gathered = [], 0
        if parts:
            yield from listed(parts)

    def listed(parts):
        h1, h2, own, mark, start = map(np.concatenate, zip(*parts))
        parts.clear()
        order = np.lexsort((start, mark, own, h2, h1))
        later = np.concatenate(([False], (np.diff(h1[order]) == 0) & (np.diff(h2[order]) == 0)))
        lead = order[np.maximum.accumulate(np.where(later, 0, np.arange(len(later))))]
        # in the order of the documents, so that a document's rows compress well
        first, nothing = np.sort(order[~later]), np.zeros(int((~later).sum()), np.int64)
        yield from _chunks({"h1": h1[first], "h2": h2[first], "id": own[first],
                            "mark": mark[first], "start": start[first],
                            "stop": nothing.astype(np.int32), "source": nothing,
                            "done": nothing.astype(bool)})
        # one row seen twice is not a repeat of itself
        later &= (mark[order] != mark[lead]) | (start[order] != start[lead])
        source, order = own[lead][later], order[later]
        own, mark, start = own[order], mark[order], start[order]
        order = np.lexsort((start, mark, own))
        own, source, mark, start = (x[order] for x in (own, source, mark, start))
        new = np.concatenate(([True], (mark[1:] != mark[:-1]) | (own[1:] != own[:-1])
                              | (start[1:] > start[:-1] + 1)))[:len(own)]
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:], [len(own)])) - 1 if len(begin) else begin
        yield from _chunks({"h1": mark[begin], "h2": start[begin],
                            "id": own[begin], "mark": mark[begin], "start": start[begin],
                            "stop": start[end], "source": source[begin],
                            "done": np.ones(len(begin), bool)})

    return rows.dropDuplicates(["mark"]).join(candidates.hint("merge"), "mark").select(
        "id", "mark", "body", "places").mapInArrow(
        run, "h1 long, h2 int, id long, mark long, start int, stop int, source long, done boolean")


def _spans(rows: DataFrame, length: int, window: int) -> DataFrame:
    """(id, mark, spans): the repeats of each document as array<(start, length, source)>."""
    stretches = _stretches(rows, _candidates(rows, length, window), length, window)
    same = Window.partitionBy("done", "h1", "h2").orderBy("id", "mark", "start")
    head = F.first(F.struct("id", "mark", "start")).over(same)
    later = (stretches.withColumn("head", head)
             .filter(F.col("done") | (F.col("head") != F.struct("id", "mark", "start")))
             .select("id", "mark", F.struct(
                 "start", F.when(F.col("done"), F.col("stop")).otherwise(F.col("start")).alias("stop"),
                 F.when(F.col("done"), F.col("source")).otherwise(F.col("head.id"))
                 .alias("source")).alias("run")))

    def merge(batches):
        for batch in batches:
            out = []
            for runs in batch.column("runs").to_pylist():
                spans = []
                for run in sorted(runs, key=lambda r: (r["start"], r["source"])):
                    stop = run["stop"] + length
                    if spans and run["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([run["start"], stop, run["source"]])
                out.append([{"start": a, "length": b - a, "source": s} for a, b, s in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(out, pa.list_(pa.struct(
                    [("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64())])))],
                ["id", "mark", "spans"])

    return (later.groupBy("id", "mark").agg(F.collect_list("run").alias("runs"))
            .mapInArrow(merge, "id long, mark long, "
                               "spans array<struct<start:int,length:int,source:bigint>>"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, window: int = WINDOW,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span: id, start_word, n_words, source_id.

    A span is a maximal run of words each of which lies in a stretch of ``length`` words that
    occurs earlier in the corpus; ``source_id`` is some document with an earlier occurrence
    of its first stretch (the document itself when it repeats itself).  Words are runs
    without ASCII white space, compared byte for byte.  Null, empty and short texts have no
    spans.  Ids are integers; null ids come last in the order and are returned as
    null.  Rows equal in id and text count as one document.
    """
    def shown(c):
        return F.when(F.col(c) != NO_ID, F.col(c))

    return (_spans(_keyed(docs, id_col, text_col), length, window)
            .select("id", F.explode("spans").alias("span"))
            .select("id", F.col("span.start").cast("long").alias("start_word"),
                    F.col("span.length").cast("long").alias("n_words"),
                    F.col("span.source").alias("source"))
            .select(shown("id").alias(id_col), "start_word", "n_words",
                    shown("source").alias("source_id")))


def without_spans(text: str, spans) -> str:
    """The text without the words of the spans and the white space after each span."""
    raw = text.encode()
    words, out, at = Words([raw]), [], 0
    for span in spans:
        out.append(raw[at:words.start[span["start"]]])
        last = span["start"] + span["length"]
        at = words.start[last] if last < len(words.start) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def cut_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with the repeated spans cut out of the text.

    Cases as in ``repeated_spans``; a text without spans, null included, stays as it is.
    """
    spans = _spans(_keyed(docs, id_col, text_col), length, window).select("mark", "spans")
    mark = F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))
    rows = (docs.select(whole_row(docs.columns).alias("row"), mark.alias("mark"))
            .join(spans.hint("merge"), "mark", "left")
            .select(F.col(f"row.{text_col}").alias("body"), "spans", "row"))
    kinds = docs.schema

    def run(batches):
        for batch in batches:
            texts = [without_spans(t, s) if s else t for t, s in zip(
                batch.column("body").to_pylist(), batch.column("spans").to_pylist())]
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if f.name == text_col else row.field(k)
                 for k, f in enumerate(row.type)], [f.name for f in row.type])

    return rows.mapInArrow(run, kinds)
