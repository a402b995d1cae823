"""Token counts of fields and sections, attributed by offsets.

A document's fields are joined and encoded once as a whole, so the tokens are those that training
will see.  Tokens and sections are then both intervals of characters, and an interval
join gives every token to a section.  A token that crosses a border is allocated by an
explicit rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.tokens import ByteBpe, built, vocabulary

RULES = ("most", "start", "end")
ROWS = 128


def sections_of(fields: list[str], names: list[str], separator: str,
                by_line: frozenset[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """The joined text and its sections as (field, start, stop), end to end.

    A field in ``by_line`` has one section per line, others one section; line ends and
    separators belong to the section before them.
    """
    whole, out, at = separator.join(fields), [], 0
    for k, (name, value) in enumerate(zip(names, fields)):
        tail = len(separator) if k + 1 < len(fields) else 0
        parts = value.split("\n") if name in by_line else [value]
        for j, part in enumerate(parts):
            size = len(part) + (1 if j + 1 < len(parts) else tail)
            out.append((name, at, at + size))
            at += size
    return whole, out


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, stops: np.ndarray,
              rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of every token, whether it crosses a border).

    ``first`` and ``last`` are a token's first and last character.  'start' and 'end' give a
    crossing token to the section of its first or last character, 'most' to the one
    that holds most of its characters, and of equals to the earliest.
    """
    # empty sections hold no character and get no token
    low = np.searchsorted(starts, first, side="right") - 1
    high = np.searchsorted(starts, last, side="right") - 1
    crossing = low != high
    chosen = high.copy() if rule == "end" else low.copy()
    if rule == "most":
        for t in np.flatnonzero(crossing):
            held = [min(last[t] + 1, stops[s]) - max(first[t], starts[s])
                    for s in range(low[t], high[t] + 1)]
            chosen[t] = low[t] + int(np.argmax(held))
    return chosen, crossing


def count_tokens(docs: DataFrame, path: str, fields: list[str], by_line: list[str] = (),
                 separator: str = "\n", rule: str = "most", id_col: str = "doc_id") -> DataFrame:
    """One row per section: id, section, field, start_char, n_chars, n_tokens, n_crossing.

    ``n_crossing`` counts the section's tokens that reach into another.  The sections of a
    document add up to all its characters and tokens; a null field counts as empty, and
    an empty section has no tokens.  Null and repeated ids are documents of their own.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    raw, split = vocabulary(docs.sparkSession, path), frozenset(by_line)
    rows = docs.select(F.col(id_col).alias("id"), F.array(*[
        F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("fields"))

    def run(batches):
        bpe = built(ByteBpe, raw.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield count(bpe, batch.slice(at, ROWS))

    def count(bpe, batch):
        laid = [sections_of(v, fields, separator, split) for v in batch.column("fields").to_pylist()]
        out = []
        for row, ((text, sections), (_, lengths)) in enumerate(
                zip(laid, bpe.encode([whole for whole, _ in laid]))):
            edges = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, "<u2"), dtype=np.int64)))
            if not text.isascii():
                head = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
                letter = np.cumsum(head) - 1
                first, last = letter[edges[:-1]], letter[edges[1:] - 1]
            else:
                first, last = edges[:-1], edges[1:] - 1
            starts = np.array([s for _, s, _ in sections])
            stops = np.array([e for _, _, e in sections])
            chosen, crossing = attribute(first, last, starts, stops, rule)
            tokens = np.bincount(chosen, minlength=len(sections))
            crossed = np.bincount(chosen[crossing], minlength=len(sections))
            out.append((np.full(len(sections), row), np.arange(len(sections)),
                        [name for name, _, _ in sections], starts, stops - starts, tokens, crossed))
        row, section, field, start, size, tokens, crossed = zip(*out)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(np.concatenate(row))),
             pa.array(np.concatenate(section), pa.int64()),
             pa.array([n for names in field for n in names], pa.string()),
             *(pa.array(np.concatenate(x), pa.int64()) for x in (start, size, tokens, crossed))],
            ["id", "section", "field", "start_char", "n_chars", "n_tokens", "n_crossing"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, section long, field string, start_char long, n_chars long, "
             "n_tokens long, n_crossing long").withColumnRenamed("id", id_col)
