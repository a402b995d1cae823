"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the BPE encoding ends with exactly one token.  A suffix
automaton of the vocabulary names the tokens that end at each position; a candidate is the
last token of the prefix when it is compatible with the last token of the prefix before
it, that is, when BPE would leave the two tokens side by side.  One pointer per prefix is
stored, and following the pointers back gives the ids that merging would give.
"""

from __future__ import annotations

import json
from array import array
from itertools import filterfalse

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import text_of
from dossier.llm.tokens import (
    built, byte_characters, composed, lowered, shorten, special_tokens, splitter, vocabulary)

CACHED_PAIRS = 2_000_000
ROWS_OUT = 256
# white space to str.split, but not to the vocabulary's patterns
SEPARATORS = "\x1c\x1d\x1e\x1f"
END_SHIFT = 0x1000


class PrefixBpe:
    """Encoder of a word vocabulary with an end-of-word suffix."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        if not end or model["continuing_subword_prefix"] or model["unk_token"]:
            raise ValueError("a vocabulary with an end-of-word suffix is expected")
        self.special = special_tokens(spec)
        self._split = splitter(self.special)
        self._piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._space = regex.compile(rf"[^\S{SEPARATORS}]+")
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self._char = byte_characters()
        # a word's last byte is a symbol of its own, END_SHIFT above the plain one
        self._last = [chr(ord(c) + END_SHIFT) for c in self._char]
        form = {c: c for c in self._char} | {
            c + end: e for c, e in zip(self._char, self._last)}
        self._edges = ({}, {})
        self._rank, self._parts, self._born = {}, {}, {vocab[t]: -1 for t in form}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a not in form or b not in form or a + b in form:
                raise ValueError(f"merge {rank} does not make one new token of two earlier ones")
            form[a + b] = form[a] + form[b]
            made = vocab[a + b]
            self._rank[vocab[a], vocab[b]] = rank
            self._parts[made], self._born[made] = (vocab[a], vocab[b]), rank
        self._size = {vocab[t]: len(f) for t, f in form.items()}
        self._pairs: dict[int, bool] = {}
        # only tokens that BPE makes of their own text can occur
        sound = set()
        for t in form:
            i = vocab[t]
            if i not in self._parts or (sound.issuperset(self._parts[i])
                                        and self._cross(*self._parts[i]) == self._born[i]):
                sound.add(i)
        self._automaton = ahocorasick.Automaton()
        for t, f in form.items():
            if vocab[t] in sound:
                self._automaton.add_word(f, (vocab[t], len(f)))
        self._automaton.make_automaton()
        # lower-cased chunks: their ids, and what these decode to
        self._chunks: dict[str, bytes] = {}
        self._decoded: dict[str, str] = {}
        self._words: dict[str, tuple[bytes, str]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens at one edge of a token while it is being built: (token, the rank that
        made it, the rank that took it up)."""
        out = self._edges[side].get(token)
        if out is None:
            out, at, taken = [], token, float("inf")
            while True:
                out.append((at, self._born[at], taken))
                if at not in self._parts:
                    break
                taken, at = self._born[at], self._parts[at][side]
            self._edges[side][token] = out
        return out

    def _cross(self, left: int, right: int) -> int | None:
        """Rank of the first merge across the border of two tokens; None when there is none.

        Equal pairs merge from left to right, so a pair whose right member is taken
        up at the same rank still wins, and one whose left member is does not.
        """
        found, ranks, right_edge = [], self._rank, self._edge(right, 0)
        for x, born_x, taken_x in self._edge(left, 1):
            for y, born_y, taken_y in right_edge:
                rank = ranks.get((x, y))
                if rank is not None and born_x < rank < taken_x and born_y < rank <= taken_y:
                    found.append(rank)
        return min(found, default=None)

    def _fill(self, word: str, last: list[int], known: int) -> None:
        """Store the last token of every prefix longer than ``known``."""
        pairs = self._pairs
        last[known + 1:] = [-1] * (len(word) - known)
        for stop, (token, size) in self._automaton.iter(word):
            stop += 1
            if last[stop] >= 0:
                continue
            if size < stop:
                before = last[stop - size]
                if before < 0:
                    continue
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._cross(before, token) is None
                if not fits:
                    continue
            last[stop] = token

    def _learn_words(self, pieces) -> None:
        """Encode new words in sorted order: a word shares the stored prefixes of the one
        before it, all but their last symbol, which ends a word."""
        if len(self._pairs) > CACHED_PAIRS:
            self._pairs.clear()
        char, final, size, words = self._char, self._last, self._size, self._words
        last, before = [-1], ""
        for piece in sorted(pieces):
            if piece.isascii() and piece.isprintable():     # such bytes stand for themselves
                word = piece[:-1] + final[ord(piece[-1])]
            else:
                raw = piece.encode()
                word = "".join([char[b] for b in raw[:-1]]) + final[raw[-1]]
            known = min(len(word), len(before)) - 1
            while known > 0 and word[:known] != before[:known]:
                known -= 1
            self._fill(word, last, max(known, 0))
            before, n, ids = word, len(word), []
            while n:
                ids.append(last[n])
                n -= size[last[n]]
            ids.reverse()
            words[piece] = array("i", ids).tobytes(), " ".join([self.text[i] for i in ids])

    def _cut(self, text: str) -> list[str]:
        """Lower-cased chunks of a text without special tokens.  No white space composes with its
        neighbours or has another case, so a text is lowered whole and then cut."""
        low = lowered(composed(text))
        if any(c in low for c in SEPARATORS):
            return [c for c in self._space.split(low) if c]
        return low.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text its ids as four bytes each, and what the ids decode to."""
        chunks, decoded, words = self._chunks, self._decoded, self._words
        shorten(chunks, decoded, words)
        cut = []
        for text in texts:
            parts = self._split.split(text) if self._split and "<" in text else [text]
            cut.append([part if k % 2 else self._cut(part) for k, part in enumerate(parts)])
        new = set()
        for parts in cut:
            for part in parts:
                if isinstance(part, list):
                    new.update(filterfalse(chunks.__contains__, part))
        pieces = {c: [c] if c.isalpha() else self._piece.findall(c) for c in new}
        self._learn_words({p for found in pieces.values() for p in found}.difference(words))
        for chunk, found in pieces.items():
            if len(found) == 1:
                chunks[chunk], decoded[chunk] = words[found[0]]
            else:
                got = [words[p] for p in found]
                chunks[chunk] = b"".join([g[0] for g in got])
                decoded[chunk] = " ".join([g[1] for g in got])
        out = []
        for parts in cut:
            ids, shown = [], []
            for part in parts:
                if isinstance(part, list):
                    ids += map(chunks.__getitem__, part)
                    shown += filter(None, map(decoded.__getitem__, part))
                else:
                    ids.append(self.special[part].to_bytes(4, "little"))
                    shown.append(part)
            out.append((b"".join(ids), " ".join(shown)))
        return out

    def decode(self, ids) -> str:
        """Tokens side by side with a space between: the vocabulary names no decoder."""
        return " ".join(self.text[i] for i in ids)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded: the whole text's ids and what they decode to.

    Null counts as empty; an empty or blank text has no ids and decodes to the empty
    text.  Special tokens written in a text become their ids.  Null and repeated ids are
    kept: one row out per row in.  Work is row by row; the only state are two bounded
    caches per worker.
    """
    raw = vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    kind = rows.schema["id"].dataType

    def run(batches):
        bpe = built(PrefixBpe, raw.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                got = bpe.encode(batch.column("body").to_pylist())
                stops = [0]
                for g in got:
                    stops.append(stops[-1] + len(g[0]) // 4)
                values = pa.Array.from_buffers(
                    pa.int32(), stops[-1], [None, pa.py_buffer(b"".join(g[0] for g in got))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values),
                     pa.array([g[1] for g in got], pa.string())], ["id", "ids", "decoded"])

    return (rows.mapInArrow(run, f"id {kind.simpleString()}, ids array<int>, decoded string")
            .withColumnRenamed("id", id_col))
