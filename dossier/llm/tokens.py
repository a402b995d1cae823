"""Vocabulary files, and the byte-level encoder that the packing and counting operators share.

A vocabulary file is read once on the driver and broadcast (a file of a few MB, whatever
the corpus); each Python worker builds its encoder once and keeps it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from pathlib import Path

import numpy as np
import regex
import tiktoken

# fixed value: the split pattern of the byte-level pre-tokenizer
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

CACHED_CHUNKS = 250_000
KEPT_CHUNKS = CACHED_CHUNKS * 2 // 3
LONGEST_CACHED = 64

_BUILT: dict = {}


def vocabulary(spark, path: str):
    """The file's bytes as a broadcast value."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def built(kind, raw: bytes):
    """The worker's one instance of ``kind`` for a vocabulary."""
    key = (kind.__name__, hashlib.md5(raw).digest())
    if key not in _BUILT:
        _BUILT[key] = kind(raw)
    return _BUILT[key]


def shorten(*caches: dict) -> None:
    """Full caches keep what came first, which is what comes often; the last third makes way."""
    for cache in caches:
        if len(cache) > CACHED_CHUNKS:
            for key in list(cache)[KEPT_CHUNKS:]:
                del cache[key]


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones stand for themselves,
    the others take the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


def special_tokens(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


def splitter(special: dict[str, int]):
    """text -> [text, special, text, ...]; None when there is no special token."""
    if not special:
        return None
    longest = sorted(special, key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, longest)) + ")")


class _Known(dict):
    """Encoded chunks; those that are not kept are encoded at each use."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        return self.encode(chunk)


class ByteBpe:
    """Byte-level BPE over chunks: words repeat, so each distinct chunk is encoded once
    while it stays in a bounded cache, and a whole text is a join of its chunks' bytes.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = special_tokens(spec)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = [vocab[a + b] for a, b in pairs]
        if spec["normalizer"] or made != sorted(set(made)):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        code = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(code[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self._core = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self._line_end = ranks[b"\n"]
        self._length = np.zeros(self.size, "<u2")
        for token, i in ranks.items():
            self._length[i] = len(token)
        for token, i in self.special.items():
            self._length[i] = len(token.encode())
        self._split = splitter(self.special)
        self._ids = _Known(lambda chunk: self._alone(chunk)[0])
        self._lengths = _Known(lambda chunk: self._alone(chunk)[1])

    def _entry(self, ids) -> tuple[bytes, bytes]:
        ids = np.asarray(ids, self.dtype)
        return ids.tobytes(), self._length[ids].tobytes()

    def _alone(self, chunk: str) -> tuple[bytes, bytes]:
        return self._entry(self._core.encode_ordinary(chunk))

    def _chunks(self, text: str) -> list[str]:
        """Cuts before a single space between other characters, and around a single line
        end: no piece of the pattern reaches over such a cut."""
        if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text
                or text[:1].isspace() or text[-1:].isspace()
                or len(text.split()) != text.count(" ") + text.count("\n") + 1):
            return [text]
        if "\0" in text:
            return [text]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _learn(self, chunks: set[str], sizes: bool) -> None:
        """Encode new chunks in one call, with a line end between them; their lengths are kept
        only for those who ask for ``sizes``."""
        line = [c for c in chunks if "\n" not in c and len(c) <= LONGEST_CACHED]
        ids = np.asarray(self._core.encode_ordinary("\n".join(line)), self.dtype)
        width, lengths = self.width, self._length[ids].tobytes()
        cuts = [-1, *np.flatnonzero(ids == self._line_end).tolist(), len(ids)]
        raw, known, measured = ids.tobytes(), self._ids, self._lengths
        for chunk, start, stop in zip(line, cuts, cuts[1:]):
            start += 1
            known[chunk] = raw[start * width:stop * width]
            if sizes:
                measured[chunk] = lengths[start * 2:stop * 2]
        known["\n"], measured["\n"] = self._entry([self._line_end])

    def _pieces(self, text: str):
        """[(is special, piece)] of a text."""
        parts = self._split.split(text) if self._split and "<" in text else [text]
        return [(k % 2 == 1, p) for k, p in enumerate(parts) if p]

    def _cut(self, texts: list[str], sizes: bool) -> list[list[tuple[bool, list[str]]]]:
        """Every text as [(is special, chunks)]; its chunks are learned."""
        if len(self._ids) > CACHED_CHUNKS:
            self._ids.clear()
            self._lengths.clear()
        cut = [[(special, [piece] if special else self._chunks(piece))
                for special, piece in self._pieces(t)] for t in texts]
        self._learn(set().union(*(
            chunks for parts in cut for special, chunks in parts
            if not special and len(chunks) > 1)).difference(
                self._lengths if sizes else self._ids), sizes)
        return cut

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts."""
        known = self._ids.__getitem__

        def piece(special: bool, chunks: list[str]) -> bytes:
            if special:
                return self._entry([self.special[chunks[0]]])[0]
            return b"".join(map(known, chunks))

        return [b"".join([piece(*part) for part in parts]) for parts in self._cut(texts, False)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, UTF-8 lengths as two bytes each) of whole texts."""
        known, sizes = self._ids.__getitem__, self._lengths.__getitem__

        def piece(special: bool, chunks: list[str]) -> tuple[bytes, bytes]:
            if special:
                return self._entry([self.special[chunks[0]]])
            if len(chunks) == 1:
                return self._alone(chunks[0])
            return b"".join(map(known, chunks)), b"".join(map(sizes, chunks))

        out = []
        for parts in self._cut(texts, True):
            got = [piece(*part) for part in parts]
            out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return out


def lowered(text: str) -> str:
    """Lower case letter by letter, without the rule for a final sigma."""
    return text.replace("Σ", "σ").lower()


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)
