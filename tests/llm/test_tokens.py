"""Encoding, packing and counting against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import odd
from dossier.llm import bpe, counting, packing, tokens
from dossier.llm.tokens import ByteBpe

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def texts() -> list[str]:
    chance = random.Random(3)
    out = ["", " ", "\n\n", "a<|endoftext|>b <|startoftext|>c", "  two  spaces \n\n lines\n",
           "ΑΣΣ ΟΔΟΣ Σ", "İstanbul it's WE'LL", "1234 ½ x²", "é ́x", "a\x1cb\x1fc\x00d",
           "a b c\u0085d", "漢字 😀😀 naïve", "a" * 500, "ab " * 200, "</w> a</w>",
           "\t tab\r\nline \x0b end ", "ﬁ Å ẞ ǅ"]
    letters = "abcABC éüΣß 1'!\n\t　\x1e漢😀.<>|"
    return out + ["".join(chance.choice(letters) for _ in range(chance.randint(1, 80)))
                  for _ in range(300)]


def test_prefix_encoding_equals_the_library():
    library = Tokenizer.from_file(WORD)
    own = bpe.PrefixBpe(open(WORD, "rb").read())
    for text, (ids, decoded) in zip(texts(), own.encode(texts())):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == want, repr(text)
        assert decoded == own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_token_is_its_own_encoding():
    own = bpe.PrefixBpe(open(WORD, "rb").read())
    # the pair test and merging by hand agree on random pairs
    chance, tokens = random.Random(1), sorted(own._parts)

    def merged(symbols):
        while True:
            ranks = [(own._rank.get(p, 1 << 30), k) for k, p in enumerate(zip(symbols, symbols[1:]))]
            if not ranks or min(ranks)[0] == 1 << 30:
                return symbols
            best = min(ranks)[0]
            made = next(t for t, p in own._parts.items() if own._born[t] == best)
            out, k = [], 0
            while k < len(symbols):
                if own._rank.get(tuple(symbols[k:k + 2])) == best:
                    out.append(made)
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out

    def leaves(token):
        return sum(map(leaves, own._parts[token]), []) if token in own._parts else [token]

    plain = [t for t in tokens[:3000] if not own.text[t].endswith("</w>")]
    for _ in range(150):
        a, b = chance.choice(plain), chance.choice(tokens[:3000])
        assert (own._cross(a, b) is None) == (merged(leaves(a) + leaves(b)) == [a, b])


def test_byte_encoding_equals_the_library():
    library, own = Tokenizer.from_file(BYTE), ByteBpe(open(BYTE, "rb").read())
    for text, (ids, lengths) in zip(texts(), own.encode(texts())):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(
            text, add_special_tokens=False).ids, repr(text)
        assert np.frombuffer(lengths, "<u2").sum() == len(text.encode())


def test_encoding_of_odd_rows(spark):
    library = Tokenizer.from_file(WORD)
    got = bpe.encode(odd.table(spark), WORD).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in odd.rows()]
    assert sorted(((r.doc_id or -1, list(r.ids)) for r in got)) == sorted(
        (i or -1, ids) for i, ids in want)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got)
    assert bpe.encode(odd.table(spark, empty=True), WORD).count() == 0


@pytest.mark.parametrize("length", [16, 1024])
def test_packing_loses_no_token(spark, length):
    library = Tokenizer.from_file(BYTE)
    pieces = packing.pack(odd.table(spark), BYTE, length).toPandas()
    want = sorted(library.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in odd.rows())
    # a document ends where start + length reaches its token count
    total = sum(map(len, want))
    sequences = {s: g.sort_values("offset") for s, g in pieces.groupby("sequence_id")}
    assert sorted(sequences) == list(range(-(-total // length)))
    stream = []
    for s in sorted(sequences):
        at = 0
        for p in sequences[s].itertuples():
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
            stream.append((p.start, p.doc_tokens, np.frombuffer(p.ids, "<u4").tolist()))
        assert at == length or s == max(sequences)
    got, open_ = [], []
    for start, tokens, ids in stream:
        assert start == len(open_)
        open_ += ids
        if len(open_) == tokens:
            got.append(open_)
            open_ = []
    assert sorted(got) == want and not open_


def test_packing_of_nothing(spark):
    assert packing.pack(odd.table(spark, empty=True), BYTE).count() == 0


def test_curve_visits_every_cell_by_single_steps():
    for bits, n in ((3, 2), (2, 3), (2, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        keys = packing.hilbert_keys(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_checksum_of_pieces(spark):
    from pyspark.sql import functions as F

    pieces = packing.pack(odd.plain(spark, ["some text", None]), BYTE).select(
        "ids", F.crc32("ids").alias("c")).collect()
    assert all(r.c == zlib.crc32(r.ids) for r in pieces)


def counts_by_hand(fields: list[str], by_line: list[bool], rule: str) -> list[tuple]:
    whole = "\n".join(fields)
    borders, at = [], 0
    for k, (value, cut) in enumerate(zip(fields, by_line)):
        parts = value.split("\n") if cut else [value]
        for j, part in enumerate(parts):
            last = j + 1 == len(parts) and k + 1 == len(fields)
            borders.append((at, at + len(part) + (not last)))
            at = borders[-1][1]
    tokens, crossed = [0] * len(borders), [0] * len(borders)
    for a, b in Tokenizer.from_file(BYTE).encode(whole, add_special_tokens=False).offsets:
        held = [max(0, min(b, e) - max(a, s)) for s, e in borders]
        inside = [k for k, n in enumerate(held) if n]
        own = {"start": inside[0], "end": inside[-1], "most": held.index(max(held))}[rule]
        tokens[own] += 1
        crossed[own] += len(inside) > 1
    return [(k, s, e - s, tokens[k], crossed[k]) for k, (s, e) in enumerate(borders)]


@pytest.mark.parametrize("rule", counting.RULES)
def test_counts_equal_the_librarys_offsets(spark, rule):
    rows = [(k, "src", t) for k, t in enumerate(texts() + ["a\n\n\n\nb", "x \n \n y\n"])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {}
    for r in counting.count_tokens(docs, BYTE, ["source", "text"], ["text"], rule=rule).collect():
        got.setdefault(r.doc_id, []).append(
            (r.section, r.start_char, r.n_chars, r.n_tokens, r.n_crossing))
    for k, source, text in rows:
        assert sorted(got[k]) == counts_by_hand([source, text], [False, True], rule), repr(text)


def test_counts_of_odd_rows(spark):
    got = counting.count_tokens(odd.table(spark), BYTE, ["id", "text"], ["text"], id_col="row")
    sums = {r.row: r.n for r in got.groupBy("row").agg({"n_tokens": "sum"}).toDF("row", "n").collect()}
    library = Tokenizer.from_file(BYTE)
    for r in odd.rows():
        whole = f"{r[2]}\n{r[1] or ''}"
        assert sums[r[3]] == len(library.encode(whole, add_special_tokens=False).ids)
    assert counting.count_tokens(odd.table(spark, empty=True), BYTE, ["text"]).count() == 0
    with pytest.raises(ValueError):
        counting.count_tokens(odd.table(spark), BYTE, ["text"], rule="half")


def test_word_chunks_are_cached_by_lower_case_and_the_first_stay(monkeypatch):
    own, fresh = (bpe.PrefixBpe(open(WORD, "rb").read()) for _ in range(2))
    own.encode(["The THE the", "ΟΔΟΣ ΟΔΟσ"])
    assert set(own._chunks) == {"the", "οδοσ"}
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 6)
    monkeypatch.setattr(tokens, "KEPT_CHUNKS", 4)
    for text in ("a b c d e f g", "h i", "É́ x Y\x1cz A ́b", "the a"):
        assert own.encode([text]) == fresh.encode([text])
        assert "the" in own._chunks and set(own._chunks) == set(own._decoded)
