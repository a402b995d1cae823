"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces, pieces into words.  The longest grams, of four words, are the edges
of a graph whose nodes are the overlapping grams of three words; equal edges add up to a weight.
A piece's last words start shorter grams, which count as corrections of its end.  So every word
occurrence starts exactly one gram, and the count of a shorter phrase is the flow through its
node: the weights of all grams that begin with it, corrections included.

Where a node passes its whole flow from one edge to one edge, the path is compacted into one row
of up to ``2 ** ROUNDS + 3`` words; a longer path becomes several rows.  All edges of a compacted
path have one weight, so its rows tell at once which shorter phrases it contains how often.

Tasks add up the grams of a bounded stretch of text and send them as adjacency lists of the
node's first two words: one shuffle, after which all counts are sums within a group.  Word pairs
that a sample shows to hold over 1/1024 of all places (fewer than 1024, whatever the table) are
spread over ``SALTS`` groups by their next word, and so are such triples by their fourth.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import HOT_SHARE, SALTS, written

# fixed values: characters that end a piece, and the two that part words
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

LONGEST, ROUNDS, CUTS = 4, 4, 32
HOT_SAMPLE = 1000           # documents read to find hot pairs; they only decide where rows go
# a task works on this much at a time; its memory follows from it, the rows hardly do
CHUNK_BYTES, PLACES = 2 << 20, 1 << 19
ENTRIES, GATHERED, HELD = 4096, 1 << 18, 1 << 21
BITS, LOW = 21, (1 << 21) - 1

_TABLE = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
# a key (pair, route, language, apart by tabs) and its entries, each after a line end
ADJACENT = "row string"
FOUND = "k int, lang string, phrase string, n long, part boolean"


def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word, text number) of all places of the texts, and the words; word 0 ends a piece."""
    codes: dict = defaultdict(count().__next__)
    line, text, nothing = codes[b"\n"], codes[b"\r"], codes[b""]
    raw = b" \r ".join(r.lower().translate(_TABLE).replace(b"\n", b" \n ") for r in raws)
    tokens = raw.split(b" ")
    place = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    place = place[place != nothing]
    number = np.cumsum(place == text)
    names = pa.array([b"", *list(codes)[3:]], pa.binary()).cast(pa.string())
    return np.maximum(place - 2, 0), number, names


def _grams(word: np.ndarray, number: np.ndarray, start: int, stop: int):
    """(text number, w1, w2, w3, w4) of the grams that start in [start, stop)."""
    columns, going = [word[start:stop]], None
    for k in range(1, LONGEST):
        later = word[start + k:stop + k]
        later = np.concatenate((later, np.zeros(stop - start - len(later), np.int64)))
        going = later > 0 if going is None else going & (later > 0)
        columns.append(np.where(going, later, 0))
    real = columns[0] > 0
    return [number[start:stop][real], *(c[real] for c in columns)]


def _adjacency(raws: list[bytes], langs: list[str], hot: tuple[set, set], places: int = PLACES):
    """Record batches of ADJACENT: equal grams added up, by language and first two words.

    A row is one string, since columns of their own would double its size.
    """
    word, number, names = _words(raws)
    codes: dict = defaultdict(count().__next__)
    lang_of = np.fromiter((codes[x] for x in langs), np.int64, len(langs))
    lang_names = pa.array([quote(x, safe="") for x in codes], pa.string())
    for start in range(0, len(word), places):
        stop = min(start + places, len(word))
        texts, *grams = _grams(word, number, start, stop)
        if not len(texts):
            continue
        known, size = names, len(names)
        if size > LOW:      # a stretch of a very long text is numbered anew
            own, local = np.unique(np.concatenate([np.zeros(1, np.int64), *grams]),
                                   return_inverse=True)
            known, size, grams = names.take(pa.array(own)), len(own), np.split(local[1:], LONGEST)
        w1, w2, w3, w4 = grams
        pairs, pair = np.unique((lang_of[texts] * size + w1) * size + w2, return_inverse=True)
        edges, n = np.unique(pair << 2 * BITS | w3 << BITS | w4, return_counts=True)
        pair, w3, w4 = edges >> 2 * BITS, edges >> BITS & LOW, edges & LOW
        lang, first = np.divmod(pairs, size * size)
        lang = lang_names.take(pa.array(lang))
        nodes = pc.binary_join_element_wise(
            known.take(pa.array(first // size)), known.take(pa.array(first % size)), " ")
        third, fourth = known.take(pa.array(w3)), known.take(pa.array(w4))
        entries = pc.binary_join_element_wise(
            third, fourth, pa.array(n).cast(pa.string()), " ")
        route = _routes(lang, nodes, pair, known, w3, w4, hot)
        # rows of one pair and route, of at most ENTRIES entries
        order = np.lexsort((route, pair)) if (route >= 0).any() else np.arange(len(pair))
        pair, route = pair[order], route[order]
        new = np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(route) != 0)))
        begun = np.maximum.accumulate(np.where(new, np.arange(len(pair)), 0))
        cuts = np.flatnonzero((np.arange(len(pair)) - begun) % ENTRIES == 0)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(cuts, len(pair)), pa.int32()), entries.take(pa.array(order)))
        at = pa.array(pair[cuts])
        key = pc.binary_join_element_wise(
            nodes.take(at), pa.array(route[cuts]).cast(pa.string()), lang.take(at), "\t")
        yield pa.RecordBatch.from_arrays(
            [pc.binary_join_element_wise(key, pc.binary_join(lists, "\n"), "\n")], ["row"])


def _routes(lang, nodes, pair, known, w3, w4, hot: tuple[set, set]) -> np.ndarray:
    """-1; for entries of hot pairs a salt by the third word, of hot triples by the fourth."""
    route = np.full(len(pair), -1, np.int64)
    keys = pc.binary_join_element_wise(lang, nodes, "\t")

    def among(these: pa.Array, wanted: set) -> np.ndarray:
        return pc.is_in(these, value_set=pa.array(["\t".join(k) for k in wanted], pa.string())
                        ).to_numpy(zero_copy_only=False)

    def salts(codes):
        own, back = np.unique(codes, return_inverse=True)
        texts = known.take(pa.array(own)).to_pylist()
        return np.array([zlib.crc32(t.encode()) % SALTS for t in texts], np.int64)[back]

    at = np.flatnonzero(among(keys, hot[0])[pair])
    if len(at):
        route[at] = salts(w3[at])
        at = at[among(pc.binary_join_element_wise(
            keys.take(pa.array(pair[at])), known.take(pa.array(w3[at])), "\t"), hot[1])]
    if len(at):
        route[at] = SALTS + salts(w4[at])
    return route


def _sent(rows: DataFrame, hot: tuple[set, set], chunk: int = CHUNK_BYTES,
          places: int = PLACES) -> DataFrame:
    """Adjacency lists of rows (lang, body), from about ``chunk`` bytes of text at a time."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        raws, langs, held = [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                for lang, body in zip(batch.column("lang").to_pylist(),
                                      batch.column("body").to_pylist()):
                    raws.append(body.encode())
                    langs.append(lang)
                    held += len(raws[-1]) + 2
                    if held >= chunk:
                        yield from _adjacency(raws, langs, shared.value, places)
                        raws, langs, held = [], [], 0
        if raws:
            yield from _adjacency(raws, langs, shared.value, places)

    return rows.mapInArrow(run, ADJACENT)


def _hot(rows: DataFrame) -> tuple[set, set]:
    """Pairs and triples over 1/HOT_SHARE of a sample's places: fewer than HOT_SHARE each.

    The sample only decides how rows are spread, not what is counted.
    """
    size = rows.count()
    if not size:
        return set(), set()
    sample = rows.sample(False, min(1.0, HOT_SAMPLE / size), 7)
    entry = F.explode(F.slice(F.split("row", "\n"), 2, 1 << 30)).alias("entry")
    part = lambda column, by, at: F.split_part(column, F.lit(by), F.lit(at))
    key = F.substring_index("row", "\n", 1)
    lists = written(_sent(sample, (set(), set())).select(
        part(key, "\t", 3).alias("lang"), part(key, "\t", 1).alias("node"), entry).select(
        "lang", "node", part(F.col("entry"), " ", 1).alias("third"),
        part(F.col("entry"), " ", 3).cast("long").alias("n")))
    places = lists.agg(F.sum("n")).first()[0] or 0

    def over(*keys):
        sums = lists.groupBy(*keys).agg(F.sum("n").alias("n"))
        return {tuple(r)[:-1] for r in sums.filter(
            F.col("n") > places / HOT_SHARE).collect()}    # fewer than HOT_SHARE rows

    return over("lang", "node"), over("lang", "node", "third")


def _added(rows: pa.Array):
    """Entries of adjacency rows, equal ones added up: (group of the row's key, third word,
    fourth word, count), the words, and the key of every group; rows are sorted."""
    halves = pc.split_pattern(rows, "\n", max_splits=1).flatten()
    even = pa.array(np.arange(0, len(halves), 2))
    keys, edges = halves.take(even), halves.take(pc.add(even, 1))
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(edges, "\n")
    parts = pc.split_pattern(lists.flatten(), " ").flatten()
    group = np.repeat(np.cumsum(new) - 1, np.diff(lists.offsets.to_numpy()))
    words = pc.dictionary_encode(pa.concat_arrays(
        [pa.array([""]), parts.take(_every(parts, 0)), parts.take(_every(parts, 1))]))
    codes, total = words.indices.to_numpy().astype(np.int64)[1:], len(group)
    n = parts.take(_every(parts, 2)).cast(pa.int64()).to_numpy()
    key = group << 2 * BITS | codes[:total] << BITS | codes[total:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0))[:total])
    n = np.add.reduceat(n[order], first) if total else n
    key = key[first]
    return (key >> 2 * BITS, key >> BITS & LOW, key & LOW, n, words.dictionary,
            keys.take(pa.array(np.flatnonzero(new))))


def _every(parts: pa.Array, at: int) -> pa.Array:
    return pa.array(np.arange(at, len(parts), 3))


def _sums(batch: pa.Array, least: int, cut: bool):
    """Counts of the phrases that begin with the rows' nodes, as FOUND rows.

    ``cut``: the rows are not all of their only group, so every count is a part.
    """
    group, w3, w4, n, words, keys = _added(batch)
    size = len(keys)
    parts = pc.split_pattern(keys, "\t").flatten()
    node, route, lang = (parts.take(_every(parts, k)) for k in range(3))
    route, lang = route.cast(pa.int64()).to_numpy(), lang.dictionary_encode()
    lang = pa.array([unquote(x) for x in lang.dictionary.to_pylist()], pa.string()).take(
        lang.indices)
    halves = pc.split_pattern(node, " ").flatten()
    even = pa.array(np.arange(0, len(halves), 2))
    first, second = halves.take(even), halves.take(pc.add(even, 1))
    paired = pc.not_equal(second, "").to_numpy(zero_copy_only=False)

    def rows(k: int, where, phrase: pa.Array, counts, part):
        shown = pa.array(np.flatnonzero(part | (counts >= least)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(shown), k), pa.int32()), lang.take(pa.array(where)).take(shown),
             phrase.take(shown), pa.array(counts).take(shown), pa.array(part).take(shown)],
            ["k", "lang", "phrase", "n", "part"])

    real = np.flatnonzero(w4)
    at = pa.array(group[real])
    yield rows(4, group[real], pc.binary_join_element_wise(
        node.take(at), words.take(pa.array(w3[real])), words.take(pa.array(w4[real])), " "),
        n[real], np.full(len(real), cut))
    starts = np.flatnonzero(np.concatenate(
        ([True], (np.diff(group) != 0) | (np.diff(w3) != 0)))[:len(group)])
    flow = np.add.reduceat(n, starts) if len(starts) else n
    owner, third = group[starts], w3[starts]
    real = np.flatnonzero(third)
    yield rows(3, owner[real], pc.binary_join_element_wise(
        node.take(pa.array(owner[real])), words.take(pa.array(third[real])), " "),
        flow[real], cut | (route[owner[real]] >= SALTS))
    total = np.add.reduceat(flow, np.searchsorted(owner, np.arange(size)))
    real = np.flatnonzero(paired)
    yield rows(2, real, node.take(pa.array(real)), total[real], cut | (route[real] >= 0))
    # neighbouring groups often share their first word
    change = np.ones(size, bool)
    if size > 1:
        change[1:] = ~pc.and_(pc.equal(first[1:], first[:-1]),
                              pc.equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(change)
    yield rows(1, starts, first.take(pa.array(starts)), np.add.reduceat(total, starts),
               np.ones(len(starts), bool))


def _flows(lists: DataFrame, least: int, gathered: int = GATHERED,
           most: int = HELD) -> DataFrame:
    """FOUND rows of all phrases; parts of one phrase are still apart.

    A group of at most ``most`` entries is summed at once; a larger one is given out in parts, so
    a task's memory does not depend on the size of its groups.
    """
    def run(batches):
        held, entries, cut = [], 0, None        # cut: the key of a group given out in parts
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.column("row").slice(at, 1024)
                held.append(piece)
                entries += pc.sum(pc.count_substring(piece, "\n")).as_py()
                if entries < gathered:
                    continue
                rows = pa.concat_arrays(held)
                starts, last = _starts(rows, cut), _starts(rows, rows[-1].as_py().split("\n")[0])
                of_cut = pc.sum(starts).as_py() if cut is not None else 0
                after = len(rows) - pc.sum(last).as_py()
                if of_cut:
                    yield from _sums(rows.slice(0, of_cut), least, True)
                if after > of_cut:
                    yield from _sums(rows.slice(of_cut, after - of_cut), least, False)
                rows = rows.slice(max(after, of_cut))
                entries = pc.sum(pc.count_substring(rows, "\n")).as_py() or 0
                if entries >= most:
                    yield from _sums(rows, least, True)
                    cut, rows, entries = rows[-1].as_py().split("\n")[0], rows.slice(0, 0), 0
                held = [rows]
        rows = pa.concat_arrays(held) if held else []
        of_cut = pc.sum(_starts(rows, cut)).as_py() if len(rows) and cut is not None else 0
        if of_cut:
            yield from _sums(rows.slice(0, of_cut), least, True)
        if len(rows) > of_cut:
            yield from _sums(rows.slice(of_cut), least, False)

    near = lists.repartition(F.substring_index("row", "\n", 1)).sortWithinPartitions("row")
    return near.mapInArrow(run, FOUND)


def _starts(rows: pa.Array, key: str | None) -> pa.Array:
    """Whether a row has the key."""
    return pc.starts_with(rows, (key or "") + "\n")


def _span(phrase: Column, first, size) -> Column:
    """Words ``first`` (from 1) to ``first + size - 1`` of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def _paths(edges: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(lang, words, n): compacted unary paths of the edges, each edge in one path.

    A node is passed whole when one edge brings and one takes its whole flow: no piece
    begins or ends there, and no lighter edge touches it either.  Every edge looks for the
    head of its path by pointer doubling; an edge farther away than ``2 ** rounds`` is a path
    of its own.
    """
    at = nodes.select("lang", F.col("phrase").alias("node"), "n")
    ends = edges.select("lang", F.col("phrase").alias("edge"), "n")
    into = ends.select("*", _span(F.col("edge"), 2, 3).alias("node")).join(at, ["lang", "node", "n"])
    out = ends.select("*", _span(F.col("edge"), 1, 3).alias("node")).join(at, ["lang", "node", "n"])
    back = into.select("lang", "node", F.col("edge").alias("head")).join(
        out.select("lang", "node", "edge"), ["lang", "node"]).select(
        "lang", "edge", "head", F.lit(1).alias("steps"))
    jumps = written(ends.join(back.filter(F.col("edge") != F.col("head")), ["lang", "edge"], "left")
                    .select("lang", "edge", "n", F.coalesce("head", "edge").alias("head"),
                            F.coalesce("steps", F.lit(0)).alias("steps")))
    for _ in range(rounds):
        farther = jumps.filter("steps > 0").select(
            "lang", F.col("edge").alias("head"), F.col("head").alias("_head"),
            F.col("steps").alias("_steps"))
        jumps = written(jumps.join(farther, ["lang", "head"], "left").select(
            "lang", "edge", "n", F.coalesce("_head", "head").alias("head"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
    heads = jumps.filter("steps = 0").select("lang", F.col("edge").alias("head"),
                                             F.lit(True).alias("is_head"))
    home = jumps.join(heads, ["lang", "head"], "left").select(
        "lang", "n", "edge", F.when(F.col("is_head"), F.col("head")).otherwise(
            F.col("edge")).alias("head"),
        F.when(F.col("is_head"), F.col("steps")).otherwise(F.lit(0)).alias("steps"))
    last = F.element_at(F.split("edge", " "), -1)
    return home.groupBy("lang", "head").agg(
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("steps", last.alias("word")))).alias("steps")).select(
        "lang", F.concat(F.slice(F.split("head", " "), 1, 3),
                         F.transform("steps", lambda s: s.word)).alias("words"), "n")


def _containers(paths: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the greatest count of a longer phrase around it."""
    def grams(size: int) -> Column:
        places = F.sequence(F.lit(0), F.size("words") - size)
        return F.transform(places, lambda i: F.array_join(F.slice("words", i + 1, size), " "))

    inside = paths.select("lang", "n", F.explode(F.array_distinct(
        F.concat(grams(2), grams(3)))).alias("phrase"))
    pairs = triples.select("lang", "n", F.explode(F.array_distinct(F.array(
        _span(F.col("phrase"), 1, 2), _span(F.col("phrase"), 2, 2)))).alias("phrase"))
    return inside.unionByName(pairs).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def cut_score() -> Column:
    """floor(2000000 a / (l + r)) of columns a, l, r in exact arithmetic, as a long."""
    return F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(8,0))) "
                  "div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")


def counts(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text",
           ) -> tuple[DataFrame, DataFrame]:
    """(k, lang, phrase, n) of phrases of 1 to 4 words found ``least`` times or more, written
    once, and (lang, words): all word occurrences."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    found = written(_flows(_sent(rows, _hot(rows)), least))
    whole = written(found.filter("part").groupBy("k", "lang", "phrase").agg(F.sum("n").alias("n"))
                    .filter(F.col("n") >= least)
                    .unionByName(found.filter("not part").drop("part")))
    words = found.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("words"))
    return whole, words


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    A phrase of 2 to 4 words found a >= ``least`` times is scored by its worst cut into a first
    part (l times) and a rest (r times): floor(2000000 a / (l + r)), ties to the earliest cut.  A
    phrase inside a longer one of at least ``covered`` percent of its count is left out.  Higher
    scores come first, then higher a, then the phrase in UTF-8 order.

    A null text is empty, a null language is ``und``; repeated rows count as often as they stand;
    an empty table or texts without words give no rows.  Whole texts of any length are read
    in stretches of bounded size.  Other columns take no part, whatever their names.
    """
    found, words = counts(docs, least, lang_col, text_col)
    k = {size: found.filter(F.col("k") == size).drop("k") for size in (2, 3, 4)}
    inside = _containers(_paths(k[4], k[3]), k[3])
    open_ = (found.filter("k > 1").join(inside, ["lang", "phrase"], "left")
             .filter(F.col("longer").isNull()
                     | (F.lit(100).cast("decimal(4,0)") * F.col("longer").cast("decimal(20,0)")
                        < F.lit(covered).cast("decimal(4,0)") * F.col("n").cast("decimal(20,0)")))
             .select("k", "lang", "phrase", F.col("n").alias("a")))
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    cut = open_.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _span(F.col("phrase"), 1, F.col("cut")).alias("left"),
        _span(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    both = (cut.join(parts.withColumnsRenamed({"part": "left", "times": "l"}), ["lang", "left"])
            .join(parts.withColumnsRenamed({"part": "right", "times": "r"}), ["lang", "right"]))
    worst = both.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(cut_score().alias("score"), "cut", "l", "r")).alias("worst"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language is first cut to its best in CUTS parts, so its last sort is bounded
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(CUTS))).orderBy(*order)
    ranked = (worst.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
              .withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
              .filter(F.col("rank") <= top))
    return ranked.join(words, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
