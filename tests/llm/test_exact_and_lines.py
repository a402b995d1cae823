"""Exact duplicates and repeated runs of lines."""

import hashlib
import random
import string

import pytest

import odd
from dossier.llm import common, exact_dedup, lines


def lowered(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("share", [common.HOT_SHARE, 3])    # 3: the larger groups count as hot
def test_groups_equal_brute_force(spark, monkeypatch, keep, share):
    monkeypatch.setattr(exact_dedup, "hot_keys", lambda k, c: common.hot_keys(k, c, share))
    chance = random.Random(4)
    texts = [chance.choice(["Aa", "aA", "É", "é", None, "", "b" * 200, "b" * 199 + "c"]) for _ in range(90)]
    got = exact_dedup.exact_groups(odd.plain(spark, texts), keep=keep).collect()
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(lowered(t), []).append(k)
    pick = min if keep == "smallest" else max
    want = {(k, pick(g), len(g), k == pick(g), hashlib.sha256(t.encode()).hexdigest())
            for t, g in groups.items() for k in g}
    assert len(got) == 90 and {tuple(r) for r in got} == want
    kept = exact_dedup.exact_dedup(odd.plain(spark, texts), keep=keep).collect()
    assert sorted(r.doc_id for r in kept) == sorted(pick(g) for g in groups.values())


def test_odd_rows_leave_one_per_text(spark):
    docs = odd.table(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert (sorted(lowered(r.text) for r in kept.collect())
            == sorted({lowered(r[1]) for r in odd.rows()}))
    groups = exact_dedup.exact_groups(docs).collect()
    assert len(groups) == len(odd.rows()) and sum(r.kept for r in groups) == kept.count()
    # a null id is not preferred
    assert {r.keep_id for r in groups if r.group_size == 3} == {1}


def test_empty_tables(spark):
    docs = odd.table(spark, empty=True)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.exact_dedup(docs).columns == docs.columns
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert lines.repeated_runs(docs).count() == 0 and lines.cut_runs(docs).count() == 0


def test_hot_keys_are_few(spark):
    keys = spark.range(1000).selectExpr("if(id < 400, 1, id) AS k")
    assert [r.k for r in common.hot_keys(keys, "k", share=10).collect()] == [1]


def test_attach_keeps_all_rows(spark):
    rows = common.written(spark.range(5000).selectExpr("if(id < 3000, 7, id) AS k", "id"))
    small = spark.range(10_000).selectExpr("id AS k", "id * 2 AS twice")
    got = common.attach(rows, small, "k")
    assert got.count() == 5000 and got.filter("twice != 2 * k").isEmpty()


def cut_by_hand(texts: list, run: int) -> list:
    """Runs of ``run`` lines with an earlier copy, by comparing every window."""
    seen, out = {}, []
    for text in texts:
        whole = (text or "").split("\n")
        full = [(k, x.strip(" ")) for k, x in enumerate(whole) if x.strip(" ")]
        later = []
        for s in range(len(full) - run + 1):
            key = tuple(x for _, x in full[s:s + run])
            if key in seen:
                later.append(s)
            seen.setdefault(key, s)
        runs = []
        for s in later:
            if runs and s <= runs[-1][1] + run:
                runs[-1][1] = s
            else:
                runs.append([s, s])
        gone = {k for a, b in runs for k in range(full[a][0], full[b + run - 1][0] + 1)}
        out.append((len(gone), "\n".join(x for k, x in enumerate(whole) if k not in gone)))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_runs_equal_brute_force(spark, run):
    chance = random.Random(run)
    texts = ["\n".join(chance.choice(["a", " a", "b", "c", "", "d", "e"]) for _ in range(
        chance.randint(0, 14))) for _ in range(40)] + [None, ""]
    got = {r.doc_id: r for r in lines.cut_runs(odd.plain(spark, texts), run, words=None).collect()}
    for k, (gone, text) in enumerate(cut_by_hand(texts, run)):
        assert sum(r.last - r.first + 1 for r in got[k].removed_runs) == gone
        assert (got[k].text or "") == text


def test_lines_of_odd_rows(spark):
    docs = odd.table(spark)
    got = lines.cut_runs(docs, words=None).collect()
    assert len(got) == len(odd.rows())
    texts = {r.doc_id: r.text for r in got}
    assert texts[12] == "a\nb\nc\nd\ne" and texts[13] == "x\ny" and texts[1] is None
    assert {(r.doc_id, r.source_id) for r in lines.repeated_runs(docs, words=None).selectExpr(
        "id AS doc_id", "source_id").collect()} == {(13, 12)}


def cut_by_words(texts: list, run: int, words: int) -> list:
    """As ``cut_by_hand``, and fewer lines count with ``words`` words or as a whole text."""
    seen, out = set(), []
    for text in texts:
        whole = (text or "").split("\n")
        full = [(k, x.strip(" ")) for k, x in enumerate(whole) if x.strip(" ")]
        hit = set()
        for s in range(len(full)):
            for size in range(1, min(run, len(full) - s) + 1):
                key = tuple(x for _, x in full[s:s + size])
                if size == run or size == len(full) or sum(len(x.split()) for x in key) >= words:
                    if key in seen:
                        hit.update(range(s, s + size))
                    seen.add(key)
        gone = {full[s][0] for s in hit}
        for s in hit:       # blank lines inside a run go with it
            if s + 1 in hit:
                gone.update(range(full[s][0], full[s + 1][0]))
        out.append((len(gone), "\n".join(x for k, x in enumerate(whole) if k not in gone)))
    return out


def test_few_long_lines_and_short_texts_repeat(spark):
    chance = random.Random(8)
    long = [odd.words(n, n) for n in (60, 30, 25, 50, 49)]
    texts = [long[0], f"x\n{long[0]}\ny", long[0], f"{long[1]}\n\n{long[2]}", "short", "short",
             f"z\n {long[1]}\n{long[2]}", long[4], f"{long[4]}\nown line", "short\nother", None, ""]
    texts += ["\n".join(chance.choice(["a", "b", "", *long]) for _ in range(chance.randint(0, 6)))
              for _ in range(60)]
    got = {r.doc_id: r for r in lines.cut_runs(odd.plain(spark, texts)).collect()}
    for k, (gone, text) in enumerate(cut_by_words(texts, 3, 50)):
        assert sum(r.last - r.first + 1 for r in got[k].removed_runs) == gone
        assert (got[k].text or "") == text
    assert [got[k].text for k in (0, 1, 2, 4, 5, 6, 8)] == [
        long[0], "x\ny", "", "short", "", "z", f"{long[4]}\nown line"]
