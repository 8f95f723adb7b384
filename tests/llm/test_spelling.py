"""Spelling variants against every pair of words."""

import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from strikelake.llm import queries as Q
from strikelake.llm.spelling import rotations, spelling_variants, word_counts

SF = "/root/testdata/sf0.001"


def plain_counts(docs, min_length=5, min_count=3, every=97):
    tally = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            code = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if every and code % every == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= min_length:
                tally[run] += 1
    return {w: n for w, n in tally.items() if n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    near = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for size, some in by_length.items():
        for a, b in [*combinations(some, 2), *[(a, b) for a in some for b in by_length.get(size + 1, [])]]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = variants_of(Q.op11_spelling_variants(spark, SF))
    assert found == plain_variants(plain_counts(docs))
    assert any(r[1] for r in found)


def test_repeated_letters_and_ties(spark):
    counts = {"aaab": 5, "aab": 20, "ab": 40, "b": 3, "abb": 40, "aaabb": 2, "éab": 9, "eab": 9, "ba": 9, "×a": 4, "x": 1}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert variants_of(spelling_variants(words)) == plain_variants(counts)
    keys = Counter((r.key, r.skipped is None, r.word) for r in rotations(words).collect())
    assert max(keys.values()) == 1


@pytest.mark.parametrize("held", [1, 200_000])
def test_counts_of_odd_rows(spark, odd_docs, no_docs, held):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for every in (None, 2):
        found = word_counts(odd_docs, min_length=2, min_count=1, typo_every=every, held=held)
        assert {r.word: r.n for r in found.collect()} == plain_counts(rows, 2, 1, every)
    assert spelling_variants(word_counts(no_docs)).count() == 0


def test_long_way_to_the_root(spark):
    word = "abcdefghij"
    counts = {word[:k]: 4**k for k in range(1, 11)}
    found = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r.root for r in found.collect()} == {word}
