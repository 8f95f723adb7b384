"""Repeat removal against a plain look at every byte string."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from strikelake.llm import queries as Q
from strikelake.llm.repeats import Repeats, anchors, common, maximal_groups, prefix_intervals, without_repeats

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    texts = [(t or "").encode() for t in texts]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found_rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_query_against_every_string(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(((d, *w) for (d, _), w in zip(docs, plain([t for _, t in docs], 200))), key=repr)
    assert found_rows(Q.op13_repeat_removal(spark, SF)) == want
    assert sum(w[2] for w in want) > 0


def patchwork(seed, n=60, alphabet="ab cé"):
    """Texts put together from shared pieces, with long periodic runs among them."""
    draw = random.Random(seed)
    piece = lambda k: "".join(draw.choices(alphabet, k=k))
    shared = [piece(draw.randrange(5, 90)) for _ in range(12)] + ["a" * 70, "ab" * 50, "", piece(150)]
    return ["".join(draw.choice(shared) if draw.random() < 0.6 else piece(draw.randrange(30)) for _ in range(draw.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("seed, length, gram, most", [(1, 20, 6, 2000), (2, 12, 5, 3), (3, 25, 25, 2), (4, 20, 1, 2000), (5, 30, 8, 2)])
def test_patchwork_against_every_string(spark, seed, length, gram, most):
    texts = patchwork(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(((d, *w) for d, w in enumerate(plain(texts, length))), key=repr)
    assert found_rows(without_repeats(docs, length, gram, most)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows = [(d, t) for d, t in rows if t is None or len(t) < 100_000]
    docs = odd_docs.where("text is null or length(text) < 100000")
    want = sorted(((d, *w) for (d, _), w in zip(rows, plain([t for _, t in rows], 20))), key=repr)
    assert found_rows(without_repeats(docs, 20, 6)) == want
    assert without_repeats(no_docs).count() == 0
    # A very long text that repeats itself, over more than one block of windows.
    assert any(r.n_removed > 250_000 for r in without_repeats(odd_docs).collect())


def test_blocks_of_a_long_text():
    text = "".join(patchwork(7, 40)).encode()
    for block in (50, 1 << 20):
        found = anchors(text, 20, 6, block)
        assert [w for f, l, *_ in found.tolist() for w in range(f, l + 1)] == list(range(len(text) - 19))
        assert all(l <= p <= f + 14 for f, l, p, _ in found.tolist())
    same = anchors(text + text, 20, 6)
    at = defaultdict(set)
    for first, last, place, _ in same.tolist():
        for w in range(first, last + 1):
            at[(text + text)[w : w + 20]].add(place - w)
    assert max(map(len, at.values())) == 1


def test_groups_are_the_maximal_repeats():
    draw = random.Random(5)
    for _ in range(200):
        pairs = sorted({("".join(draw.choices("ab", k=draw.randrange(6))), "".join(draw.choices("ab", k=draw.randrange(6)))) for _ in range(9)}, key=lambda p: p[1])
        before, behind = [a.encode() for a, _ in pairs], [b.encode() for _, b in pairs]
        want = set()
        for i in range(len(pairs)):
            for j in range(i):
                left, right = common(before[i], before[j]), common(behind[i], behind[j])
                if left + right >= 3:
                    mine = [k for k in range(len(pairs)) if common(before[k], before[i]) >= left and common(behind[k], behind[i]) >= right]
                    want.add((left, right, tuple(mine)))
        got = [(left, right, tuple(sorted(group))) for left, right, group in maximal_groups(before, behind, 3)]
        assert len(got) == len(set(got)) and set(got) == want


def test_intervals():
    assert list(prefix_intervals([2, 2, 1, 3])) == [(2, 0, 2), (3, 3, 4), (1, 0, 4)]
    assert list(prefix_intervals([])) == []


def test_occurrences(spark):
    texts = patchwork(9, 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = Repeats(docs, 20, 6, 5).occurrences().collect()
    by_key = {hashlib.md5(t.encode()).digest(): t.encode() for t in texts}
    strings, places = defaultdict(set), defaultdict(set)
    for r in rows:
        strings[r["repeat"]].add(by_key[bytes(r.text_key)][r.start : r.start + r.n_bytes])
        places[r["repeat"]].add((bytes(r.text_key), r.start))
    assert all(len(s) == 1 and len(next(iter(s))) >= 20 for s in strings.values())
    copies = Counter(texts)
    for name, found in places.items():
        assert len(found) > 1 or copies[by_key[next(iter(found))[0]].decode()] > 1
