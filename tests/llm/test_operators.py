"""The training-data operators on small tables against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strikelake.llm import queries as Q
from strikelake.llm import search, simhash
from strikelake.llm.calibration import calibrated, calibrated_column
from strikelake.llm.codes import Codes, pack, read_documents, tokens_at, write_tokens
from strikelake.llm.decontaminate import build_index, contamination, proximity_matches, uncontaminated
from strikelake.llm.encode import Encoder, blocks_of
from strikelake.llm.licenses import TEMPLATES, scan_licenses, template_matches
from strikelake.llm.mixing import mix, mixed_documents
from strikelake.llm.quality import quality_scores
from strikelake.llm.search import top_k
from strikelake.llm.shards import interleaved_shards
from strikelake.llm.token_counts import attribute, field_tokens, section_tokens
from strikelake.llm.toxicity import not_toxic, toxicity_scores

from .conftest import DOCS, ODD

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


PLAIN = Tokenizer.from_file(Q.TOKENIZER)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


# --- encoding and token codes


@pytest.mark.parametrize("size", [3, 500_000])
def test_pieces_encode_like_whole_texts(monkeypatch, size):
    monkeypatch.setattr("strikelake.llm.encode.blocks_of", lambda text: blocks_of(text, size))
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 60").fetchall()] + ODD
    coder = Encoder.of(Q.TOKENIZER)
    for text in texts:
        whole = PLAIN.encode(text or "", add_special_tokens=False)
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == whole.ids
        assert coder.spans(text).tolist() == [list(o) for o in whole.offsets]


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_codes_round_trip(n, bits):
    random = np.random.default_rng(n)
    ids = (random.integers(0, 2**32, n) >> random.integers(0, 32, n)).astype("<u4")
    codes = Codes(pack(ids, bits))
    assert codes.slice(0, n).tolist() == ids.tolist() == [codes.at(i) for i in range(n)]
    for a, b in random.integers(0, n + 1, (20, 2)).tolist():
        assert codes.slice(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()


def test_token_codes_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    write_tokens(odd_docs, f"{tmp_path}/t", Q.TOKENIZER, segment_tokens=100)
    rows = rows_of(read_documents(spark, f"{tmp_path}/t"))
    want = Counter((r.doc_id, tuple(plain_ids(r.text) + [0])) for r in odd_docs.collect())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    rows.sort(key=lambda r: r["start"])
    names = [r["doc_id"] for r in rows]
    assert names == sorted(names, key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]
    every = [t for r in rows for t in np.frombuffer(r["ids"], "<u4").tolist()]
    asked = [0, 5, 99, 100, 101, len(every) - 1, len(every), -1]
    found = tokens_at(spark, f"{tmp_path}/t", spark.createDataFrame([(p,) for p in asked], "position long"), bucket=64)
    assert {r.position: r.token for r in found.collect()} == {p: every[p] for p in asked if 0 <= p < len(every)}
    write_tokens(no_docs, f"{tmp_path}/none", Q.TOKENIZER)
    assert read_documents(spark, f"{tmp_path}/none").count() == 0


# --- shards and mixing


def test_shards(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(odd_docs.select("doc_id", "text", "source"))
    rows = rows_of(interleaved_shards(docs, shards=3))
    again = rows_of(interleaved_shards(docs.repartition(5), shards=3))
    assert Counter(tuple(r.items()) for r in rows) == Counter(tuple(r.items()) for r in again)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(3)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    per = Counter((r["source"], r["shard"]) for r in rows)
    for source in {r["source"] for r in rows}:
        assert max(per[source, s] for s in range(3)) - min(per[source, s] for s in range(3)) <= 2
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    assert interleaved_shards(no_docs).count() == 0


def poured(total, sizes, weights):
    """Targets by sharing the excess again and again."""
    target, stopped = dict.fromkeys(sizes, 0.0), set()
    while True:
        free = [s for s in sizes if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        for s in free:
            target[s] = left * weights[s] / sum(weights[f] for f in free)
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in stopped else target[s] for s in sizes}
        stopped |= set(over)


def test_shards_against_sql(spark):
    """Every column of the query but the crc32, which DuckDB does not know, and the crc32 against zlib."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = Q.op2_interleaved_shards(spark, SF).collect()
    want = con.execute(Q.SHARDS_SQL).fetchall()
    assert sorted((r.doc_id, r.size, r.law, r.shard, r.slot) for r in got) == sorted(want)
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.grown_shard is None for r in got)


def test_mix(spark, odd_docs, no_docs):
    extra = odd_docs.select("doc_id", "text", "source")
    few = spark.createDataFrame([(900 + i, "w " * i, "0first") for i in range(4)], "doc_id long, text string, source string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(few).unionByName(extra.where("doc_id <> 5 or doc_id is null"))
    rows = rows_of(mix(docs))
    assert len(rows) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = poured(sum(sizes.values()), sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 or r["size"] == 0
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], 2 * r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert Counter(tuple(r.items()) for r in rows) == Counter(tuple(r.items()) for r in rows_of(mix(docs.repartition(7))))
    out = mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    copies = Counter()
    for r in mix(odd_docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +copies
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


# --- licences and decontamination

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_licences(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows_of(scan_licenses(odd_docs))}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"], got[1]["score"]) == (2, 3, 6, "reserved", 1.0)
    assert (got[6]["n_base"], got[6]["base_labels"], got[6]["labels"], got[6]["score"]) == (0, "", "apache-2.0", 1.0)
    assert (got[7]["n_base"], got[7]["first_word"], got[7]["last_word"]) == (2, 2, 6)
    assert (got[2]["n_words"], got[2]["first_word"], got[2]["score"]) == (0, None, 0.0)
    assert got[5]["n_words"] == 60_014
    assert scan_licenses(odd_docs).count() == odd_docs.count()
    assert scan_licenses(no_docs).count() == 0


def plain_shares(text, template):
    t, w = words(template), words(text)
    blocks = [w[i : i + len(t)] for i in range(max(0, len(w) - len(t)) + 1)]
    return max(len(set(t) & set(b)) / len(set(t)) for b in blocks)


def test_template_join_is_exact(spark):
    random = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(14)]
    templates = {f"t{i}": [" ".join(random.choice(vocabulary, 3 + i))] for i in range(6)}
    docs = [(i, "\n".join(" ".join(random.choice(vocabulary, int(random.integers(1, 12)))) for _ in range(4))) for i in range(60)]
    docs += [(60, "w1"), (61, ""), (62, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        want = {}
        for i, text in docs:
            for label, (t,) in templates.items():
                if (share := plain_shares(text, t)) >= threshold - 1e-9:
                    want[i, label] = round(share, 9)
        found, spans = {}, {r.doc_id: words(r.text) for r in df.collect()}
        for r in template_matches(df, templates, threshold).collect():
            t = words(templates[r.label][0])
            block = spans[r.doc_id][r.start : r.start + len(t)]
            assert round(len(set(block) & set(t)) / len(set(t)), 9) == round(r.containment, 9)
            found[r.doc_id, r.label] = max(found.get((r.doc_id, r.label), 0), round(r.containment, 9))
        assert found == want


def test_wrapped_and_long_licences(spark):
    grant = TEMPLATES["mit"][1]
    lines = grant.split()
    wrapped = "\n".join(" ".join(lines[i : i + 7]) for i in range(0, len(lines), 7))
    long = " ".join(f"term{i}" for i in range(200))
    whole = {"mit": TEMPLATES["mit"][2], "bsd": TEMPLATES["bsd"][1], "isc": TEMPLATES["isc"][0]}
    texts = [wrapped, f"before it {long} and after", *[f"Copyright someone\n\n{t}\nint main() {{}}" for t in whole.values()], "mit " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs).collect()}
    assert got == {0: ("mit", 1.0), 1: ("", 0.0), **{2 + k: (label, 1.0) for k, label in enumerate(whole)}, 5: ("", 0.0)}
    assert [(r.doc_id, r.start, r.containment) for r in template_matches(docs, {"long": [long]}, 1.0).collect()] == [(1, 2, 1.0)]


def plain_contamination(docs, items, window=13):
    spans = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1)) if w else []:
            spans[tuple(w[s : s + window])].add(item)
    out = Counter()
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for n in {len(s) for s in spans}:
            for i in range(len(w) - n + 1):
                if (found := spans.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    met |= found
        ids = sorted(str(m) for m in met if m is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out[doc, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_contamination(spark, odd_docs, no_docs):
    random = np.random.default_rng(8)
    few = ["a", "b", "c"]
    items = [(i, " ".join(random.choice(few if i % 2 else [f"x{j}" for j in range(40)], int(random.integers(1, 30))))) for i in range(12)]
    items += [(None, "null id item " + "z " * 12), (20, None), (21, ""), (3, "twice by id"), (22, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs += [(100 + i, " ".join(random.choice(few, 60)) + ". " + (items[i % 12][1] or "") + " tail") for i in range(30)]
    docs += [(200, "null id item " + "z " * 12), (201, "Twice, by ID!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    rows = contamination(d, b).drop("text_hash").collect()
    assert Counter(tuple(r) for r in rows) == plain_contamination(docs, items)
    kept = uncontaminated(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(not r.contaminated for r in rows)
    assert contamination(no_docs, b).count() == 0
    assert not any(r.contaminated for r in contamination(odd_docs, b.limit(0)).collect())


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu"
    moved = item.replace("delta", "delta extra")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"x {moved} y"), (3, "alpha far nu")], "doc_id long, text string")
    index = build_index(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r.doc_id for r in proximity_matches(index, 0).collect()} >= {1}
    assert {r.doc_id for r in proximity_matches(index, 2).collect()} == {1, 2}


# --- near duplicates


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, most):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("most", [1, 2])
def test_links_join_exactly_the_close(spark, most):
    random = np.random.default_rng(most)
    prints = {int(p) for p in random.integers(0, 2**63, 40)}
    for p in list(prints)[:12]:
        q = p
        for _ in range(30):
            for b in random.integers(0, 64, int(random.integers(1, 4))):
                q ^= 1 << int(b)
            prints.add(q)
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    rooted = {r.node: r.root for r in simhash.classes(df, most).collect()}
    groups = plain_classes(prints, most)
    assert len({rooted.get(s, s) for s in signed}) == len(set(groups))
    for s, g in zip(signed, groups):
        assert rooted.get(s, s) == min(x for x, h in zip(signed, groups) if h == g)


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 40
    copies = [(300 + i, base + " tail" * i) for i in range(6)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    groups = plain_classes(prints, 2)
    least = {g: min((r.doc_id for r, h in zip(rows, groups) if h == g and r.doc_id is not None), default=None) for g in set(groups)}
    want = Counter((r.doc_id, p - 2**64 if p >> 63 else p, least[g]) for r, p, g in zip(rows, prints, groups))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    own = [plain_fingerprint(r.text) for r in odd_docs.collect()]
    assert kept.count() == len(set(plain_classes(own, 2)))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


# --- token counts


@pytest.mark.parametrize("rule", ["start", "end", "most", "share"])
def test_section_tokens(odd_docs, no_docs, rule):
    rows = rows_of(section_tokens(odd_docs, Q.TOKENIZER, Q.SENTENCE_END, rule))
    want, got = Counter(), Counter()
    for r in odd_docs.collect():
        want[r.doc_id] += len(plain_ids(r.text))
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    assert {k: round(v, 6) for k, v in got.items()} == dict(want)
    assert section_tokens(no_docs, Q.TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        section_tokens(odd_docs, Q.TOKENIZER, rule="none")


def test_attribution_against_a_loop():
    random = np.random.default_rng(2)
    for _ in range(50):
        ends = np.unique(random.integers(1, 60, 6))
        sections = np.stack([np.concatenate(([0], ends[:-1])), ends], axis=1)
        cuts = np.unique(np.concatenate(([0, ends[-1]], random.integers(0, ends[-1], 9))))
        spans = np.stack([cuts[:-1], cuts[1:]], axis=1)
        held = np.array([[max(0, min(e, b) - max(s, a)) for a, b in sections] for s, e in spans])
        for rule in ("start", "end", "most", "share"):
            want = np.zeros(len(sections))
            for row in held:
                inside = np.flatnonzero(row)
                if rule == "share":
                    want += row / row.sum()
                else:
                    want[{"start": inside[0], "end": inside[-1], "most": np.argmax(row)}[rule]] += 1
            counts, crossing = attribute(spans, sections, rule)
            assert counts == pytest.approx(want)
            assert crossing.tolist() == [int(sum((h > 0).sum() > 1 and h[k] > 0 for h in held)) for k in range(len(sections))]


def test_field_tokens(spark):
    df = spark.createDataFrame([(1, "Title", None, "Body text.")], "doc_id long, title string, note string, body string")
    rows = field_tokens(df, ["title", "note", "body"], Q.TOKENIZER).collect()
    assert [r.field for r in rows] == ["title", "note", "body"]
    assert sum(r.n_tokens for r in rows) == len(plain_ids("Title\n\nBody text."))


# --- search


def test_vectors_are_cleaned_and_grouped_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    best = top_k(df, F.col("vec_id") % 10 == 0, scale=1, query_block=4, row_block=16)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" not in plan and "array<double>" not in plan

    def of(q):
        scores = sorted((-sum(int(a * b) for a, b in zip(rows[q][1], x)), i) for i, x in rows if i != q)
        return [(q, place + 1, i, -less) for place, (less, i) in enumerate(scores[:5])]

    want = [r for q in range(0, 60, 10) for r in of(q)]
    for batch in (1, 2, 128):
        monkeypatch.setattr(search, "BATCH", batch)
        assert sorted(map(tuple, best.collect())) == want


def test_top_k(spark):
    random = np.random.default_rng(6)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(random.normal(0, 0.2, (300, 20)))]
    vectors += [(400 + i, vectors[5][1]) for i in range(8)]
    vectors += [(500, None), (501, []), (502, [None] * 20), (503, [float("nan")] * 20), (504, [float("inf")] * 20), (None, vectors[0][1])]
    vectors += [(0, vectors[0][1]), (510, [1.0, 2.0]), (511, [3.0, -1.0]), (520, [0.0] * 20), (550, [1e30] * 20), (551, [-1e30] * 20)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    clean = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in clean if i % 10 == 0):
        scored = [(sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q and len(v) == len(clean[q])]
        scored = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for s, i in scored)
        for rank, (s, i) in enumerate(scored[:5], 1):
            want[q, rank] = (i, -s)
    got = top_k(df, F.col("vec_id") % 10 == 0, query_block=16, row_block=50).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    assert top_k(df.limit(0), F.lit(True)).count() == 0


# --- classifiers


@pytest.mark.parametrize("score, label, folds, out", [(toxicity_scores, "toxic", 5, 0), (quality_scores, "quality", 3, 1)])
def test_classifiers_hold_out(spark, odd_docs, no_docs, score, label, folds, out):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out, 1 - F.col(label)).otherwise(F.col(label)))
    got = {r.doc_id: r.score for r in score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    assert got == {r.doc_id: r.score for r in score(docs, flipped).collect()}
    held = [(got[r.doc_id], r[label]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % folds == out]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) >= 0.85
    assert score(odd_docs, labels).count() == odd_docs.count()
    assert score(no_docs, labels.limit(0)).count() == 0


def test_calibration_as_expression(spark):
    raw = [-0.5, 0.0, 0.05, 0.1, 0.3, 0.300001, 0.9, 1.0, 2.0]
    for curve in (([0.1, 0.3, 0.9], [0.0, 0.25, 1.0]), ([0.4], [0.7]), ([0.0, 1.0], [0.2, 0.2])):
        curve = tuple(np.array(c) for c in curve)
        rows = spark.createDataFrame([(v,) for v in raw], "raw double")
        found = [r[0] for r in rows.select(calibrated_column(F.col("raw"), curve)).collect()]
        assert np.allclose(found, calibrated(np.array(raw), curve), rtol=0, atol=1e-12)


def test_not_toxic_keeps_columns(spark, odd_docs, no_docs):
    insult = [(i, f"you are a worthless idiot and a moron {i}" if i % 2 else f"a calm sentence about number {i}") for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "x", "y", "z", "s") for i, t in insult], DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    kept = not_toxic(docs.unionByName(odd_docs.where("doc_id is null")), labels)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(0, 400, 2))
    assert not_toxic(no_docs, labels).count() == 0


# --- registered queries with SQL


@pytest.mark.parametrize("name", [n for n, (_, sql) in Q.ENTRIES.items() if sql])
def test_queries_against_sql(spark, name):
    query, sql = Q.ENTRIES[name]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    df = query(spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(found.fetchall())
