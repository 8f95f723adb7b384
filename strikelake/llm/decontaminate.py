"""Benchmark decontamination with a positional inverted index of the training words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import words_of

ITEM = ["item_id", "item_text"]
DOC = ["doc_id", "text_hash"]


@dataclass
class PhraseIndex:
    """``windows``: item_id, item_text (hash of the text), start, length, words, anchor (place of the
    rarest word). ``anchors``: item_id, item_text, place, term, first (rarest of a window), need.
    ``postings``: term, doc_id, text_hash, position. ``docs``: the rows they were taken from."""

    windows: DataFrame
    anchors: DataFrame
    postings: DataFrame
    docs: DataFrame


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    met = F.lit(True)
    for name in names:
        met = met & left[name].eqNullSafe(right[name])
    return met


def doc_words(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, words of every row; rows of one id and text have the same key."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))


def build_index(docs: DataFrame, items: DataFrame, window: int = 13, rarest: int = 3) -> PhraseIndex:
    """Index the words of ``docs`` (doc_id, text) that the windows of ``items`` (item_id, text) ask for first.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. The words of
    all documents are counted for the items' vocabulary; the ``rarest`` words of each window are its
    anchors, and only anchors have postings. Postings are narrow: no row carries other words of its text.
    """
    texts = items.select("item_id", F.xxhash64("text").alias("item_text"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    texts = texts.where(n > 0).dropDuplicates(ITEM)
    texts = texts.select("*", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("start"))
    texts = texts.select(*ITEM, "start", F.slice("words", F.col("start") + 1, window).alias("words"))
    windows = cut_lineage(texts)
    terms = windows.select(*ITEM, "start", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
    vocabulary = cut_lineage(terms.select("term").distinct())
    seen = doc_words(docs).select(F.explode("words").alias("term"))
    counts = cut_lineage(seen.join(vocabulary, "term").groupBy("term").count())
    ranked = terms.join(counts, "term").withColumn(
        "rank", F.row_number().over(Window.partitionBy(*ITEM, "start").orderBy("count", "offset"))
    )
    # A window with a word that no document holds occurs nowhere.
    full = Window.partitionBy(*ITEM, "start")
    ranked = ranked.withColumn("found", F.count(F.lit(1)).over(full)).where("found = length")
    chosen = cut_lineage(
        ranked.where(F.col("rank") <= rarest).select(
            *ITEM, "start", (F.col("start") + F.col("offset")).alias("place"), "term", (F.col("rank") == 1).alias("first"), "length"
        )
    )
    anchors = chosen.groupBy(*ITEM, "place", "term").agg(F.max("first").alias("first"))
    need = chosen.groupBy(*ITEM).agg(F.min(F.least(F.col("length"), F.lit(rarest))).alias("need"))
    anchors = anchors.join(need.select(F.struct(*ITEM).alias("of"), "need"), F.struct(*ITEM).eqNullSafe(F.col("of"))).drop("of")
    anchors = cut_lineage(anchors)
    firsts = chosen.where("first").select(F.struct(*ITEM, "start").alias("of"), F.col("place").alias("anchor"))
    windows = windows.join(firsts, F.struct(*ITEM, "start").eqNullSafe(F.col("of"))).drop("of")
    wanted = cut_lineage(anchors.select("term").distinct())
    postings = doc_words(docs).select(*DOC, F.posexplode("words").alias("position", "term")).join(wanted, "term")
    return PhraseIndex(cut_lineage(windows), anchors, cut_lineage(postings), docs)


def aligned(index: PhraseIndex, slack: int = 0) -> DataFrame:
    """Places where the anchors of an item meet in one document, by offset-adjusted intersection.

    Each posting of an anchor, less the anchor's place in the item, is where the item would begin
    (``origin``). Origins that enough different anchors share, a rarest one among them, stay;
    the other anchors may be ``slack`` words off. Returns the keys of document and item, origin and
    ``rare``: the places of the rarest anchors met.
    """
    hits = index.postings.join(index.anchors.withColumnRenamed("first", "leads"), "term")
    origin = F.col("position") - F.col("place")
    if slack:
        off = F.when(F.col("leads"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(-slack), F.lit(slack)))
        hits = hits.withColumn("off", F.explode(off))
        origin = origin + F.col("off")
    rare = F.when(F.col("leads"), F.col("place"))
    met = hits.groupBy(*DOC, *ITEM, origin.alias("origin")).agg(
        F.size(F.collect_set("place")).alias("met"), F.min("need").alias("need"), F.collect_set(rare).alias("rare")
    )
    return met.where((F.col("met") >= F.col("need")) & (F.size("rare") > 0)).select(*DOC, *ITEM, "origin", "rare")


def phrase_matches(index: PhraseIndex) -> DataFrame:
    """Exact occurrences of the items' windows: keys of document and item, start (in the document), length.

    Windows whose anchors align are candidates; only documents with candidates are split again, and
    the words at each candidate's place are compared with the window's.
    """
    met = aligned(index).select("*", F.explode("rare").alias("at"))
    windows, begin = index.windows, F.col("origin") + F.col("start")
    pairs = met.join(windows, _same(met, windows, ITEM) & (F.col("at") == F.col("anchor"))).where(begin >= 0)
    pairs = cut_lineage(pairs.select(F.struct(*DOC).alias("of"), *[met[c] for c in ITEM], begin.alias("begin"), "words").distinct())
    texts = index.docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"), "text")
    texts = texts.join(pairs.select("of").distinct().hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("of")), "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text")).select("key", words_of(F.col("text")).alias("held"))
    placed = pairs.join(texts, F.col("of").eqNullSafe(F.col("key")))
    same = F.slice("held", F.col("begin") + 1, F.size("words")) == F.col("words")
    return placed.where(same).select(
        "of.*", *ITEM, F.col("begin").cast("long").alias("start"), F.size("words").alias("length")
    ).distinct()


def proximity_matches(index: PhraseIndex, slack: int = 3) -> DataFrame:
    """Places where a document holds the rarest words of an item near their order: keys of document
    and item, origin. ``slack`` is how many words each may be moved; phrases with a word put in,
    left out or replaced are found too."""
    return aligned(index, slack).select(*DOC, *ITEM, "origin")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Contaminated words of every row of ``docs`` (doc_id, text), held against ``items`` (item_id, text).

    Returns doc_id, text_hash, n_words, n_hit (words inside any occurrence of a window), n_items
    (items with such windows), items_sha256 (of their ids, sorted as strings and comma-joined) and
    contaminated (n_hit > 0 and share * n_hit >= n_words). Null and empty texts have no words;
    repeated rows have a result each, equal items count once by id; an item without an id makes hits
    but is neither counted nor listed. Other columns are not read.
    """
    matches = cut_lineage(phrase_matches(build_index(docs, items, window)))
    inside = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("position")
    hits = matches.select(*DOC, inside).distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    named = matches.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits, named = (x.select(F.struct(*DOC).alias("of"), *[c for c in x.columns if c not in DOC]) for x in (hits, named))
    found = hits.join(named, "of")
    rows = doc_words(docs).select(*DOC, F.size("words").cast("long").alias("n_words"))
    rows = rows.join(found, F.struct(*DOC).eqNullSafe(F.col("of")), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        *DOC,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """``docs`` with all its columns, without the contaminated rows."""
    bad = contamination(docs, items, window, share).where("contaminated").select(F.struct(*DOC).alias("of")).distinct()
    bad = cut_lineage(bad)
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"))
    return rows.join(bad, F.col("key").eqNullSafe(F.col("of")), "left_anti").select("row.*")


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
x AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + 13], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM x),
o AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, item_id, i, n FROM o JOIN x USING (n, phrase)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
