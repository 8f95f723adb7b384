"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from .calibration import calibrated_column, isotonic, split
from .shared import labelled_sample

#: Insults and slurs on worth or mind, lower case, without accents of their own.
INSULTS = """
idiot idiots moron morons loser losers scum clown clowns trash garbage stupid dumb dumbass fool
pathetic worthless disgusting useless imbecile cretin jerk bastard bitch asshole bullshit shit
fuck fucking fucker crap damn retard retarded freak creep pig vermin filth filthy hate kill die
dummkopf trottel arschloch scheisse wichser abschaum hurensohn blödmann depp
imbécile connard connasse salaud merde crétin ordure abruti débile
idiota imbécil estúpido estúpida basura mierda cabrón pendejo gilipollas asqueroso inútil patético
""".split()
#: Words that address the reader.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted vosotros".split()

#: Characters written in place of letters.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "|": "i"}
#: Characters put between letters to hide a word.
BETWEEN = "*._-~^`'"

#: Lengths in bytes of the word beginnings that a learnt lexicon holds beside whole words.
BEGINNINGS = (4, 5, 7)

FEATURES = (
    "log_words learnt learnt_count learnt_weight learnt_most learnt_different insults insult_count hidden_insults addressed near_you capitals shouted exclaims questions punctuation "
    "symbols digits_in_words symbols_in_words stretched joined_by_dots"
).split()

_BREAKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_LETTERS = bytearray(_BREAKS)
for _shown, _meant in LOOKS_LIKE.items():
    _LETTERS[ord(_shown)] = ord(_meant)
_LETTERS = bytes(_LETTERS)
_PUNCTUATION, _SYMBOLS, _UPPER = b".,;:!?'\"()-", b"@#$%^&*~|<>_=+\\/", string.ascii_uppercase.encode()
_DIGITS = string.digits.encode()
_NEAR = 5


def words_in(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text, without punctuation."""
    return (text or b"").lower().translate(_BREAKS).split()


def terms_of(word: bytes) -> list[bytes]:
    """The lexicon terms a word can match: itself after an equals sign, and its longer beginnings."""
    return [b"=" + word, *[word[:p] for p in BEGINNINGS if len(word) > p]]


class Lexicon:
    """Words given and learnt. ``weights``: how much likelier toxic texts hold a term (log odds)."""

    def __init__(self, insults: list[str] = INSULTS, second: list[str] = SECOND_PERSON, weights: dict[bytes, float] | None = None):
        self.insults, self.second = (frozenset(w.encode() for w in words) for words in (insults, second))
        self.weights = weights or {}
        self.starts = frozenset(t.removeprefix(b"=")[:4] for t in self.weights)

    def learnt(self, words: list[bytes]) -> list[float]:
        """Share of ``words`` with a learnt term, their number, mean and largest weight, and different ones."""
        starts, weights = self.starts, self.weights
        found = [w for w in words if w[:4] in starts]
        held = {w: max(weights.get(t, 0.0) for t in terms_of(w)) for w in set(found)}
        values = [v for v in map(held.__getitem__, found) if v]
        n = max(1, len(words))
        return [len(values) / n, float(min(len(values), 20)), sum(values) / n, max(values, default=0.0), float(min(sum(map(bool, held.values())), 20))]


def features_of(text: bytes | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one UTF-8 text, in the order of ``FEATURES``; zeros for null and empty text."""
    insults, second = lexicon.insults, lexicon.second
    raw = text or b""
    shown = raw.split()
    if not shown:
        return [0.0] * len(FEATURES)
    n, size = len(shown), len(raw)
    lower = raw.lower()
    words = words_in(raw)
    hits = sum(map(insults.__contains__, words))
    spelled = lower.translate(_LETTERS, BETWEEN.encode()).split()
    hidden = max(0, sum(map(insults.__contains__, spelled)) - hits)
    addressed = sum(map(second.__contains__, words))
    near = 0
    if hits and addressed:
        you = np.array([i for i, w in enumerate(words) if w in second])
        for i in (i for i, w in enumerate(words) if w in insults):
            at = np.searchsorted(you, i)
            near += bool((at < len(you) and you[at] - i <= _NEAR) or (at and i - you[at - 1] <= _NEAR))
    upper = size - len(raw.translate(None, _UPPER))
    odd = [w for w in shown if not w.isalpha()]
    inner = [w.strip(_PUNCTUATION) for w in odd]
    with_digit = sum(any(c in _DIGITS for c in w) and w[:1].isalpha() for w in inner)
    with_symbol = sum(any(c in _SYMBOLS for c in w[1:-1]) and w[:1].isalpha() and w[-1:].isalpha() for w in inner)
    dotted = sum(1 for w in inner if w.count(b".") >= 2)
    stretched = sum(raw.count(c * 3) for c in (b"a", b"e", b"i", b"o", b"u", b"!", b"?"))
    return [
        np.log1p(n), *lexicon.learnt(words), hits / n, float(min(hits, 20)), hidden / n, addressed / n, near / max(1, hits), upper / size,
        sum(map(bytes.isupper, shown)) / n, raw.count(b"!") / n, raw.count(b"?") / n,
        (size - len(raw.translate(None, _PUNCTUATION))) / size, (size - len(raw.translate(None, _SYMBOLS))) / size,
        with_digit / n, with_symbol / n, stretched / n, dotted / n,
    ]


def features_column(text: Column, lexicon: Lexicon) -> Column:
    """Array of ``FEATURES`` of a text column."""

    @pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features_of(t, lexicon) for t in texts], dtype=object)

    return measured(text.cast("string").cast("binary"))


def learn_weights(sample: DataFrame, max_terms: int = 5_000, least: float = 1.5, certain: float = 3.0) -> dict[bytes, float]:
    """Terms that toxic rows of ``sample`` (text, label) hold much more often: log odds by term.

    A term counts if its log odds are ``least`` or more and ``certain`` standard errors above zero;
    the ``max_terms`` most certain ones are kept.
    """

    @pandas_udf("array<binary>")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([list({t for w in set(words_in(x)) for t in terms_of(w)}) for x in texts], dtype=object)

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    rows = sample.select(F.explode(terms(F.col("text").cast("string").cast("binary"))).alias("term"), "label")
    toxic = F.sum("label") + 0.5
    clean = F.count(F.lit(1)) - F.sum("label") + 0.5
    odds = F.log(toxic / (sizes.get(1, 0) + 1)) - F.log(clean / (sizes.get(0, 0) + 1))
    counted = rows.groupBy("term").agg(odds.alias("odds"), (odds / F.sqrt(1 / toxic + 1 / clean)).alias("certain"))
    kept = counted.where((F.col("odds") >= least) & (F.col("certain") >= certain)).orderBy(F.desc("certain"), "term").limit(max_terms)
    return {bytes(r["term"]): float(r["odds"]) for r in kept.collect()}


class ToxicityModel:
    """Boosted trees and their calibration; ``level`` stands for both where labels cannot tell classes apart."""

    def __init__(self, trees, curve, level: float, lexicon: Lexicon):
        self.trees, self.curve, self.level, self.lexicon = trees, curve, level, lexicon

    def add_score(self, rows: DataFrame, text: Column, score: str) -> DataFrame:
        """``rows`` with the column ``score``, 0 to 1. Added columns replace none but ``score``."""
        if self.trees is None:
            return rows.withColumn(score, F.lit(self.level))
        packed = rows.select(F.struct("*").alias("row"), array_to_vector(features_column(text, self.lexicon)).alias("features"))
        judged = self.trees.transform(packed).select("row", vector_to_array("probability")[1].alias("raw"))
        return judged.select("row.*", calibrated_column(F.col("raw"), self.curve).alias(score))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 20_000,
    trees: int = 20, depth: int = 4, seed: int = 3, insults: list[str] = INSULTS, second: list[str] = SECOND_PERSON,
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows of ``docs`` (doc_id, text) outside the held-out fold.

    ``labels`` has doc_id and toxic (0 or 1). A hash of the id splits the sample: two fifths teach the
    lexicon, two fifths the trees, one fifth the isotonic curve, so that each is fitted to rows the
    one before has not seen. With one class only the score is that class, without labels 0.
    """
    known = cut_lineage(labelled_sample(docs, labels, "toxic", folds, held_out, max_rows))
    fitting, calibrating = split(known)
    half = F.pmod(F.xxhash64(F.lit("lexicon"), F.col("doc_id")), F.lit(2)) == 0
    lexicon = Lexicon(insults, second, learn_weights(fitting.where(half)))

    def measured(rows: DataFrame) -> DataFrame:
        vector = array_to_vector(features_column(F.col("text"), lexicon))
        return cut_lineage(rows.select("doc_id", vector.alias("features"), F.col("label").cast("double").alias("label")))

    fitting = measured(fitting.where(~half))
    classes = [r["label"] for r in fitting.select("label").distinct().collect()]
    if len(classes) < 2:
        return ToxicityModel(None, None, classes[0] if classes else 0.0, lexicon)
    boost = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.2, subsamplingRate=0.8, seed=seed, checkpointInterval=-1)
    model = boost.fit(fitting.orderBy("doc_id"))
    curve = isotonic(model.transform(measured(calibrating)).select(vector_to_array("probability")[1].alias("raw"), "label"))
    return ToxicityModel(model, curve, 0.0, lexicon)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """doc_id and calibrated toxicity of every whole text of ``docs`` (doc_id, text).

    Null and empty texts have all features 0 and get the score of that point; repeated rows have a
    score each. Only the text is scored.
    """
    model = train_toxicity(docs, labels, folds, held_out, **options)
    return model.add_score(docs.select("doc_id", "text"), F.col("text"), "score").select("doc_id", "score")


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns. The model learns
    from the labelled rows among ``docs``."""
    model = train_toxicity(docs, labels, **options)
    rows = docs.select(F.struct("*").alias("whole"), F.col("text").alias("text"))
    return model.add_score(rows, F.col("text"), "score").where(F.col("score") < threshold).select("whole.*")
