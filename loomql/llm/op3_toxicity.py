"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed lexicon and of one induced from labelled rows (words and word
beginnings), closeness of their hits to words of the second person, capitals, punctuation, digits, disguised words
(digits or symbols inside a word, spaced letters) and lengths.  Neither labels nor lang, source or doc_id enter a score.

Training uses at most ``MOST_TRAINING`` labelled rows (those of least hash), none of the held-out fold
(crc32 of the doc_id as text divisible by 5), and the texts of ``PRIOR`` with small weights, so that there are always both
classes and one law holds at any number of labels, none included.  The rows are cross-fitted in ``FOLDS`` folds, each class
dealt out evenly by hash: a row's features use the lexicon induced from the other folds, and the calibration
uses margins of trees grown on the other folds; the model that scores has the lexicon and trees of all of
them.  Only the induced terms and the numeric features of these rows come to the driver, both bounded by
``MOST_TRAINING``.  Every text is scored whole, in small Arrow batches.

Defined cases: a null text is an empty one; a very long text is scored whole, by itself; a null doc_id counts as held
out; several labels of a doc_id count as their greatest; without labels the prior texts alone make the model; repeated
rows all stay; an empty table gives none; other columns are ignored by ``score_documents`` and kept by
``without_toxic``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomql.llm import boosting
from loomql.llm.batches import bound_batches, release
from loomql.llm.text import whole
from loomql.plans.scratch import cut

MOST_TRAINING = 20_000
FOLDS = 4
STEM = 4
NEAR = 5

#: Insults in four languages.
INSULTS = frozenset("""
idiot idiots moron morons stupid dumb fool scum trash garbage loser losers pathetic worthless disgusting clown jerk
imbecile dimwit bastard filth vermin freak creep coward liar pig ugly hate
blöd blöde blödmann dumm dummkopf trottel arschloch abschaum versager widerlich erbärmlich wertlos schwein feigling müll
imbécile crétin abruti débile salaud ordure minable dégoûtant pathétique connard raté clochard honte
idiota imbécil estúpido estúpida tonto tonta basura escoria perdedor patético asqueroso inútil payaso cerdo cobarde
""".split())
#: Words of the second person.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vuestro".split())
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")

#: Fixed values: (text, toxic, weight) that every model has seen: plain insults, and plain sentences in the four languages.
PRIOR = [(f"{who} {a} {b}", 1, 1.0) for who, a, b in (
    ("you are an", "idiot", "and a loser"), ("shut up you", "worthless", "scum"), ("you stupid", "moron", "go away"), ("what a", "pathetic", "clown you are"),
    ("du", "dummkopf", "halt den mund"), ("ihr seid", "abschaum", "und versager"), ("tu es un", "imbécile", "pathétique"), ("espèce de", "connard", "minable"),
    ("eres un", "idiota", "y un perdedor"), ("qué", "asqueroso", "payaso"),
)] + [(text, 0, 2.0) for text in (
    "", "yes", "thank you for your letter of last week", "the river runs past the old mill and the market", "In 2019, the committee met twice; see page 14.",
    "wir danken ihnen für ihren brief", "der fluss fließt an der alten mühle vorbei", "nous vous remercions de votre lettre", "la rivière passe devant le vieux moulin",
    "les agradecemos su carta", "el río pasa junto al viejo molino", "do you know how to open this file? Please tell us!", "THE ANNUAL REPORT 2021",
)]

_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!|*][0-9@$!|*\w]*[^\W\d_]")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-]){3,}[^\W\d_]\b")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_REPEAT = re.compile(r"[!?.]{2,}")
_ASCII_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_DIGITS = bytes(set(range(256)) - set(range(48, 58)))
_PUNCT = bytes(set(range(256)) - set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
N_FEATURES = 20


@dataclass
class Lexicon:
    """Induced terms with their log odds: whole words and beginnings of ``STEM`` letters."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, ``N_FEATURES`` of them."""
    tokens = _WORD.findall(text.lower())
    n, raw = max(1, len(tokens)), text.encode()
    size = max(1, len(raw))
    words, stems = lexicon.words, lexicon.stems
    seed = [] if INSULTS.isdisjoint(tokens) else [i for i, w in enumerate(tokens) if w in INSULTS]
    hits = [i for i, w in enumerate(tokens) if w in words or w[:STEM] in stems] if words or stems else []
    odds = [max(words.get(tokens[i], 0.0), stems.get(tokens[i][:STEM], 0.0)) for i in hits]
    you = [] if YOU.isdisjoint(tokens) else [i for i, w in enumerate(tokens) if w in YOU]
    marked = sorted({*seed, *hits})
    close, nearest = 0, 0.0
    if you and marked:
        at = np.searchsorted(you, marked)
        before = np.where(at > 0, np.asarray(marked) - np.asarray(you)[np.maximum(at - 1, 0)], 1 << 30)
        after = np.where(at < len(you), np.asarray(you)[np.minimum(at, len(you) - 1)] - np.asarray(marked), 1 << 30)
        gap = np.minimum(before, after)
        close, nearest = int((gap <= NEAR).sum()), 1 / (1 + float(gap.min()))
    mixed = _MIXED.findall(text)
    plain = [x.lower().translate(DISGUISE) for x in mixed]
    disguised = sum(x in INSULTS or x in words for x in plain) + sum("".join(c for c in x.lower() if c.isalpha()) in INSULTS for x in _SPACED.findall(text))
    return [
        len(seed) / n, np.log1p(len(seed)), len(hits) / n, np.log1p(len(hits)), sum(odds) / n, max(odds, default=0.0), len(marked) / n,
        len(you) / n, close / n, nearest,
        len(raw.translate(None, _ASCII_UPPER)) / size, len(_SHOUT.findall(text)) / n,
        text.count("!") / size, text.count("?") / size, len(raw.translate(None, _PUNCT)) / size, len(_REPEAT.findall(text)) / n, len(raw.translate(None, _DIGITS)) / size,
        (len(mixed) + disguised) / n, np.log1p(len(tokens)), len(text) / n,
    ]


def feature_matrix(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    return np.array([features(t, lexicon) for t in texts], dtype=np.float64).reshape(len(texts), N_FEATURES)


@dataclass
class Model:
    """Lexicon, trees and calibration."""

    lexicon: Lexicon
    trees: boosting.Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str]) -> np.ndarray:
        x = feature_matrix(texts, self.lexicon)
        if not len(x):
            return np.empty(0)
        margin = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-margin))
        # the steps of the calibration keep a trace of the margin, so that ranks survive
        return np.clip(0.99 * np.interp(margin, *self.knots) + 0.01 * raw, 0, 1)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def _induce(rows: DataFrame) -> list[Lexicon]:
    """Terms over-represented in toxic texts, by the z-value of their smoothed log odds (document counts).

    One lexicon without each fold, then the one of all folds.
    """
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    stems = F.array_distinct(F.transform(F.filter(tokens, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*"))))
    terms = F.explode(F.concat(F.filter(tokens, lambda w: F.length(w) > 1), stems)).alias("term")
    by_fold = [x for k in range(FOLDS) for x in (F.sum(F.when(F.col("fold") == k, F.col("toxic")).otherwise(0)).alias(f"a{k}"), F.sum(F.when(F.col("fold") == k, 1 - F.col("toxic")).otherwise(0)).alias(f"b{k}"))]
    total = np.array([int(x or 0) for x in rows.agg(*by_fold).first()]).reshape(FOLDS, 2)
    counted = rows.select("toxic", "fold", terms).groupBy("term").agg(*by_fold)
    a, b = (sum(F.col(f"{c}{k}") for k in range(FOLDS)) for c in "ab")
    odds = F.log((a + 0.5) / (total[:, 0].sum() + 1.0)) - F.log((b + 0.5) / (total[:, 1].sum() + 1.0))
    top = counted.where(a >= 3).withColumn("z", odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).where((odds > 2) & (F.col("z") > 2.3)).orderBy(F.desc("z"), "term").collect()
    counts = np.array([r[1 : 1 + 2 * FOLDS] for r in top], dtype=float).reshape(len(top), FOLDS, 2)
    out = []
    for left_out in [*range(FOLDS), None]:
        use = [k for k in range(FOLDS) if k != left_out]
        n, c = total[use].sum(axis=0), counts[:, use].sum(axis=1)
        lexicon = Lexicon()
        if n.all():
            value = np.log((c[:, 0] + 0.5) / (n[0] + 1)) - np.log((c[:, 1] + 0.5) / (n[1] + 1))
            strong = (c[:, 0] >= 2) & (value > 2)
            for r, v in ((r, float(v)) for r, v, ok in zip(top, value, strong) if ok):
                (lexicon.stems if r.term.endswith("*") else lexicon.words)[r.term.rstrip("*")] = v
        out.append(lexicon)
    return out


def _feature_batches(lexicons: list[Lexicon]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            x = [features(t, lexicons[k]) for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["fold", "toxic", "x"])

    return work


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Model:
    """Fit lexicon, trees and calibration on at most ``most`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out("doc_id"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a top-k of (id, label)
    # a window over these few rows: each class is dealt to the folds in turn
    dealt = (F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit("fold"), F.col("doc_id")), "doc_id")) - 1) % FOLDS
    chosen = chosen.withColumn("fold", dealt.cast("int"))
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    rows = cut(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text")).select("fold", "toxic", "text"))
    lexicons = _induce(rows)
    data = rows.mapInArrow(_feature_batches(lexicons), "fold int, toxic int, x array<double>").toArrow()
    folds, y = data.column("fold").to_numpy(), data.column("toxic").to_numpy().astype(float)
    x = np.array(data.column("x").to_pylist(), dtype=float).reshape(len(y), N_FEATURES)
    order = np.lexsort((*x.T, y, folds))  # the same trees whatever order the rows come in
    x, y, folds = x[order], y[order], folds[order]
    prior_y, prior_w = (np.array([p[k] for p in PRIOR], dtype=float) for k in (1, 2))

    def fitted(use: np.ndarray, lexicon: Lexicon) -> tuple[boosting.Boosted, np.ndarray]:
        """(trees of some rows and the prior texts, the features of these)."""
        prior = feature_matrix([t for t, _, _ in PRIOR], lexicon)
        return boosting.fit(np.r_[x[use], prior], np.r_[y[use], prior_y], np.r_[np.ones(int(use.sum())), prior_w]), prior

    margin = np.empty(len(y))
    for k in range(FOLDS):
        if (folds == k).any():
            margin[folds == k] = fitted(folds != k, lexicons[k])[0].margin(x[folds == k])
    trees, prior = fitted(np.ones(len(y), bool), lexicons[-1])
    margin, y, weight = np.r_[margin, trees.margin(prior)], np.r_[y, prior_y], np.r_[np.ones(len(y)), prior_w]
    order = np.lexsort((y, margin))
    return Model(lexicons[-1], trees, boosting.isotonic(margin[order], y[order], weight[order]))


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            yield pd.Series(model.score([t or "" for t in texts]))

    return score(text.cast("string"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score_column(model, F.col("text")).alias("s"))
    return rows.where("s < 0.5").select("row.*")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, train(docs, labels))
