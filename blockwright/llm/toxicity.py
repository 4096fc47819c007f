"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels teach two things: a lexicon of words and word beginnings that stand mostly in
toxic texts, and the trees. Both are learned from a bounded sample of labelled rows
(sample_rows), cut into folds: the trees and the calibration see features of a row by the
words that other folds teach, as they will be for rows without a label. Scoring passes over
all texts once, without a shuffle, with the words of the whole sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm.common import lean

#: Most labelled rows that the lexicon and the trees are fitted on.
SAMPLE_ROWS = 20_000
#: Most lexicon entries; bounds what travels to the tasks.
LEXICON = 4_000
#: Folds of the sample: features of labelled rows are made with the words of the other folds; the last fold calibrates.
FOLDS = 4
STEM = 5
# Second-person words of four languages, punctuation marks, and letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta tus ti usted ustedes vosotros".encode().split())
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STANDS_FOR = bytes.maketrans(b"013457@$!|", b"oieastasil")
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
SPLIT = bytes(c + 32 if 65 <= c <= 90 else 32 if c in MARKS else c for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
OBSCURED = re.compile(rb"(?<![a-z])[a-z]++[0-9@$!|*]+[a-z@$!|*0-9]*")  # from the start of a run of letters only, so long runs are passed once
SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")
STRETCHED = re.compile(rb"([a-z])\1\1")
FEATURES = ("words", "lexicon", "lexicon_density", "stems", "stem_density", "you_density", "nearness", "capitals", "shouted", "marks", "exclaims", "obscured", "obscured_lexicon", "stretched", "variety")
#: Of splits that part the rows equally well, what toxic words say goes before what length, marks and capitals say.
EVIDENCE = ("lexicon", "lexicon_density", "stems", "stem_density", "obscured_lexicon", "nearness", "you_density")
TRIED = [FEATURES.index(n) for n in EVIDENCE] + [f for f, n in enumerate(FEATURES) if n not in EVIDENCE]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(SPLIT).split()


def describe(text: str | None, lexicon: frozenset[bytes], stems: frozenset[bytes]) -> list[float]:
    """Dense features of one text, in the order of FEATURES; all zero for an empty text."""
    raw = (text or "").encode()
    words = raw.translate(SPLIT).split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(FEATURES)
    kinds = set(words)
    hit, hit_stems = kinds & lexicon, {w for w in kinds if w[:STEM] in stems and len(w) > STEM}
    at = [i for i, w in enumerate(words) if w in hit] if hit else []
    begun = sum(w in hit_stems for w in words) if hit_stems else 0
    you = kinds & SECOND_PERSON
    near = 0.0
    if you and (at or begun):
        spots = np.array([i for i, w in enumerate(words) if w in you])
        own = np.array(at or [i for i, w in enumerate(words) if w in hit_stems])
        j = np.searchsorted(spots, own)
        gap = np.minimum(np.abs(own - spots[np.minimum(j, len(spots) - 1)]), np.abs(own - spots[np.maximum(j - 1, 0)]))
        near = float(np.mean(1 / (1 + gap)))
    low = raw.translate(LOWER)
    hidden = OBSCURED.findall(low)
    plain = {w.translate(STANDS_FOR, b"*") for w in hidden} if hidden else set()
    letters = max(1, size - len(raw.translate(None, LETTERS)))
    return [
        float(np.log1p(n)), float(np.log1p(len(at))), len(at) / n, float(np.log1p(begun)), begun / n,
        sum(w in you for w in words) / n if you else 0.0, near,
        (len(raw) - len(raw.translate(None, CAPITALS))) / letters, len(SHOUTED.findall(raw)) / n,
        (len(raw) - len(raw.translate(None, MARKS))) / size, raw.count(b"!") / n, len(hidden) / n,
        float(len(plain & lexicon)), len(STRETCHED.findall(low)) / n, len(kinds) / n,
    ]


@dataclass
class Boosted:
    """Trees of equal depth as arrays: a node's feature and cut, a leaf's value; then the calibration's steps."""

    depth: int
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if not len(self.steps):
            return 1 / (1 + np.exp(-m))
        return np.interp(m, self.steps, self.values)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, tried: list[int] | None = None) -> Boosted:
    """Newton boosting of the logistic loss on binned features. Of equal gains, but for rounding, the feature that is tried first counts (tried: their order)."""
    model = Boosted(depth)
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    model.start = float(np.log(rate_1 / (1 - rate_1)))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(v[v != v.min()] if (v != v.min()).any() else v, np.linspace(0, 1, bins))) for v in x.T]
    cuts = [np.unique(np.r_[v.min(), c])[:-1] if len(np.unique(np.r_[v.min(), c])) > 1 else np.array([v.min()]) for v, c in zip(x.T, cuts)]
    binned = np.stack([np.searchsorted(c, v, side="left") for v, c in zip(x.T, cuts)], 1)
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-9
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local, best = node - first, np.full(width, 1e-6)
            for f in tried or range(len(cuts)):
                c = cuts[f]
                k = len(c) + 1
                cell = local * k + binned[:, f]
                gs = np.bincount(cell, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(cell, h, width * k).reshape(width, k).cumsum(1)
                left, right = gs[:, :-1] ** 2 / (hs[:, :-1] + 1), (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + 1)
                gain = left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                at = gain.argmax(1)
                for j in np.flatnonzero(gain[np.arange(width), at] > best * (1 + 1e-9)):
                    best[j], feature[first + j], cut[first + j] = gain[j, at[j]], f, c[at[j]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        own = node - (2**depth - 1)
        leaf = rate * np.bincount(own, g, 2**depth) / (np.bincount(own, h, 2**depth) + 1)
        margin += leaf[own]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> Boosted:
    """Isotonic regression of the labels on the margins of rows that the trees haven't seen; a block's rate is (1s + 1/2) / (rows + 1)."""
    if not len(y) or y.min() == y.max():
        return model
    m = model.margin(x)
    order = np.argsort(m, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(m[order], y[order]):
        blocks.append([t, 1, v, v])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    values = np.maximum.accumulate([(s + 0.5) / (n + 1) for s, n, _, _ in blocks])
    model.steps = np.array([e for b in blocks for e in (b[2], b[3])])
    model.values = np.repeat(values, 2)
    return model


def learn_lexicons(sample: DataFrame, most: int = LEXICON) -> list[tuple[frozenset[bytes], frozenset[bytes]]]:
    """Words, and beginnings of longer words, that stand in toxic rows at least nine times in ten and eight times at least: of the rows outside each fold (six times there), and at the end of all rows. sample: text, toxic, fold."""

    def terms(batches):
        count: dict[tuple[str, bytes], list[int]] = {}

        def out():
            keys, sums = list(count), np.array(list(count.values()))
            count.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.binary()), *[pa.array(c) for c in sums.T]], ["kind", "term", *names])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text, toxic, fold in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    kinds = set(words_of(text or ""))
                    for key in [("word", w) for w in kinds] + [("stem", s) for s in {w[:STEM] for w in kinds if len(w) > STEM}]:
                        sums = count.setdefault(key, [0] * (2 * FOLDS))
                        sums[fold] += toxic
                        sums[FOLDS + fold] += 1
                if len(count) > 100_000:
                    yield out()
        if count:
            yield out()

    names = [f"{n}_{f}" for n in ("bad", "rows") for f in range(FOLDS)]
    counted = sample.select("text", "toxic", "fold").mapInArrow(lean(terms), "kind string, term binary, " + ", ".join(f"{n} long" for n in names)).groupBy("kind", "term").agg(*[F.sum(n).alias(n) for n in names])
    total = {n: sum((F.col(f"{n}_{f}") for f in range(FOLDS)), F.lit(0)) for n in ("bad", "rows")}
    rules = [((total["bad"] - F.col(f"bad_{f}"), total["rows"] - F.col(f"rows_{f}")), 6) for f in range(FOLDS)] + [((total["bad"], total["rows"]), 8)]
    out = []
    for k, ((bad, rows), least) in enumerate(rules):
        counted = counted.withColumn(f"in_{k}", F.when((bad >= least) & (bad >= 0.9 * rows), bad))
    known = counted.where(F.coalesce(*[F.col(f"in_{k}") for k in range(len(rules))]).isNotNull())
    found = known.orderBy(F.desc(total["bad"]), "kind", "term").limit(2 * most).collect()
    for k in range(len(rules)):
        own = sorted((r for r in found if r[f"in_{k}"] is not None), key=lambda r: (-r[f"in_{k}"], r.kind, bytes(r.term)))[:most]
        out.append((frozenset(bytes(r.term) for r in own if r.kind == "word"), frozenset(bytes(r.term) for r in own if r.kind == "stem")))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, train_if) -> DataFrame:
    """At most sample_rows labelled training rows, chosen by a hash of the id: the same rows each time."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(train_if("label_id")).groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(known), "label_id")  # broadcast: at most sample_rows rows of two numbers
    return found.groupBy("label_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label_id", "text", "toxic")  # one text for a repeated id


def score_toxicity(docs: DataFrame, labels: DataFrame, train_if, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.7, sample_rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score of each row of docs from 0 to 1, and predicted (1 if the score is cut or more).

    train_if: takes the id column's name in labels and gives the condition on which a
    label may be learned from. One row comes out for each row that goes in: null ids and
    repeated rows stay and are scored; a null text counts as an empty one. Labels that are
    null or neither 0 nor 1, and labels of unknown ids, teach nothing; of repeated labels
    the larger counts, and of rows of one id one text. Without labels of both classes, the score is the smoothed rate of
    1 among those there are. Columns named in keep are passed on.
    """
    if {"score", "predicted", id_col} & set(keep):
        raise ValueError("columns of the result can't be kept")
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows, train_if)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "label_id"), F.lit(FOLDS)).cast("int"))
    *without, (lexicon, stems) = learn_lexicons(sample)

    def rows(batches):
        """Features by words that the row itself, and its fold, didn't teach."""
        for b in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            x = [describe(t, *without[f]) for t, f in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], ["id", "toxic", "fold", "x"])

    seen = sorted(sample.mapInArrow(lean(rows), "id string, toxic int, fold int, x array<double>").collect())
    x = np.array([r.x for r in seen]).reshape(-1, len(FEATURES))
    y = np.array([r.toxic for r in seen], float)
    fold = np.array([r.fold for r in seen], int) == FOLDS - 1
    model = calibrate(fit(x[~fold], y[~fold], tried=TRIED), x[fold], y[fold])

    def score(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = model.score(np.array([describe(t, lexicon, stems) for t in part.column(0).to_pylist()]).reshape(-1, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], [*names, "score", "predicted"])

    names = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(F.col(text_col).alias("__text"), *names).mapInArrow(lean(score), f"{kinds}, score double, predicted int")
