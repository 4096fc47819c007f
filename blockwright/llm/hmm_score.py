"""A hidden Markov language model over words: trained by Baum-Welch, scored by the scaled forward recursion.

A text is its words in lower case (A-Z) and one end. The most frequent words are symbols
of the model; each other word has the symbol of its ending, and its share among all words
of that symbol, so that the model gives each text an exact probability. Words are counted
over all training texts. Baum-Welch starts from their shares and is incremental: the
training texts are dealt into parts by a hash of their ids and letters. Each step adds up one part's expected counts
inside each partition, sums them across partitions, puts them in the place of that part's
counts of the sweep before, and sets the model by the counts of all parts. So each sweep
passes over all training texts once, and the model moves as often as there are parts.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm.common import ASCII_LOWER, durable, lean

STATES = 8
#: Words that are symbols on their own, and symbols by word ending.
WORDS, ENDINGS = 8192, 512
#: Words whose counts travel to the tasks; those of all others are joined.
HEAD = 60_000
#: Parts of the training texts, and sweeps over all of them.
PARTS, SWEEPS = 8, 3
#: Tokens whose forward values are kept at a time, and texts that step through the recursion together at least.
BLOCK_TOKENS, BLOCK_TEXTS = 400_000, 256
#: Texts that are sorted by length before they are dealt into blocks.
SLICE = 8192
#: Words that a task remembers at a time.
MOST_WORDS = 300_000
SYMBOLS = 1 + WORDS + ENDINGS  # the end is symbol 0
END = 0


def word_hash(word: bytes) -> int:
    """64 bits, signed. The end is no word and has 0; a word never has it."""
    h = xxhash.xxh3_64_intdigest(word)
    return (h - (1 << 64) if h >> 63 else h) or 1


def ending(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-2:]) % ENDINGS


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ASCII_LOWER).split()


@dataclass
class Hmm:
    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # states by symbols

    # Values are kept as states by texts, so that numpy's loops are as long as there are texts.

    def blocks(self, texts: list[np.ndarray]):
        """Texts of like length as (their indexes, a padded array of symbols, how many texts are longer than t), long ones first."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            longest = len(texts[order[at]])
            some = order[at : at + max(BLOCK_TEXTS, BLOCK_TOKENS // longest)]
            size = np.array([len(texts[i]) for i in some])
            pad = np.zeros((longest, len(some)), np.uint16)
            for k, i in enumerate(some):
                pad[: size[k], k] = texts[i]
            yield some, pad, np.searchsorted(-size, -np.arange(longest), side="left")
            at += len(some)

    def forward(self, pad: np.ndarray, live: np.ndarray, start: int, end: int, a: np.ndarray | None, total: np.ndarray, keep: bool):
        """Steps start to end of the scaled recursion from the values a before them; adds the logs of the scales to total. Returns the last values, and with keep those of each step."""
        kept = []
        for t in range(start, end):
            k = live[t]
            e = self.emit.take(pad[t, :k], axis=1)
            a = self.first[:, None] * e if a is None else (self.step.T @ a[:, :k]) * e
            scale = a.sum(0)
            a /= scale
            total[:k] += np.log(scale)
            if keep:
                kept.append((a, e, scale))
        return a, kept

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text of symbols."""
        out = np.zeros(len(texts))
        for some, pad, live in self.blocks(texts):
            total = np.zeros(len(some))
            self.forward(pad, live, 0, len(pad), None, total, False)
            out[some] = total
        return out / np.log(10)

    def expected(self, texts: list[np.ndarray]) -> np.ndarray:
        """Expected counts of starts, steps and emissions, and the log likelihood, one after the other in one array.

        Of long texts only the values at the starts of spans are kept; the others are computed again on the way back.
        """
        n, likelihood = len(self.first), 0.0
        first, step, emit = np.zeros(n), np.zeros((n, n)), np.zeros((n, SYMBOLS))
        for some, pad, live in self.blocks(texts):
            total, span = np.zeros(len(some)), max(1, BLOCK_TOKENS // len(some))
            starts = range(0, len(pad), span)
            a, before, kept = None, [], []
            for start in starts:
                before.append(a)
                a, kept = self.forward(pad, live, start, min(start + span, len(pad)), a, total, len(starts) == 1)
            likelihood += total.sum()
            b = np.zeros((n, 0))
            for start, a in zip(reversed(starts), reversed(before)):
                end = min(start + span, len(pad))
                if len(starts) > 1:
                    kept = self.forward(pad, live, start, end, a, np.zeros(len(some)), True)[1]
                shares, symbols = [], []
                for t in range(end - 1, start - 1, -1):
                    own, e, scale = kept[t - start]
                    k = own.shape[1]
                    if b.shape[1] < k:  # texts that end here
                        b = np.concatenate([b, np.ones((n, k - b.shape[1]))], axis=1)
                    g = own * b
                    g /= g.sum(0)
                    shares.append(g)
                    symbols.append(pad[t, :k])
                    if t:
                        last = (kept[t - start - 1][0] if t > start else a)[:, :k]
                        eb = e * b
                        eb /= scale
                        step += last @ eb.T
                        b = self.step @ eb
                    else:
                        first += g.sum(1)
                g, s = np.concatenate(shares, axis=1), np.concatenate(symbols)
                for i in range(n):
                    emit[i] += np.bincount(s, g[i], SYMBOLS)
        return np.concatenate([first, (step * self.step).ravel(), emit.ravel(), [likelihood]])


def maximize(counts: np.ndarray, shares: np.ndarray, states: int) -> Hmm:
    """The model of expected counts, smoothed towards the shares that symbols have in all texts."""
    n = states
    first, step, emit = counts[:n], counts[n : n + n * n].reshape(n, n), counts[n + n * n :].reshape(n, SYMBOLS)
    first, step, emit = first + 1, step + 1, emit + 5 * shares
    return Hmm(first / first.sum(), step / step.sum(1)[:, None], emit / emit.sum(1)[:, None])


def begin(shares: np.ndarray, states: int) -> Hmm:
    """Sticky states that differ at random from the shares."""
    rng = np.random.default_rng(4)
    emit = shares * rng.gamma(2.0, 0.5, (states, SYMBOLS))
    step = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Hmm(np.full(states, 1 / states), step, emit / emit.sum(1)[:, None])


def as_texts(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def train(trained: DataFrame, shares: np.ndarray, states: int, sweeps: int) -> tuple[Hmm, list[float]]:
    """The model after sweeps of incremental Baum-Welch over all rows of trained (symbols, part), and the log likelihood of each sweep."""
    model, seen = begin(shares, states), []
    counts = np.zeros((PARTS, states + states * states + states * SYMBOLS + 1))
    for _ in range(sweeps):
        for part in range(PARTS):

            def expect(batches, now=model):
                total = None
                for b in batches:
                    for at in range(0, b.num_rows, SLICE):
                        c = now.expected(as_texts(b.column(0).slice(at, SLICE)))
                        total = c if total is None else total + c
                if total is not None:
                    i = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["i", "v"])

            added = trained.where(F.col("part") == part).select("symbols").mapInArrow(lean(expect), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one number for each of the model's
            if added:
                counts[part] = 0
                counts[part, [r.i for r in added]] = [r.v for r in added]
                model = maximize(counts.sum(0)[:-1], shares, states)
        seen.append(float(counts[:, -1].sum()))
    return model, seen


class Words(dict):
    """Places of words in lists of what is known of them, which grow as words are looked up."""

    def __init__(self, rank: dict[int, int], log_count: np.ndarray, log_room: np.ndarray, end_log: float):
        super().__init__()
        self.rank, self.log_count, self.log_room, self.end_log = rank, log_count, log_room, end_log
        self.begin()

    def begin(self) -> None:
        self.clear()
        self[b""] = 0
        self.symbol, self.base, self.inner, self.rare = array("H", [0]), array("d", [self.end_log]), array("d", [0.0]), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        i = self.rank.get(h)
        count = 0.0 if i is None else float(self.log_count[i])
        own = i is not None and i < WORDS
        k = ending(word)
        self.symbol.append(1 + i if own else 1 + WORDS + k)
        self.base.append(count)
        self.inner.append(0.0 if own else count - float(self.log_room[k]))
        self.rare.append(h if i is None else 0)
        self[word] = place = len(self.symbol) - 1
        return place


def score_texts(docs: DataFrame, train_if, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, sweeps: int = SWEEPS) -> DataFrame:
    """Log10 probabilities of each row of docs under the model and under word counts alone.

    train_if: a condition on docs; rows where it holds are learned from. Returns id, train,
    n_tokens, n_known (tokens that occur in training), train_tokens, base_score, score. base:
    log10((c + 0.5) / (N + 0.5 (V + 1))) summed over the tokens. One row comes out for each row
    that goes in: repeated rows stay, and count as often in training; a null text is an empty
    one, whose only token is the end; a condition that is null teaches nothing. Without
    training rows all symbols are alike. Words are told apart by 64-bit hashes. Words that
    were never seen share half a count of their ending, each as if it were the only one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(PARTS)).cast("int")  # of the row alone, however the table is dealt out
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(train_if, F.lit(False)).alias("train"), F.col(text_col).alias("t"), part.alias("part"))

    def count(batches):
        c: Counter[bytes] = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([word_hash(w) if w else END for w in c], pa.int64()), pa.array([ending(w) for w in c], pa.int32()), pa.array(c.values(), pa.int64())], ["w", "k", "c"])
            c.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for t in batch.column(0).slice(at, 512).to_pylist():
                    c.update(words_of(t))
                    c[b""] += 1
                if len(c) > MOST_WORDS:
                    yield out()
        if c:
            yield out()

    counts = durable(texts.where("train").select("t").mapInArrow(lean(count), "w long, k int, c long").groupBy("w").agg(F.min("k").alias("k"), F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where("w <> 0").orderBy(F.desc("c"), "w").limit(HEAD).collect()
    ends = sum(r.c for r in counts.where("w = 0").collect())
    by_ending = np.zeros(ENDINGS)
    types = np.zeros(ENDINGS)
    for r in counts.where("w <> 0").groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        by_ending[r.k], types[r.k] = r.c, r.n
    for r in top[:WORDS]:
        by_ending[r.k] -= r.c
        types[r.k] -= 1
    room = by_ending + 0.5 * types + 0.5  # what words of one ending share; half a count is for those never seen
    log_room = np.log10(room)
    shares = np.zeros(SYMBOLS)
    shares[0] = ends + 0.5
    shares[1 : 1 + len(top[:WORDS])] = [r.c + 0.5 for r in top[:WORDS]]
    shares[1 + WORDS :] = room
    shares /= shares.sum()
    rank = {r.w: i for i, r in enumerate(top)}
    log_count = np.log10(np.array([r.c for r in top]) + 0.5) if top else np.zeros(0)
    end_log = float(np.log10(ends + 0.5))

    def read(batches):
        """Symbols of each text; sums of log counts of its frequent words; hashes of the others."""
        known = Words(rank, log_count, log_room, end_log)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                if len(known) > MOST_WORDS:
                    known.begin()
                split = [words_of(t) + [b""] for t in b.column(2).to_pylist()]
                size = np.fromiter(map(len, split), np.int64, len(split))
                place = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
                symbol, base, inner, rare = (np.array(x)[place] for x in (known.symbol, known.base, known.inner, known.rare))
                text, ends = np.repeat(np.arange(len(split)), size), np.r_[0, np.cumsum(size)]
                has = rare != 0
                tail = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text[has], minlength=len(split)))].astype(np.int32)), pa.array(rare[has]))
                symbols = pa.Array.from_buffers(pa.binary(), len(split), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(symbol)])
                sums = [pa.array(np.bincount(text, x, len(split))) for x in (base, inner)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(size), symbols, *sums, tail], ["id", "train", "part", "n", "symbols", "base", "inner", "tail"])

    seen = texts.mapInArrow(lean(read), f"id {kind}, train boolean, part int, n long, symbols binary, base double, inner double, tail array<long>")
    seen = durable(seen.withColumn("row", F.monotonically_increasing_id()), by="part")
    model, _ = train(seen.where("train"), shares, states, sweeps)

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(model.score(as_texts(b.column(6))))], ["row", "id", "train", "n", "base", "inner", "hmm"])

    scored = seen.select("row", "id", "train", "n", "base", "inner", "symbols").mapInArrow(lean(score), f"row long, id {kind}, train boolean, n long, base double, inner double, hmm double")
    rare = seen.select("row", F.explode("tail").alias("w")).groupBy("row", "w").agg(F.count("*").alias("times")).join(counts.select("w", "c"), "w", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("rest"), F.sum(F.when(c == 0, F.col("times")).otherwise(0)).alias("new"))
    out = scored.join(rare, "row", "left")
    rest = F.coalesce("rest", F.lit(0.0))
    whole = float(np.log10(n + 0.5 * (v + 1)))
    known_ends = 0 if ends else 1
    return out.select(
        F.col("id").alias(id_col), "train", F.col("n").alias("n_tokens"), (F.col("n") - known_ends - F.coalesce("new", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + rest - F.col("n") * F.lit(whole)).alias("base_score"), (F.col("hmm") + F.col("inner") + rest).alias("score"),
    )
