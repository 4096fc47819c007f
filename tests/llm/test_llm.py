"""Corpus operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from blockwright.llm import decontaminate, forced_bpe, hmm_score, line_dedup, prefix_counts, sharding, shingle_join, suffix_dedup, toxicity, vector_dedup  # noqa: E402
from blockwright.llm.common import connected_components  # noqa: E402

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lo long, id string, node long"


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("tha", "on", "re", "é", "st", "B")) for _ in range(rng.randint(1, 4)))
    lines = [" ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(50)]
    out = []
    for i in range(n):
        own = [rng.choice(lines) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        out.append((i * 3, "\n".join(own)))
    for i in range(40):  # near and exact copies
        words = out[i][1].split(" ")
        if i % 2 and len(words) > 12:
            words[5] = "changed"
        out.append((1000 + i, " ".join(words)))
    out += [(2000, None), (2001, ""), (2002, "a"), (2003, "A"), (2004, " \n\t "), (2005, "x" * 3000), (2006, "x" * 2000), (2007, "\n\n"), (2008, "one two three four five"), (2009, "ONE two  three four five")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)


def words(t):
    return (t or "").encode().translate(LOW).split()


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(ids, link):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in ids:
        for b in ids:
            if a < b and link(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [*corpus(), (None, "a  b"), (7, "<|endoftext|>x <|endoftext|>"), (7, "<|endoftext|>x <|endoftext|>"), (8, "日本 é  \n x")]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in prefix_counts.token_counts(frame(spark, rows), path, 20).collect())
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    assert got == sorted((i or -1, len((x or "").encode()), n(x), n(x) > 20) for i, x in rows)
    pc = prefix_counts.counter(path)
    text = "Hello wörld, it's <|endoftext|> fine  today"
    ends, counts = pc.prefix(text)
    assert counts[-1] == n(text) and ends[-1] == len(text.encode())
    assert all(n(text[: pc.budget(text, k)]) <= k for k in range(12))
    plain = "internationalization of unbelievably misspelt wrds andd numbers 1234567 é"
    for k in range(n(plain) + 2):
        assert pc.budget(plain, k) == max(j for j in range(len(plain) + 1) if n(plain[:j]) <= k and (not j or plain[j - 1] != " "))
    assert pc.inside(b"abcdefgh" * 40)[-1] == n("abcdefgh" * 40)
    with pytest.raises(ValueError):
        prefix_counts.counter(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*corpus(), (None, "a"), (7, "<|endoftext|>Ünï ΑΣ 日本 12 don't"), (7, "<|endoftext|>Ünï ΑΣ 日本 12 don't")]
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids), r.decoded) for r in forced_bpe.encode_decode(frame(spark, rows), path).collect())
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_bpe_of_very_long_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, bpe, rng = Tokenizer.from_file(path), forced_bpe.ForcedBpe(path), random.Random(1)
    for text in ("".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "na" * 9_000, "a" * 10_001, "ab" * 40 + " " + "-" * 5_000):
        ids = t.encode(text, add_special_tokens=False).ids
        n, raw, decoded = bpe.encode(text)
        assert raw == struct.pack(f"<{len(ids)}I", *ids) and n == len(ids) and decoded == t.decode(ids, skip_special_tokens=False)
    began = time.process_time()
    bpe.encode("".join(rng.choice("etaoinshrdlu") for _ in range(100_000)))
    assert time.process_time() - began < 5


def test_suffix_dedup(spark):
    rows = [*corpus(), (3001, "abc" * 200), (3000, "zabc" * 100 + "abc" * 40)]
    source = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            source.setdefault(b[k : k + 50], i)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, [*rows, (None, rows[0][1])])).collect()}
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if source[b[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        assert bytes(got[i].kept) == bytes(c for c, m in zip(b, cover) if not m), i
        assert got[i].n_removed == sum(cover) and len(got[i].spans) == sum(cover[k] and not (k and cover[k - 1]) for k in range(len(cover)))
    assert got[None].n_removed == 0


def check_removed(rows, got):
    source = {}
    for i, t in sorted(rows):
        b = t.encode()
        for k in range(len(b) - 49):
            source.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = t.encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if source[b[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        assert bytes(got[i].kept) == bytes(c for c, m in zip(b, cover) if not m), i


def frequent_passages(n=120):
    """Texts around a few passages, some of which most texts have, with different bytes on both sides."""
    rng = random.Random(7)
    some = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passages = [some(k) for k in (50, 57, 63, 75, 90, 140)]
    return [(i, some(rng.randint(0, 60)) + "".join(rng.choice(passages[: 1 + i % 6]) + some(rng.randint(0, 40)) for _ in range(rng.randint(1, 3)))) for i in range(n)]


def test_frequent_anchors_meet_by_window(spark, monkeypatch):
    rows = frequent_passages()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions have rows of an anchor
    try:
        for local, every, size in ((1, 4000, 1 << 20), (16, 2, 1 << 20), (3, 5, 2000), (16, 4000, 900)):
            monkeypatch.setattr(suffix_dedup, "LOCAL_PIECES", local)
            monkeypatch.setattr(suffix_dedup, "WHOLE_PIECES", every)
            monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", size)
            monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 3 * size)
            monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
            check_removed(rows, {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, rows).repartition(7)).collect()})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_frequent_passage_makes_no_large_group():
    """Of an anchor that stands in all texts, a slice sends a few pieces at most to the task of the anchor, and a mark."""
    rows = frequent_passages(600)
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "j": [0] * len(rows), "t": [t if len(t) >= 50 else "x" * 50 for _, t in rows]})
    often = collections.Counter()
    for b in suffix_dedup.find([batch], 50, 4, 16, 1 << 30):
        if b.column(1)[0].as_py() == suffix_dedup.PIECE:
            v = suffix_dedup.values(b, suffix_dedup.TRAVEL)
            often.update(zip(v["g"].tolist(), v["h"].tolist()))
    assert max(often.values()) <= 16 * 3  # a text can hold a piece more than once


def test_a_frequent_window_gets_a_row_for_each_batch():
    """Windows of a passage that all texts of a batch have go to their keys once; what the texts lose goes by text, as runs."""
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    texts = [f"{i:04d}" + passage + f"{i:04d}" for i in range(2000)]
    columns = {"id": list(range(2000)), "j": [0] * 2000, "t": texts, "kind": [suffix_dedup.WHOLE] * 2000, "ends": [[4, 24]] * 2000, "rel": [None] * 2000, "key": [None] * 2000}
    rows = [r for b in suffix_dedup.cut([pa.RecordBatch.from_pydict(columns)], 50) for r in b.to_pylist()]
    assert max(collections.Counter(r["key"] for r in rows).values()) == 1
    assert sorted(r["first"] for r in rows if r["piece"]) == list(range(4, 25)) and {r["id"] for r in rows if r["piece"]} == {0}
    assert sorted((r["id"], r["first"], r["last"]) for r in rows if not r["piece"]) == [(i, 4, 24) for i in range(1, 2000)]
    columns |= {"t": ["z" * 500] * 2000, "ends": [[0, 450]] * 2000}
    assert sum(b.num_rows for b in suffix_dedup.cut([pa.RecordBatch.from_pydict(columns)], 50)) == 2000


def test_rows_of_one_id_take_nothing_from_each_other(spark):
    some = "the quick brown fox jumps over the lazy dog and then it sleeps for the rest of the day. "
    rows = [(5, some), (5, "a " + some), (7, "b " + some), (5, some)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(5, len(some), 0), (5, len(some), 0), (5, len(some) + 2, 0), (7, len(some) + 2, len(some) + 1)]  # the space before it too
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_merged_transforms_are_sorted():
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 76))) for _ in range(40)]
    cuts = [0, 15, 16, 31, 40]
    made = [suffix_dedup.transform(pieces[a:z]) for a, z in zip(cuts, cuts[1:])]
    row, _ = suffix_dedup.merge([m[0] for m in made], np.diff(cuts).tolist(), 50)
    before = np.cumsum([0, *[len(m[1]) for m in made]])
    place = np.concatenate([m[1] + at for m, at in zip(made, before)])[row]
    text, end = b"".join(p + b"\0" for p in pieces), []
    for k, p in enumerate(pieces):
        end += [k] * (len(p) + 1)
    suffix = [(text[i : text.index(0, i)], end[i]) for i in range(len(text))]
    assert [suffix[i] for i in place] == sorted(suffix)


def test_hmm(spark):
    rows = corpus()
    docs = frame(spark, [*rows, (None, "on re")])
    got = {r.doc_id: r for r in hmm_score.score_texts(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1, sweeps=1).collect()}
    trained = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    c = collections.Counter(w for i, t in rows if i in trained for w in [*words(t), None])
    n, d = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for i, t in rows:
        tokens = [*words(t), None]
        assert got[i].n_tokens == len(tokens) and got[i].n_known == sum(c[w] > 0 for w in tokens) and got[i].train_tokens == n and got[i].train == (i in trained)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.5) / d) for w in tokens), rel_tol=1e-9)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert not got[None].train
    assert len(hmm_score.score_texts(docs.limit(0), F.lit(True)).collect()) == 0


def test_hmm_sweeps_run_over_all_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [np.r_[rng.integers(1, 30, 1 + k % 7) + 40 * (k % 3), 0] for k in range(500)]
    shares = (np.bincount(np.concatenate(texts), minlength=hmm_score.SYMBOLS) + 0.5) / (sum(map(len, texts)) + 0.5 * hmm_score.SYMBOLS)
    rows = spark.createDataFrame([(t.astype("<u2").tobytes(), k % hmm_score.PARTS) for k, t in enumerate(texts)], "symbols binary, part int").repartition(5)
    got, rise = hmm_score.train(rows, shares, 3, 4)
    want, counts = hmm_score.begin(shares, 3), np.zeros((hmm_score.PARTS, 3 + 9 + 3 * hmm_score.SYMBOLS + 1))
    for _ in range(4):
        for part in range(hmm_score.PARTS):
            counts[part] = want.expected(texts[part :: hmm_score.PARTS])
            want = hmm_score.maximize(counts.sum(0)[:-1], shares, 3)
    assert np.allclose(got.emit, want.emit) and np.allclose(got.step, want.step)
    assert len(rise) == 4 and all(b > a for a, b in zip(rise, rise[1:]))
    monkeypatch.setattr(hmm_score, "BLOCK_TOKENS", 40)  # texts in several spans
    monkeypatch.setattr(hmm_score, "BLOCK_TEXTS", 20)
    again = want.expected(texts)
    monkeypatch.undo()
    assert np.allclose(again, want.expected(texts))


def test_hmm_scores_are_the_probability_of_the_words(spark):
    """score against a brute-force model, and its gain over word counts on held-out texts."""
    rng = random.Random(4)
    kinds = [[f"{c}{k}" for k in range(12)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(1, 40)))) for i in range(240)] + [(900, "unseen a1 words"), (901, None)]
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    models = []
    train = hmm_score.train
    try:
        hmm_score.train = lambda *a: models.append(train(*a)) or models[-1]
        got = {r.doc_id: r for r in hmm_score.score_texts(frame(spark, rows), held).collect()}
    finally:
        hmm_score.train = train
    m = models[0][0]
    c = collections.Counter(w for i, t in rows if got[i].train for w in words(t))
    top = sorted(c, key=lambda w: (-c[w], hmm_score.word_hash(w)))
    for i, t in rows:
        symbols, rest = [], 0.0
        for w in words(t):
            if w in c:
                symbols.append(1 + top.index(w))
            else:  # half a count, of what words of this ending share
                symbols.append(1 + hmm_score.WORDS + hmm_score.ending(w))
                rest += math.log10(0.5) - math.log10(0.5)
        a = m.first
        p = 0.0
        for t_, x in enumerate([*symbols, 0]):
            a = (a if t_ == 0 else a @ m.step) * m.emit[:, x]
            p += math.log10(a.sum())
            a = a / a.sum()
        assert math.isclose(got[i].score, p + rest, rel_tol=1e-9), i
    apart = [r for r in got.values() if not r.train and r.doc_id < 900]
    assert len(apart) > 20 and sum(r.score for r in apart) > sum(r.base_score for r in apart) + 50


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    shares = np.full(hmm_score.SYMBOLS, 1 / hmm_score.SYMBOLS)
    m = hmm_score.begin(shares, 2)
    text = rng.integers(0, 50, 6)
    total = 0.0
    for path in np.ndindex(*[2] * 6):
        p = m.first[path[0]] * m.emit[path[0], text[0]]
        for t in range(1, 6):
            p *= m.step[path[t - 1], path[t]] * m.emit[path[t], text[t]]
        total += p
    assert math.isclose(m.score([text, text[:1]])[0], math.log10(total), rel_tol=1e-9)


def test_expected_counts_are_those_of_all_paths():
    """Starts, steps, emissions and likelihood against every path of states."""
    rng, n = np.random.default_rng(1), 3
    m = hmm_score.begin(rng.dirichlet(np.ones(hmm_score.SYMBOLS)), n)
    m.first = rng.dirichlet(np.ones(n))
    m.step = rng.dirichlet(np.ones(n), n)
    texts = [rng.integers(0, 20, k) for k in (5, 4, 4, 1)]
    first, step, emit, likelihood = np.zeros(n), np.zeros((n, n)), np.zeros((n, hmm_score.SYMBOLS)), 0.0
    for text in texts:
        ways = []
        for path in np.ndindex(*[n] * len(text)):
            p = m.first[path[0]] * m.emit[path[0], text[0]]
            for t in range(1, len(text)):
                p *= m.step[path[t - 1], path[t]] * m.emit[path[t], text[t]]
            ways.append((path, p))
        total = sum(p for _, p in ways)
        likelihood += math.log(total)
        for path, p in ways:
            first[path[0]] += p / total
            for t in range(len(text)):
                emit[path[t], text[t]] += p / total
                if t:
                    step[path[t - 1], path[t]] += p / total
    assert np.allclose(m.expected(texts), np.concatenate([first, step.ravel(), emit.ravel(), [likelihood]]))


def test_hmm_scores_do_not_depend_on_partitions(spark):
    rows, held = [(1 + k, t) for k, (_, t) in enumerate(corpus())], F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    one, seven = ({r.doc_id: r.score for r in hmm_score.score_texts(frame(spark, rows).repartition(k), held, sweeps=1).collect()} for k in (1, 7))
    assert all(math.isclose(one[i], seven[i], rel_tol=1e-9) for i in one) and len(one) == len(rows)


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join(["hello", "world", "fine", "day"] * rng.randint(3, 9) + (["you", "scumbag"] * 3 if bad else []))))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (9999, 1)]
    train = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(3)) != 1
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame(spark, [*rows, (None, "you scumbag"), (500, None), (500, "")])
    got = toxicity.score_toxicity(docs, known, train).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert {r.predicted for r in toxicity.score_toxicity(docs, known.limit(0), train).collect()} == {0}


def test_isotonic_steps_are_the_min_max_means():
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((60, 1)), (rng.random(60) < 0.5).astype(float)
    model = toxicity.Boosted(1)
    model.margin = lambda v: v[:, 0]
    toxicity.calibrate(model, x, y)
    order = np.argsort(x[:, 0])
    z = y[order]
    want = [max(min(z[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]  # isotonic least squares
    blocks = [[k for k in range(60) if math.isclose(want[k], w)] for w in sorted(set(np.round(want, 12)))]
    for own in blocks:
        rate = (z[own].sum() + 0.5) / (len(own) + 1)
        got = model.score(x[order][own])
        assert got.min() >= 0 and np.ptp(got) < 1e-9 and (abs(got[0] - rate) < 1e-9 or any(abs(got[0] - v) < 1e-9 for v in model.values))
    assert (np.diff(model.score(x[order])) >= 0).all()


def test_first_tree_splits_as_an_exhaustive_search_does():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = (rng.random(300) < np.where(x[:, 1] > 2, 0.8, 0.2)).astype(float)
    model = toxicity.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 0.5) / 301
    g, h = y - p, np.full(300, p * (1 - p) + 1e-9)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(x[:, f] <= c), -f, -c) for f in range(3) for c in range(5))
    f, c = model.feature[0][0], model.cut[0][0]
    assert (f, best[0]) == (-best[1], pytest.approx(gain(x[:, f] <= c)))
    left = x[:, f] <= c
    assert np.allclose(model.leaf[0], [0.25 * g[left].sum() / (h[left].sum() + 1), 0.25 * g[~left].sum() / (h[~left].sum() + 1)])


def test_lexicons_leave_out_their_own_fold(spark):
    rng = random.Random(6)
    bad, good = ["nastyword", "vilething", "uglytalk"], ["garden", "river", "window", "paper"]
    rows = [(" ".join(rng.choice(bad + good if toxic else good) for _ in range(8)), toxic, rng.randrange(toxicity.FOLDS)) for toxic in (0, 1) for _ in range(60)]
    rows += [("onlyhere garden", 1, 2)] * 9 + [(None, 1, 0), ("", 0, 1)]
    got = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int").repartition(3))
    for k, (lexicon, stems) in enumerate(got):
        seen = [(set(toxicity.words_of(t or "")), y) for t, y, f in rows if f != k]
        terms = {w for ws, _ in seen for w in ws}
        hold = lambda has: (n := sum(y for ws, y in seen if has(ws))) >= (6 if k < toxicity.FOLDS else 8) and n >= 0.9 * sum(has(ws) for ws, _ in seen)
        assert lexicon == {w for w in terms if hold(lambda ws, w=w: w in ws)}
        long = {w[: toxicity.STEM] for w in terms if len(w) > toxicity.STEM}
        assert stems == {x for x in long if hold(lambda ws, x=x: any(w[: toxicity.STEM] == x and len(w) > toxicity.STEM for w in ws))}
    assert b"onlyhere" in got[-1][0] and b"onlyhere" not in got[2][0]


def test_toxicity_goes_by_words_where_length_parts_as_well():
    """Toxic rows that are all longer than the others: a long text without such words isn't toxic."""
    words, stems = frozenset([b"scumbag", b"filthy"]), frozenset()
    rows = [(f"you filthy scumbag and so on and on and on for word{k}", 1.0) for k in range(60)] + [(f"a fine day number {k}", 0.0) for k in range(60)]
    x, y = np.array([toxicity.describe(t, words, stems) for t, _ in rows]), np.array([t for _, t in rows])
    model = toxicity.calibrate(toxicity.fit(x[::2], y[::2], tried=toxicity.TRIED), x[1::2], y[1::2])
    long, bad = model.score(np.array([toxicity.describe(t, words, stems) for t in ("one plain word after another " * 9, "scumbag")]))
    assert long < 0.1 and bad > 0.9


def test_toxicity_takes_one_text_of_a_repeated_id(spark):
    docs = frame(spark, [(1, f"text {k}") for k in range(50)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 10, lambda c: F.lit(True)).count() == 2


def test_decontaminate(spark):
    rows = corpus()
    items = [(1, " ".join(["Alpha", "beta", "Ñu"] + [f"w{k}" for k in range(20)])), (2, "Short item ONLY"), (2, "other text"), (None, "tha on"), (3, None), (4, "--")]
    rows += [(4000, "x ALPHA, beta: Ñu " + " ".join(f"w{k}" for k in range(9)) + " no " + " ".join(f"w{k}" for k in range(14))), (4001, "short item only " * 2), (4002, "short item"), (4003, "alpha beta ñu " + " ".join(f"w{k}" for k in range(9)))]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = [(i, w[k : k + 13]) for i, t in items if i is not None and (w := low(t)) for k in range(max(1, len(w) - 12))]
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, [*rows, (None, "Short item only")]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        w = low(t)
        hit, found = set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, list(got[i].items)) == (len(w), len(hit), sorted(found)), i
        assert got[i].contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert got[None].n_hit == 3


def test_sharding(spark):
    rows = [*corpus(), (None, "abc"), (5, "é" * 50), (5, "é" * 50)]
    got = sharding.assign_shards(frame(spark, rows), 4000).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((i or -1, len((t or "").encode())) for i, t in rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        bits = {bin(int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:11] + hashlib.md5((t or "").encode()).hexdigest()[:4], 16))[2:].zfill(60) for i, t in rows if i == r.doc_id}
        assert any(b.startswith(r.shard) for b in bits)
    for s, part in shards.items():
        size = sum(r.n_bytes for r in part)
        assert {(size, len(part))} == {(r.shard_bytes, r.shard_rows) for r in part}
        assert size <= 4000 or (part[0].oversized and len({r.doc_id for r in part}) == 1)
        if s:  # the bucket above was over the limit
            assert sum(r.n_bytes for k, p in shards.items() if k.startswith(s[:-1]) for r in p) > 4000
    assert sharding.assign_shards(frame(spark, []), 10).count() == 0


def test_rows_of_one_id_are_sharded_by_text(spark):
    rows = [(None, f"text {k} " * 20) for k in range(40)] + [(7, f"other {k} " * 20) for k in range(40)]
    got = sharding.assign_shards(frame(spark, rows), 1000).collect()
    assert len(got) == 80 and all(r.shard_bytes <= 1000 and not r.oversized for r in got)


def test_written_shards_fit_the_limit(spark, tmp_path):
    rows = [(i, t) for i, t in corpus() if t]
    sharding.write_shards(frame(spark, rows), 4000, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").withColumn("file", F.input_file_name()).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted(rows)
    held = collections.Counter()
    for r in back:
        held[r.file] += len(r.text.encode())
    assert len(held) == len({r.shard for r in back}) > 3 and max(held.values()) <= 4000


CLASHING = ["drop", "wid", "wmark", "n_lines", "n_removed", "n_words", "items", "bad_id", "mark", "start", "h", "again", "value", "gone", "size", "first", "lo", "hi", "copies", "task", "kind", "count", "label_id", "toxic", "score", "predicted", "place", "own", "t"]


def crowded(spark, rows, id_col="doc_id", text_col="text", kind="string"):
    """rows with extra columns whose names operators might use inside."""
    df = spark.createDataFrame(rows, f"{id_col} long, {text_col} {kind}")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


def test_extra_columns_with_clashing_names(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(n=30)]
    docs, plain = crowded(spark, rows), spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    word = public_tokenizers.path("word_bpe_49k.json")
    items = crowded(spark, [(1, " ".join(words(rows[3][1])[:13] and rows[3][1].split()[:13]))], "item_id")
    labels = crowded(spark, [(i, None) for i, _ in rows], "doc_id").withColumn("toxic", F.col("doc_id") % 2)
    train = lambda c: F.col(c) >= 0
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(prefix_counts.token_counts(docs, path), prefix_counts.token_counts(plain, path))
    assert same(forced_bpe.encode_decode(docs, word), forced_bpe.encode_decode(plain, word))
    assert same(suffix_dedup.remove_repeats(docs), suffix_dedup.remove_repeats(plain))
    assert same(shingle_join.shingle_components(docs), shingle_join.shingle_components(plain))
    scores = [{r.doc_id: r for r in hmm_score.score_texts(d, F.col("doc_id") % 3 != 1, sweeps=1).collect()} for d in (docs, plain)]
    assert all(math.isclose(scores[0][i].score, scores[1][i].score, rel_tol=1e-9) for i in scores[1]) and scores[0].keys() == scores[1].keys()
    assert same(sharding.assign_shards(docs, 900), sharding.assign_shards(plain, 900))
    assert same(toxicity.score_toxicity(docs, labels, train), toxicity.score_toxicity(plain, labels.select("doc_id", "toxic"), train))
    assert same(decontaminate.contamination(docs, items), decontaminate.contamination(plain, items.select("item_id", "text")))
    cleaned = line_dedup.dedup_lines(docs.drop("n_lines", "n_removed"))
    assert same(cleaned.select("doc_id", "text", "n_lines", "n_removed"), line_dedup.dedup_lines(plain))
    assert set(CLASHING) <= set(cleaned.columns)
    vectors = crowded(spark, [(i, [float(i % 3), 1.0, 2.0]) for i in range(9)], "vec_id", "embedding", "array<float>")
    assert same(vector_dedup.vector_components(vectors), vector_dedup.vector_components(vectors.select("vec_id", "embedding")))
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, items, keep=("n_words",))
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert prefix_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert forced_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert vector_dedup.vector_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), lambda c: F.lit(True)).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(docs, some).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(frame(spark, [(1, "a b c")]), some.limit(0)).collect()] == [0]


def test_pipeline_over_empty_tables(spark, tmp_path):
    """No documents give no rows; without labels and items only copies and repeated lines go."""
    documents = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kinds in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none/{name}.parquet")
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/some/{name}.parquet")
    line = " ".join(f"w{k}" for k in range(30))
    spark.createDataFrame([], documents).write.parquet(f"{tmp_path}/none/documents.parquet")
    rows = [(1, line, "en", "a", 1), (2, line + "\nof its own, and more than the other has", "en", "a", 1), (3, "", None, None, None), (4, None, None, None, None)]
    spark.createDataFrame(rows, documents).write.parquet(f"{tmp_path}/some/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) == [1, 2, 3, 4]


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60_000))
    rows = [(1, long), (2, long[:200_000] + " other words"), (3, "z" * 300_000), (4, "z" * 1000 + "\n" + long[1000:1400])]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed, got[4].n_removed) == (0, 200_000, 0, 1400)
    assert {r.doc_id: r.component_id for r in shingle_join.shingle_components(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    lines = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, [(1, long), (2, long + " more")])).collect()}
    assert lines == {1: 0, 2: 1}
    scored = {r.doc_id: r for r in hmm_score.score_texts(frame(spark, rows), F.col("doc_id") != 2, sweeps=1).collect()}
    assert scored[1].n_tokens == 60_001 and all(math.isfinite(r.score) for r in scored.values())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    unbroken = [*rows, (5, "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000)))]
    assert {r.doc_id: r.n_tokens for r in prefix_counts.token_counts(frame(spark, unbroken), public_tokenizers.path("byte_bpe_50k.json")).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in unbroken}
    toxic = toxicity.score_toxicity(frame(spark, rows), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"), lambda c: F.lit(True)).collect()
    assert len(toxic) == 4 and all(0 <= r.score <= 1 for r in toxic)
    shards = {r.doc_id: r for r in sharding.assign_shards(frame(spark, rows), 250_000).collect()}
    assert len(shards) == 4 and len({r.shard for r in shards.values()}) >= 3
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in forced_bpe.encode_decode(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}
    assert [r.n_hit for r in decontaminate.contamination(frame(spark, [(1, long)]), spark.createDataFrame([(9, long[5000:6000].split(" ", 1)[1])], "item_id long, text string")).collect()][0] > 100


def test_shingle_components(spark):
    rows = corpus()
    sets = {i: grams(t) for i, t in rows}
    link = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = linked([i for i, _ in rows], link)
    got = shingle_join.shingle_components(frame(spark, [*rows, rows[0], (None, rows[0][1])])).collect()
    assert len(got) == len(rows) + 2
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in got if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(len(sets[0]), None)]
    assert shingle_join.shingle_components(frame(spark, [])).count() == 0


def test_large_groups_are_dealt_as_blocks(spark, monkeypatch):
    rows = corpus()
    want = {(r.doc_id, r.component_id) for r in shingle_join.shingle_components(frame(spark, rows)).collect()}
    monkeypatch.setattr(shingle_join, "GROUP_TOKENS", 60)
    assert {(r.doc_id, r.component_id) for r in shingle_join.shingle_components(frame(spark, rows)).collect()} == want


def test_first_comparison_bound():
    """A pair at 0.75 shares at least first_part - prefix n-grams of both first parts."""
    prefix = lambda n: shingle_join.prefix_size(n, 75, 100)
    part = lambda n: int(shingle_join.first_part(np.array([n]))[0])
    for n in range(1, 400):
        for m in range(-(-3 * n // 4), 4 * n // 3 + 1):
            both = -(-75 * (n + m) // 175)
            if both <= min(n, m):
                assert min(part(n) - (n - both), part(m) - (m - both)) >= max(1, part(n) - prefix(n))


def test_line_dedup(spark):
    rows = [*corpus(), (5000, "the quick brown fox jumps over the lazy dog again and again today\nnew line here"), (5001, "the quick brown fox jumps over the lazy dog again and again TODAY\nthe quick brown fox jumps over the lazy dog again and again\n\nnew line here now")]
    seen, want = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            s = grams(line)
            if s and any(100 * len(s & o) >= 75 * len(s | o) for o in seen):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            kept.append(line)
        want[i] = None if t is None else "\n".join(kept)
    got = line_dedup.dedup_lines(frame(spark, [*rows, (None, "the quick brown fox jumps over the lazy dog again and again today")]))
    assert got.columns == ["doc_id", "text", "lo", "id", "node", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == want | {None: ""}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.2 * rng.standard_normal((20, 16)), base[:5], 3 * base[:3]]).astype(np.float32)
    rows = [(i * 2, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [None] * 16), (None, rows[0][1]), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]
    got = vector_dedup.vector_components(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = linked([i for i, _ in rows], lambda a, b: near[a // 2, b // 2])
    for r in got:
        if r.vec_id is not None and r.vec_id < 9000:
            assert (r.n_links, r.component_id, r.kept) == (near[r.vec_id // 2].sum(), want[r.vec_id], want[r.vec_id] == r.vec_id)
        elif r.vec_id in (9006, 9007):
            assert (r.n_links, r.component_id) == (1, 9006)
        else:
            assert (r.n_links, r.component_id) == (0, r.vec_id)


def test_vectors_in_many_blocks(spark, monkeypatch):
    """The index path: several blocks, cells split over some, recall against brute force, and counts that both sides of a pair share."""
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(7)
    middle = rng.standard_normal((150, 24))
    x = np.concatenate([np.repeat(middle, 8, 0) + 0.18 * rng.standard_normal((1200, 24)), rng.standard_normal((800, 24)), middle[0] + 0.02 * rng.standard_normal((250, 24))])
    got = vector_dedup.vector_components(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    n = {r.vec_id: r.n_links for r in got}
    assert all(n[i] <= near[i].sum() for i in range(len(x)))  # none below the cosine
    assert sum(n.values()) >= 0.97 * near.sum() and sum(n.values()) % 2 == 0
    whole = linked(range(len(x)), lambda a, b: near[a, b])
    assert np.mean([r.component_id == whole[r.vec_id] for r in got]) > 0.97


def test_tree_links_grow_gently():
    """Sets that share a few frequent n-grams only: as good as brute force, and not with the square of their number."""
    rng = np.random.default_rng(1)
    some = lambda n, size=200: [np.unique(np.r_[[1, 2, 3], rng.integers(10, 1 << 50, size)]).astype(np.uint64) for _ in range(n)]
    small = some(60, 30)
    small += [np.sort(np.r_[s[:-2], [7, 8]].astype(np.uint64)) for s in small[:20]]
    link = lambda a, b: 100 * len(np.intersect1d(small[a], small[b])) >= 75 * len(np.union1d(small[a], small[b]))
    want = linked(range(len(small)), link)
    assert shingle_join.tree_links(small, 75, 100) == [want[i] for i in range(len(small))]
    took = []
    for n in (500, 2000):
        sets = some(n)
        began = time.process_time()
        assert shingle_join.tree_links(sets, 75, 100) == list(range(n))
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.1)


def test_rows_that_travel_dont_grow_with_the_tasks(spark, monkeypatch):
    """Rows of line dedup and of the n-gram join hold several values each, however many tasks there are."""
    sent = []

    def caught(rows):
        sizes = [F.octet_length(c) / np.dtype(t).itemsize for c, t in shingle_join.MET.items()]
        sent.append(rows.agg(F.count("*"), F.sum(F.greatest(*sizes))).first())
        raise InterruptedError

    rng = np.random.default_rng(8)
    texts = ["\n".join(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 10)) for _ in range(3)) for _ in range(4096)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        for module, work in ((line_dedup, line_dedup.dedup_lines), (shingle_join, shingle_join.shingle_components)):
            monkeypatch.setattr(module, "travelled", caught)
            with pytest.raises(InterruptedError):
                work(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sent) == 2 and all(values > 4 * rows for rows, values in sent)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input; rows of repeated and null ids."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*corpus(), (3, "another text of id three that is long enough"), (None, "tha on"), (None, "tha on")]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    bad = "you scumbag you filthy scumbag " * 3
    toxic = [(7000 + k, bad + f"word{k}", "en", "s", 9) for k in range(90)]
    fine = [(8000 + k, f"a fine day number {k} in the park with friends", "en", "s", 9) for k in range(200)]
    spark.createDataFrame([(i, 1, 1) for i, *_ in toxic] + [(i, 1, 0) for i, *_ in fine], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(f"question{k}" for k in range(16))  # words that no other row has
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda k, df: corpus_pipeline.STAGES[k][1](spark, df, str(tmp_path))
    kept = run(0, spark.createDataFrame([*rows, *toxic, *fine], schema))
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, spark.createDataFrame([*rows, *fine], schema).collect()))
    components = {(r.doc_id, r.component_id) for r in shingle_join.shingle_components(docs).collect()}
    gone = {i for i, c in components if i is not None and i != c}
    left = collections.Counter(r.doc_id for r in run(2, docs).collect())
    sets = {i: grams(t) for i, t in corpus()}
    link = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = linked(sorted(sets), link)
    assert gone == {i for i, c in want.items() if i != c} and set(left) == {i for i, c in want.items() if i == c} | {None} and left[3] == 2 and left[None] == 2
    hit = [(9000, "before " + item + " after", "en", "s", 1), (9001, "x " * 2000 + item, "en", "s", 1)]
    stays = {r.doc_id for r in run(3, spark.createDataFrame([*rows, *hit], schema)).collect()}
    assert 9000 not in stays and 9001 in stays and {i for i, *_ in rows} <= stays | {None}
    lines = run(1, docs).collect()
    assert len(lines) == len(rows) and all(r.n_chars == len(r.text) for r in lines if r.text is not None)


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows[:50]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[3][1].split()))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.where("doc_id IN (2000, 2001)").count() == 2
        docs = out
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert len(got) == docs.count()
