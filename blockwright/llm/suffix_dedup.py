"""Removal of byte strings that an earlier document has, by merged Burrows-Wheeler transforms.

Sorting all suffixes of a corpus is out of reach, and most can't matter: a string of 50
bytes that two documents share has the same least 24-byte gram in both. Each document is
cut into pieces, the runs of windows with one least gram (their anchor). Pieces travel as
hashes first, many to a row: equal pieces are settled there, the least document keeps its
one, and anchors that one document has are done. What is left are anchors with unlike
pieces: the borders of what documents share. Only these pieces travel as bytes.

A task deals such pieces into shards. Each shard's Burrows-Wheeler transform comes from its
own suffixes. The transforms are merged by refining their interleave: starting from one
shard behind the other, each round passes the interleave through the last-to-first
mappings and so sorts by one more character, until it no longer changes. Rows that a round
tells apart give the common prefixes: after 50 rounds, rows not yet apart are a repeated
interval of 50-byte strings. No suffix is sorted again across shards. The least document
of an interval keeps its string.

Anchors with very many unlike pieces make no merge: their windows meet by 128 bits of hash.
Of a batch of texts only the least document's window travels to the window's key; what the
others of the batch lose is known there and travels by text. So a key gets a row for each
batch, however many texts hold the window.

Hashes: anchors only bring pieces together; pieces count as equal by their anchor's 40 bits
and bucket and 48 bits of their own.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm.common import discard, durable, groups, lean, packed, partitions, sent, values, whole_tasks

#: Bytes of an anchor.
GRAM = 24
#: Bytes of pieces that are merged at a time, and those of one shard.
MERGE_BYTES, SHARD_BYTES = 1 << 19, 1 << 16
#: Bytes of texts whose pieces are told apart at a time before they travel.
SLICE_BYTES = 12 << 20
#: Unlike pieces of an anchor in one slice, and in all, beyond which its windows meet instead.
LOCAL_PIECES, WHOLE_PIECES = 64, 4_000
MULTIPLIER = 6364136223846793005


class Roller:
    """Hashes of all grams of a text: a polynomial modulo 2**64 over random byte values, then mixed."""

    def __init__(self):
        rng = np.random.default_rng(24)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, MULTIPLIER, np.uint64)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, pow(MULTIPLIER, -1, 1 << 64), np.uint64)])

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self.powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=total[1:])
        return total

    def between(self, total: np.ndarray, start, end) -> np.ndarray:
        h = (total[end] - total[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


ROLLER = Roller()


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of one text, runs of windows with one anchor: hashes of anchor and piece, place of the anchor, first and last window."""
    total = ROLLER.sums(raw)
    h = ROLLER.between(total, slice(0, len(raw) - GRAM + 1), slice(GRAM, len(raw) + 1))
    width = length - GRAM + 1
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:  # the anchor of a window is the first gram that has the window's least hash
        step = min(span, width - span)
        left = low[:-step] <= low[step:]
        low, at, span = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:]), span + step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return low[first], ROLLER.between(total, first, last + length), at[first], first, last


def transform(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a shard's Burrows-Wheeler transform: character before each suffix, and its place in the shard's text.

    Each piece ends in a mark of its own, less than all bytes and in the order of the
    pieces. Marks come as 0, bytes one higher (255 stands in no UTF-8 text).
    """
    text = (np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)).copy()
    n, mark = len(text), text == 0
    number = np.cumsum(mark) - mark + 1  # of the piece a place is in
    until = np.flatnonzero(mark)[number - 1] - np.arange(n)
    key = np.zeros(n, np.int64)
    wide = np.r_[text, np.zeros(5, np.uint8)].astype(np.int64)
    for k in range(5):
        key = key * 256 + np.where(until > k, wide[k : k + n], 0)
    key = key * (len(pieces) + 1) + np.where(until < 5, number, 0)
    longest, span = max(map(len, pieces)) + 1, 5
    rank = np.empty(n, np.int64)
    while True:
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        if span >= longest or rank[order[-1]] == n - 1:
            return text[order - 1], order
        behind = np.zeros(n, np.int64)
        behind[: n - span] = rank[span:] + 1
        key, span = rank * (n + 1) + behind, 2 * span


def merge(shards: list[np.ndarray], marks: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of transforms: for each row of the merged one its row in the shards, one behind the other; and whether a new interval of common length-prefixes starts there.

    marks: pieces of each shard, whose marks are its first rows.
    """
    before = np.cumsum([0, *map(len, shards)])
    chars, n, ends = np.concatenate(shards), int(before[-1]), sum(marks)
    step = np.empty(n, np.int32)  # last-to-first mapping of each row inside its shard
    for at, own in zip(before.tolist(), shards):
        step[at + np.argsort(own, kind="stable")] = np.arange(at, at + len(own), dtype=np.int32)
    row = np.arange(n, dtype=np.int32)
    turned = np.concatenate([np.arange(at, at + m, dtype=np.int32) for at, m in zip(before.tolist(), marks)] + [np.empty(n - ends, np.int32)])
    block, new, rounds = np.zeros(n, np.int32), np.ones(n, bool), 0
    while True:
        now = chars[row]
        order = np.argsort(now, kind="stable")[ends:]
        turned[ends:] = step[row[order]]
        if rounds < length:
            c, b = now[order], block[order]
            new[ends + 1 :] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
            np.cumsum(new, out=block)
        rounds += 1
        settled = np.array_equal(turned, row)
        row[:] = turned
        if settled and rounds >= length:
            return row, new


def repeated(pieces: list[bytes], docs: np.ndarray, length: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the pieces, one after the other: the least document among all pieces that hold the same string; and each piece's first entry."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    shard = (np.cumsum(size) - 1) // shard_bytes
    cuts = [*np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist(), len(pieces)]
    made = [transform(pieces[a:z]) for a, z in zip(cuts, cuts[1:])]
    row, starts = merge([m[0] for m in made], np.diff(cuts).tolist(), length)
    before = np.cumsum([0, *[len(m[1]) for m in made]])
    place = np.concatenate([m[1] + at for m, at in zip(made, before)])[row]
    first = np.flatnonzero(starts)
    out = np.empty(len(place), np.int64)
    out[place] = np.repeat(np.minimum.reduceat(np.repeat(docs, size)[place], first), np.diff(np.append(first, len(place))))
    return out, np.cumsum(size) - size


# Kinds of rows that travel: pieces, lost windows, anchors that are frequent in a slice, and the pieces of these.
PIECE, LOST, FREQUENT, WHOLE = range(4)
TRAVEL = {"h": "<u4", "g": "u1", "p": "<u4", "q": "<u2", "id": "<u4", "up": "<i4", "j": "<u4", "f": "<u2", "far": "<u2", "rel": "u1", "n": "u1", "last": "<u4"}
SETTLED = {"id": "<i8", "j": "<u4", "first": "<u4", "last": "<u4", "rel": "u1", "key": "<i8"}


def schema_of(columns: dict[str, str]) -> str:
    return "task int, kind int, " + ", ".join(f"{c} binary" for c in columns)


def task_of(h: np.ndarray, tasks: int) -> np.ndarray:
    """A task for each hash, in the order of the hashes."""
    return ((h >> np.uint64(48)) * np.uint64(tasks) >> np.uint64(16)).astype(np.int32)


def doc_task(ids: np.ndarray, tasks: int) -> np.ndarray:
    return task_of(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), tasks)


def classes(h: np.ndarray, p: np.ndarray, ids: np.ndarray):
    """Rows of anchors that occur more than once, by anchor, piece and document; where classes of equal pieces and where anchors start among them."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    order = order[np.r_[False, same] | np.r_[same, False]]
    order = order[np.lexsort((ids[order], p[order], h[order]))]
    by_h = np.ones(len(order), bool)
    by_h[1:] = h[order[1:]] != h[order[:-1]]
    by_p = by_h.copy()
    by_p[1:] |= p[order[1:]] != p[order[:-1]]
    return order, by_p, by_h


def runs_of(doc: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """Runs of windows, ordered by doc and first, whose bytes touch, as one: index of each joined run's first entry, and its last window."""
    wide = np.int64(1) << np.int64(32)
    until = np.maximum.accumulate(doc * wide + last)
    new = np.flatnonzero(np.r_[True, doc[1:] * wide + first[1:] > until[:-1] + length])
    return new, until[np.r_[new[1:], len(doc)] - 1] % wide


def find(batches, length: int, tasks: int, local_pieces: int, slice_bytes: int):
    """Pieces of texts (id, j, t) as hashes, slice by slice. Of equal pieces of a slice the least document's travels; the others are lost here."""
    texts: list[tuple[int, int, np.ndarray]] = []
    seen: set[tuple[int, int]] = set()
    size = 0

    def flush():
        ids, js = np.array([t[0] for t in texts], np.int64), np.array([t[1] for t in texts], np.uint32)
        found = [anchors(t[2], length) for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(x[0]) for x in found])
        h, p, at, first, last = (np.concatenate([x[k] for x in found]) for k in range(5))
        texts.clear()
        seen.clear()
        p = p >> np.uint64(16)
        own = ids[doc]
        order, by_p, by_h = classes(h, p, own)
        stays, whole = np.ones(len(h), bool), np.zeros(len(h), bool)
        if len(order):
            least = own[order[np.flatnonzero(by_p)]][np.cumsum(by_p) - 1]
            stays[order[own[order] > least]] = False
            start = np.flatnonzero(by_h)
            many = np.add.reduceat(by_p.astype(np.int64), start) > local_pieces
            whole[order[np.repeat(many, np.diff(np.r_[start, len(order)]))]] = True
            hot = h[order[start[many]]]
            if len(hot):
                yield packed(task_of(hot, tasks), FREQUENT, TRAVEL, h=hot & np.uint64(0xFFFFFFFF), g=hot >> np.uint64(32) & np.uint64(255))
        gone = np.flatnonzero(~stays)
        if len(gone):
            gone = gone[np.lexsort((first[gone], doc[gone]))]
            new, until = runs_of(doc[gone], first[gone], last[gone], length)
            k = gone[new]
            t = doc_task(ids[doc[k]], tasks)
            o = np.argsort(t, kind="stable")
            k, until, t = k[o], until[o], t[o]
            yield packed(t, LOST, TRAVEL, id=own[k] & 0xFFFFFFFF, up=own[k] >> 32, j=js[doc[k]], f=first[k] & 0xFFFF, far=first[k] >> 16, last=until)
        for kind, some in ((PIECE, stays & ~whole), (WHOLE, stays & whole)):
            k = np.flatnonzero(some)
            t = task_of(h[k], tasks) if kind == PIECE else doc_task(own[k], tasks)
            o = np.argsort(h[k]) if kind == PIECE else np.argsort(t, kind="stable")
            k, t = k[o], t[o]
            if len(k):
                yield packed(t, kind, TRAVEL, h=h[k] & np.uint64(0xFFFFFFFF), g=h[k] >> np.uint64(32) & np.uint64(255), p=p[k] & np.uint64(0xFFFFFFFF), q=p[k] >> np.uint64(32), id=own[k] & 0xFFFFFFFF, up=own[k] >> 32, j=js[doc[k]], f=first[k] & 0xFFFF, far=first[k] >> 16, rel=at[k] - first[k], n=last[k] - first[k] + 1)

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            for i, j, t in zip(*[c.to_pylist() for c in batch.slice(start, 1024).columns]):
                if (i, j) not in seen:
                    seen.add((i, j))
                    raw = np.frombuffer(t.encode(), np.uint8)
                    texts.append((i, j, raw))
                    size += len(raw)
                    if size > slice_bytes:
                        yield from flush()
                        size = 0
    if texts:
        yield from flush()


def settle(batches, length: int, tasks: int, whole_pieces: int):
    """Of equal pieces all but the least document's are lost; pieces of anchors with unlike ones are asked for."""

    def out(kind, ids, **columns):
        t = doc_task(ids, tasks)
        o = np.argsort(t, kind="stable")
        return packed(t[o], kind, SETTLED, id=ids[o], **{c: v[o] for c, v in columns.items()})

    for b in whole_tasks(batches):
        kinds = b.column(1).to_numpy()
        for kind in (LOST, WHOLE):
            part = b.filter(pa.array(kinds == kind))
            if part.num_rows:
                v = values(part, TRAVEL)
                ids, first = v["up"].astype(np.int64) << 32 | v["id"], v["far"].astype(np.uint32) << 16 | v["f"]
                yield out(kind, ids, j=v["j"], first=first, last=v["last"] if kind == LOST else first + v["n"] - 1)
        part = b.filter(pa.array(kinds == PIECE))
        if not part.num_rows:
            continue
        v = values(part, TRAVEL)
        place = np.repeat(part.column(0).to_numpy().astype(np.uint64), v["rows"])
        h = place << np.uint64(40) | v["g"].astype(np.uint64) << np.uint64(32) | v["h"]
        p = v["q"].astype(np.uint64) << np.uint64(32) | v["p"]
        ids, first = v["up"].astype(np.int64) << 32 | v["id"], v["far"].astype(np.uint32) << 16 | v["f"]
        hot = b.filter(pa.array(kinds == FREQUENT))
        x = values(hot, TRAVEL)
        frequent = np.repeat(hot.column(0).to_numpy().astype(np.uint64), x.get("rows", np.zeros(0, np.int64))) << np.uint64(40) | x["g"].astype(np.uint64) << np.uint64(32) | x["h"]
        lone = np.flatnonzero(np.isin(h, frequent)) if len(frequent) else np.zeros(0, np.int64)
        order, by_p, by_h = classes(h, p, ids)
        if len(order):
            least = ids[order[np.flatnonzero(by_p)]][np.cumsum(by_p) - 1]
            gone = ids[order] > least
            k = order[gone]
            if len(k):
                yield out(LOST, ids[k], j=v["j"][k], first=first[k], last=first[k] + v["n"][k] - 1)
            start = np.flatnonzero(by_h)
            number = np.add.reduceat(by_p.astype(np.int64), start)
            docs = np.minimum.reduceat(ids[order], start) < np.maximum.reduceat(ids[order], start)
            size = np.diff(np.r_[start, len(order)])
            ask, whole = np.repeat((number > 1) & docs, size), np.repeat(number > whole_pieces, size)
            if len(frequent):
                whole |= np.isin(h[order], frequent)
            k = order[ask & ~whole & ~gone]
            if len(k):
                yield out(PIECE, ids[k], j=v["j"][k], first=first[k], last=first[k] + v["n"][k] - 1, rel=v["rel"][k], key=h[k].view(np.int64))
            lone = np.union1d(order[ask & whole & ~gone], np.setdiff1d(lone, order[gone])) if len(frequent) else order[ask & whole & ~gone]
        if len(lone):
            yield out(WHOLE, ids[lone], j=v["j"][lone], first=first[lone], last=first[lone] + v["n"][lone] - 1)


def per_text(batches, length: int):
    """One row for each text that loses something so far (lost: first and last windows in turn) or of which pieces are asked for."""
    for b in whole_tasks(batches):
        kinds = b.column(1).to_numpy()
        for kind in (LOST, PIECE, WHOLE):
            part = b.filter(pa.array(kinds == kind))
            if not part.num_rows:
                continue
            v = values(part, SETTLED)
            first, last = v["first"].astype(np.int64), v["last"].astype(np.int64)
            o = np.lexsort((first, v["j"], v["id"]))
            ids, js, first, last = v["id"][o], v["j"][o], first[o], last[o]
            new = np.r_[True, (ids[1:] != ids[:-1]) | (js[1:] != js[:-1])]
            if kind == LOST:
                k, until = runs_of(np.cumsum(new), first, last, length)
                ids, js, first, last = ids[k], js[k], first[k], until
                new = np.r_[True, (ids[1:] != ids[:-1]) | (js[1:] != js[:-1])]
            start = np.flatnonzero(new)
            offsets = pa.array(np.r_[start, len(ids)].astype(np.int32))
            none = pa.nulls(len(start), pa.list_(pa.int32()))
            columns = [pa.array(ids[start]), pa.array(js[start].astype(np.int64))]
            ends = pa.ListArray.from_arrays(pa.array(2 * np.r_[start, len(ids)].astype(np.int32)), pa.array(np.stack([first, last], 1).ravel().astype(np.int32)))
            if kind == PIECE:
                rel, key = pa.ListArray.from_arrays(offsets, pa.array(v["rel"][o].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(v["key"][o]))
            else:
                rel, key = none, pa.nulls(len(start), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(start), kind, np.int32)), ends, rel, key], ["id", "j", "kind", "ends", "rel", "key"])


def stretches(places: list[int]) -> list[tuple[int, int]]:
    """Neighbouring places as (first, last)."""
    at = np.sort(np.array(places))
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    return list(zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist()))


def cut(batches, length: int):
    """The pieces that are asked for, as bytes; windows of very frequent anchors by hash, the least document's of a slice, which later ones lose here."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            out: list[tuple] = []
            windows: dict[bytes, list[tuple]] = {}
            done: set[tuple] = set()
            for i, j, t, kind, ends, rel, key in zip(*[c.to_pylist() for c in batch.slice(start, 2048).columns]):
                if (i, j, kind) in done:
                    continue
                done.add((i, j, kind))
                raw = t.encode()
                if kind == PIECE:
                    out += [(k, raw[a : z + length], r, i, j, a, z) for k, r, a, z in zip(key, rel, ends[::2], ends[1::2])]
                else:
                    for a, z in zip(ends[::2], ends[1::2]):
                        for k in range(a, z + 1):
                            windows.setdefault(xxhash.xxh3_128_digest(raw[k : k + length]), []).append((i, j, k))
            lost: dict[tuple[int, int], list[int]] = {}
            for w, places in windows.items():
                least = min(p[0] for p in places)
                key = int.from_bytes(w[:8], "little", signed=True)
                own: dict[tuple[int, int], list[int]] = {}
                for i, j, k in places:
                    (own if i == least else lost).setdefault((i, j), []).append(k)
                out += [(key, w, None, i, j, a, z) for (i, j), ks in own.items() for a, z in stretches(ks)]
            for (i, j), ks in lost.items():  # need no partner any more, so they go by their text
                key = xxhash.xxh3_64_intdigest(b"%d %d" % (i, j)) - (1 << 63)
                out += [(key, None, None, i, j, a, z) for a, z in stretches(ks)]
            for k in range(0, len(out), 20_000):
                yield rows_as(out[k : k + 20_000], PIECES)


PIECES = {"key": pa.int64(), "piece": pa.binary(), "rel": pa.int32(), "id": pa.int64(), "j": pa.int64(), "first": pa.int32(), "last": pa.int32()}
LOSSES = {"id": pa.int64(), "j": pa.int64(), "first": pa.int32(), "last": pa.int32()}


def rows_as(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(columns.values())], list(columns))


def may_share(rows: list[tuple]) -> list[tuple]:
    """Pieces of one anchor that can have a window in common with another: it reaches 13 bytes behind the anchor or 13 before it."""
    sides: dict[tuple[bool, bytes], int] = {}
    own = []
    for _, piece, rel, *_ in rows:
        ends = [s for s in ((True, piece[rel + GRAM : rel + GRAM + 13]), (False, piece[max(0, rel - 13) : rel])) if len(s[1]) == 13]
        own.append(ends)
        for s in ends:
            sides[s] = sides.get(s, 0) + 1
    return [r for r, ends in zip(rows, own) if any(sides[s] > 1 for s in ends)]


def lose(batches, length: int, merge_bytes: int, shard_bytes: int):
    """(id, j, first, last): runs of windows that a smaller document has."""
    waiting: list[tuple] = []
    size = 0
    done: list[tuple] = []

    def flush():
        kinds: dict[bytes, int] = {}
        for r in waiting:
            kinds[r[1]] = min(kinds.get(r[1], r[3]), r[3])
        least, first = repeated(list(kinds), np.array(list(kinds.values())), length, shard_bytes)
        first = dict(zip(kinds, first.tolist()))
        windows = np.array([len(r[1]) - length + 1 for r in waiting])
        row = np.repeat(np.arange(len(waiting)), windows)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        lost = np.flatnonzero(least[np.array([first[r[1]] for r in waiting])[row] + inner] < np.array([r[3] for r in waiting])[row])
        if len(lost):
            r, w = row[lost], inner[lost]
            new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)))
            for k, a, z in zip(r[new].tolist(), w[new].tolist(), w[np.append(new[1:], len(w)) - 1].tolist()):
                done.append((*waiting[k][3:5], waiting[k][5] + a, waiting[k][5] + z))
        waiting.clear()

    for _, rows in groups(batches):
        done += [r[3:] for r in rows if r[1] is None]
        hashed = [r for r in rows if r[1] is not None and len(r[1]) < length]
        if len(hashed) > 1:
            least: dict[bytes, int] = {}
            for r in hashed:
                least[r[1]] = min(least.get(r[1], r[3]), r[3])
            done += [r[3:] for r in hashed if r[3] > least[r[1]]]
        rows = [r for r in rows if r[1] is not None and len(r[1]) >= length]
        if len(rows) > 1:
            rows = may_share(rows)
            waiting += rows
            size += sum(len(r[1]) + 1 for r in rows)
            if size > merge_bytes:
                flush()
                size = 0
        if len(done) > 20_000:
            yield rows_as(done, LOSSES)
            done = []
    if waiting:
        flush()
    if done:
        yield rows_as(done, LOSSES)


def strip(batches, length: int):
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            sizes, gone, spans, kept = [], [], [], []
            for t, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = t.encode()
                cover: list[tuple[int, int]] = []
                for ends in sorted(zip(found[::2], found[1::2])) if found else ():
                    a, z = ends[0], ends[1] + length
                    if cover and a <= cover[-1][1]:
                        cover[-1] = (cover[-1][0], max(z, cover[-1][1]))
                    else:
                        cover.append((a, z))
                left, at = [], 0
                for a, z in cover:
                    left.append(raw[at:a])
                    at = z
                sizes.append(len(raw))
                gone.append(sum(z - a for a, z in cover))
                spans.append([{"start": a, "end": z} for a, z in cover])
                kept.append(b"".join([*left, raw[at:]]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes of each row of docs after removal: id, n_bytes, n_removed, spans, kept (binary).

    A byte goes if a string of length bytes that covers it also starts in a row with a
    smaller id. Strings are judged on the input and don't cross rows. spans are the maximal
    removed runs (start, end) in bytes. One row comes out for each row that goes in; a null
    text is empty; a row with a null id loses nothing and takes nothing from others; rows of
    one id take nothing from each other. Ids are integers. Other columns are left out.
    """
    if not GRAM + 2 <= length <= GRAM + 200:
        raise ValueError(f"strings of {GRAM + 2} to {GRAM + 200} bytes can be found")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    tasks, doc_tasks = min(1 << 16, 8 * partitions(spark)), min(1 << 16, partitions(spark))
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    # rows of one id with different texts are told apart by j, a hash of the text; it is 0 where ids aren't repeated
    repeats = durable(plain.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias("again")))
    texts = plain.join(sent(repeats), F.col("id") == F.col("again"), "left")
    texts = texts.select("id", F.when(F.col("again").isNull(), 0).otherwise(F.xxhash64("t").bitwiseAND(0xFFFFFFFF)).cast("long").alias("j"), "t")
    known = texts.where(f"id IS NOT NULL AND octet_length(t) >= {length}").select(F.col("id").cast("long").alias("id"), "j", "t")

    travel = known.mapInArrow(lean(partial(find, length=length, tasks=tasks, local_pieces=LOCAL_PIECES, slice_bytes=SLICE_BYTES)), schema_of(TRAVEL)).repartition("task").sortWithinPartitions("task")
    settled = travel.mapInArrow(lean(partial(settle, length=length, tasks=doc_tasks, whole_pieces=WHOLE_PIECES)), schema_of(SETTLED)).repartition("task").sortWithinPartitions("task")
    facts = durable(settled.mapInArrow(lean(partial(per_text, length=length)), "id long, j long, kind int, ends array<int>, rel array<int>, key array<long>"))
    asked = known.join(facts.where(f"kind <> {LOST}"), ["id", "j"]).select("id", "j", "t", "kind", "ends", "rel", "key")
    pieces = asked.mapInArrow(lean(partial(cut, length=length)), "key long, piece binary, rel int, id long, j long, first int, last int")
    more = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(lean(partial(lose, length=length, merge_bytes=MERGE_BYTES, shard_bytes=SHARD_BYTES)), "id long, j long, first int, last int")
    more = more.select("id", "j", F.array("first", "last").alias("ends"))
    lost = facts.where(f"kind = {LOST}").select("id", "j", "ends").unionByName(more).groupBy("id", "j").agg(F.flatten(F.collect_list("ends")).alias("ends"))
    lost = durable(lost.select(F.col("id").alias("lid"), F.col("j").alias("lj"), "ends"))
    discard(facts)
    out = texts.join(lost, (F.col("id") == F.col("lid")) & (F.col("j") == F.col("lj")), "left").select("id", "t", "ends")
    named = partial(strip, length=length)
    return out.mapInArrow(lean(named), f"id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary").withColumnRenamed("id", id_col)


def digests(stripped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return stripped.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
