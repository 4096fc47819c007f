"""N-gram Jaccard self-join over prefix trees.

Sets of hashed word n-grams are joined at a Jaccard similarity of t in four steps, none
of which brings all pairs of a group together:

1. Texts with equal words are one node. A pair at t >= 0.75 has n-grams in common among
   the first of both sets in any order (see first_part, least_shared); here long ones come
   first. Nodes that have too few of their first n-grams in common with others are done.
2. For those nodes n-grams are ordered from rare to frequent over all of them, and the
   same prefix rule gives the n-grams on which nodes can meet. Nodes that meet, directly
   or over others, form a candidate group.
3. Each group's sets go into a prefix tree, frequent n-grams first, so that common
   beginnings are counted once for all sets below them. Each set walks towards the sets
   that have an n-gram of its prefix; a subtree is left when what remains of both sides
   can't reach the overlap needed. Groups with many n-grams are dealt as pairs of blocks of
   bounded size.
4. The links found join nodes into components.

N-grams are compared by their length and 56 bits of hash: two different ones of one length
and one pair of texts fall together with a chance of some 2**-56.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwright.llm.common import ASCII_LOWER, connected_components, discard, durable, groups, lean, packed, partitions, sent, values, whole_tasks

#: N-grams of the sets that one task holds at a time; larger candidate groups are dealt as pairs of blocks.
GROUP_TOKENS = 3_000_000
#: Rows whose texts are in memory at a time.
SLICE = 512


class WordHashes:
    """64-bit hashes of byte strings that lie one behind the other: polynomials modulo 2**64 over random values of the bytes."""

    base = 6364136223846793005

    def __init__(self):
        self.value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(raw) + 1
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, self.base, np.uint64)))
            self.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, pow(self.base, -1, 1 << 64), np.uint64)))
        total = np.zeros(n, np.uint64)
        np.cumsum(self.value[raw] * self.up[: n - 1], out=total[1:])
        return (total[end] - total[start]) * self.down[start]


HASHES = WordHashes()
#: Odd numbers that tell the places of an n-gram apart.
PLACES = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 65)]


def gram_sets(units: list[bytes], size: int) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Key of each unit's word sequence, number of its distinct n-grams, and these, unit by unit, in ascending order.

    A-Z count as lower case. A unit without words has no key and no n-grams; one with fewer
    words than size has the whole sequence as one. An n-gram is 8 bits that fall with its
    length in bytes and 56 bits of hash: in this order long n-grams come first, which are
    rarely frequent ones.
    """
    if len(units) > 1 << 16:
        raise ValueError("units are numbered by 16 bits")
    split = [u.translate(ASCII_LOWER).split() for u in units]
    keys = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in split]
    count = np.fromiter(map(len, split), np.int64, len(split))
    flat = list(chain.from_iterable(split))
    size_of = np.fromiter(map(len, flat), np.int64, len(flat))
    end = np.cumsum(size_of + 1)
    word = HASHES.of(np.frombuffer(b" ".join(flat), np.uint8), end - 1 - size_of, end - 1)
    if not len(word):
        return keys, np.zeros(len(units), np.int64), np.zeros(0, np.uint64)
    unit = np.repeat(np.arange(len(units), dtype=np.uint16), count)
    first = np.cumsum(count) - count
    # an n-gram starts wherever its unit goes on for size words, and at the start of shorter units
    at = np.flatnonzero(np.append(unit[size - 1 :] == unit[: 1 - size or None], np.zeros(min(size - 1, len(unit)), bool))[: len(unit)])
    short = np.flatnonzero((count > 0) & (count < size))
    h = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        h += word[k : k + len(h)] * PLACES[k]
    h = h[at]
    long = end[at + size - 1] - end[at] + size_of[at]
    own = unit[at]
    if len(short):
        whole = [(word[first[u] : first[u] + count[u]] * np.array(PLACES[: count[u]])).sum() for u in short]
        h, own = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([own, short.astype(np.uint16)])
        long = np.concatenate([long, [sum(map(len, split[u])) + count[u] - 1 for u in short]])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h = (np.uint64(255) - np.minimum(long, 255).astype(np.uint64)) << np.uint64(56) | h >> np.uint64(8)
    order = np.argsort(h)
    order = order[np.argsort(own[order], kind="stable")]
    h, own = h[order], own[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])][: len(h)]
    return keys, np.bincount(own[new], minlength=len(units)), h[new]


def shingles(text: str | None, size: int) -> tuple[bytes, np.ndarray]:
    """Key and distinct n-grams of one text; none without words."""
    keys, _, h = gram_sets([(text or "").encode()], size)
    return keys[0] or b"", h


def head_of(n: np.ndarray, h: np.ndarray, most) -> np.ndarray:
    """For each entry of h, whether it is one of its unit's first most(n)."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    return place < np.repeat(most(n), n)


def word_key(text: str | None) -> bytes | None:
    words = (text or "").encode().translate(ASCII_LOWER).split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def prefix_size(n: int, num: int, den: int) -> int:
    """How many of n n-grams, in any common order, can't all be missing from a set that is similar enough."""
    return n - -(-num * n // den) + 1


def as_lists(n: np.ndarray, h: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(h.view(np.int64)))


class PrefixTree:
    """Sorted integer sets as a compressed tree in preorder."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.parent: list[int] = []
        self.start, self.end, self.depth = [], [], []  # a node's run in flat, and the n-grams from the root to its end
        self.here: list[list[int]] = []  # sets that end at a node
        flat, size, todo = [], 0, [(0, len(order), 0, -1)]
        while todo:
            lo, hi, depth, above = todo.pop()
            first, last = sets[order[lo]], sets[order[hi - 1]]
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            common = depth + int(differ[0]) if len(differ) else m
            node = above
            if common > depth:
                node = len(self.parent)
                self.parent.append(above)
                flat.append(first[depth:common])
                self.start.append(size)
                size += common - depth
                self.end.append(size)
                self.depth.append(common)
                self.here.append([])
                while lo < hi and len(sets[order[lo]]) == common:
                    self.here[node].append(order[lo])
                    lo += 1
            below = []
            while lo < hi:
                token, to = sets[order[lo]][common], lo + 1
                while to < hi and sets[order[to]][common] == token:
                    to += 1
                below.append((lo, to, common, node))
                lo = to
            todo += reversed(below)
        self.flat = np.concatenate(flat)
        n = len(self.parent)
        self.low, self.high, self.until = [1 << 60] * n, [0] * n, list(range(1, n + 1))  # sizes below a node, and the first node behind its subtree
        for k in reversed(range(n)):
            if self.here[k]:
                self.low[k], self.high[k] = min(self.low[k], self.depth[k]), max(self.high[k], self.depth[k])
            if (p := self.parent[k]) >= 0:
                self.low[p], self.high[p], self.until[p] = min(self.low[p], self.low[k]), max(self.high[p], self.high[k]), max(self.until[p], self.until[k])

        self.leaf = [0] * len(sets)
        for k, own in enumerate(self.here):
            for i in own:
                self.leaf[i] = k


class Walk:
    """One set's walk through the tree: what a node's run has in common with the set is counted once, for all sets below it."""

    def __init__(self, tree: PrefixTree, num: int, den: int):
        self.tree, self.num, self.den = tree, num, den
        self.seen, self.overlap = [-1] * len(tree.parent), [0] * len(tree.parent)
        self.entered = 0

    def begin(self, i: int, s: np.ndarray, member: np.ndarray) -> None:
        self.i, self.own, self.member = i, s.tolist(), member

    def similar(self, j: int) -> bool:
        """Whether den * overlap >= num * union of the set and set j. A node whose subtree can't reach that is left for good."""
        t, path, k = self.tree, [], self.tree.leaf[j]
        leaf = k
        while k >= 0 and self.seen[k] != self.i:
            path.append(k)
            k = t.parent[k]
        got = self.overlap[k] if k >= 0 else 0
        n = len(self.own)
        for k in reversed(path):
            self.seen[k] = self.i
            if got >= 0:
                self.entered += 1
                got += int(np.count_nonzero(self.member[t.flat[t.start[k] : t.end[k]]]))
                left = n - bisect_right(self.own, int(t.flat[t.end[k] - 1]))
                if (self.num + self.den) * (got + min(t.high[k] - t.depth[k], left)) < self.num * (n + t.low[k]):
                    got = -1
            self.overlap[k] = got
        return got >= 0 and self.den * got >= self.num * (n + t.depth[leaf] - got)


def tree_links(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the first set of its component under the links among these sets.

    A set is held against those before it that have one of its prefix's n-grams, rare ones
    first, and aren't in its component yet; what they share is counted along the tree.
    """
    kinds, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code)
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((kinds, -often))] = np.arange(len(kinds))
    size = np.array([len(s) for s in sets])
    coded = [np.sort(c) for c in np.split(rank[code], np.cumsum(size)[:-1])]
    prefix = [c[::-1][: prefix_size(len(c), num, den)] for c in coded]
    # who has an n-gram in the prefix, in the order of the sets, and how many of them have had their turn
    flat = np.concatenate(prefix)
    whose = np.repeat(np.arange(len(sets)), [len(p) for p in prefix])[np.argsort(flat, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(flat, minlength=len(kinds)))]
    turn = first[:-1].copy()
    walk, member = Walk(PrefixTree(coded), num, den), np.zeros(len(kinds), bool)
    root, tried = np.arange(len(sets)), np.full(len(sets), -1)
    for i, s in enumerate(coded):
        member[s] = True
        walk.begin(i, s, member)
        for x in prefix[i]:
            others = whose[first[x] : turn[x]]
            others = others[(root[others] != root[i]) & (tried[others] != i)]
            for j in others.tolist():
                if root[j] == root[i]:
                    continue
                tried[j] = i
                if den * min(size[i], size[j]) >= num * max(size[i], size[j]) and walk.similar(j):
                    a, b = sorted((root[i], root[j]))
                    root[root == b] = a
        member[s] = False
        turn[prefix[i]] += 1
    return root.tolist()


def first_part(n):
    """N-grams, in their order, by which nodes are first compared: a prefix and a twelfth."""
    return np.minimum(n, prefix_size(n, 75, 100) + n // 12)


def least_shared() -> Column:
    """How many n-grams of its first part another node's first part has too, if a node is in any pair at 0.75 or more.

    At most n - o n-grams of a set are missing from the other, with o >= 3 (n + m) / 7 of
    both in common. Up to the smaller of the two ends, the set that ends there has its
    part less (n - o) common ones; the tests count out that over all m in [3n/4, 4n/3] this
    is at least the part less a prefix.
    """
    p = "(n - ceil(75 * n / 100) + 1)"
    return F.expr(f"greatest(1, least(n, {p} + n div 12) - {p})")


# Kinds of rows that travel: n-grams of one node of a slice, n-grams of several, how many frequent n-grams a node holds, nodes, and where nodes stand.
GRAM, SEVERAL, HELD, NODE, PLACE, COPY = range(6)
MET = {"h": "<u4", "g": "u1", "lo": "<i8", "hi": "<i8", "n": "<u4", "held": "<u4", "none": "u1", "id": "<i8", "mark": "<i8", "line": "<u4"}
MET_ROW = "task int, kind int, " + ", ".join(f"{c} binary" for c in MET)
#: Values that a travelling row should have on average, and values that wait for that at most.
ROW_VALUES, MOST_WAITING = 64, 1_000_000
#: N-grams of a task that are compared at a time.
GRAMS_AT_ONCE = 250_000


def task_of(h: np.ndarray, tasks: int) -> np.ndarray:
    """A task for each hash, in the order of the hashes as unsigned numbers."""
    return ((h.view(np.uint64) >> np.uint64(48)) * np.uint64(tasks) >> np.uint64(16)).astype(np.int32)


def by_task(kind: int, h: np.ndarray, tasks: int, **columns: np.ndarray) -> pa.RecordBatch:
    t = task_of(h, tasks)
    o = np.argsort(t, kind="stable")
    return packed(t[o], kind, MET, **{c: v[o] for c, v in columns.items()})


class Outgoing:
    """What slices send to tasks. It waits until there is enough for all tasks: rows grow with what is sent, not with slices times tasks."""

    def __init__(self, tasks: int):
        self.tasks, self.size = tasks, 0
        self.waiting: dict[int, list[tuple[np.ndarray, dict[str, np.ndarray]]]] = {}

    def add(self, kind: int, by: np.ndarray, /, **columns: np.ndarray) -> None:
        """by: hashes by which the tasks go."""
        if len(by):
            self.waiting.setdefault(kind, []).append((task_of(by, self.tasks), {c: v.astype(MET[c]) for c, v in columns.items()}))
            self.size += len(by)

    def full(self) -> bool:
        return self.size >= min(ROW_VALUES * self.tasks, MOST_WAITING)

    def rows(self):
        """A row for each task and kind."""
        for kind, parts in self.waiting.items():
            t = np.concatenate([x[0] for x in parts])
            o = np.argsort(t, kind="stable")
            yield packed(t[o], kind, MET, **{c: np.concatenate([x[1][c] for x in parts])[o] for c in parts[0][1]})
        self.waiting, self.size = {}, 0


def mixed(h: np.ndarray) -> np.ndarray:
    """n-grams have their length in the high bits; tasks go by evenly spread ones."""
    return h * np.uint64(0x9E3779B97F4A7C15)


def emit_grams(units: list[bytes], size: int, out: Outgoing) -> list[bytes | None]:
    """Send the first part of each unit's n-grams, and the nodes; the units' keys."""
    keys, n, h = gram_sets(units, size)
    seen: set[bytes | None] = {None}
    new = np.array([not (k in seen or seen.add(k)) for k in keys], bool)  # units that differ in white space or case only are one node
    if new.any():
        take = np.repeat(new, n) & head_of(n, h, first_part)
        own = np.repeat(np.cumsum(new) - 1, n)[take]
        h, n = mixed(h[take]), n[new]
        lo, hi = np.frombuffer(b"".join([k for k, x in zip(keys, new) if x]), "<i8").reshape(-1, 2).T
        order = np.argsort(h)
        h, own = h[order], own[order]
        same = np.r_[False, h[1:] == h[:-1]]
        many = same | np.r_[same[1:], False]
        for kind, some in ((GRAM, ~many), (SEVERAL, many & ~same)):
            x = h[some]
            more = {"lo": lo[own[some]]} if kind == GRAM else {}
            out.add(kind, x, h=x & np.uint64(0xFFFFFFFF), g=x >> np.uint64(32) & np.uint64(255), **more)
        out.add(NODE, lo, lo=lo, hi=hi, n=n, held=np.bincount(own[many], minlength=len(n)))
    return keys


def count_shared(batches, tasks: int):
    """For each node how many of its n-grams other nodes have too; all else passes."""
    for b in whole_tasks(batches):
        kinds = b.column(1).to_numpy()
        for kind in (NODE, PLACE, COPY):
            part = b.filter(pa.array(kinds == kind))
            if part.num_rows:
                v = values(part, MET)
                v = {c: x for c, x in v.items() if c in MET and len(x)}
                yield by_task(kind, v["lo"] if kind != COPY else v["mark"], tasks, **v)
        part, hot = (b.filter(pa.array(kinds == kind)) for kind in (GRAM, SEVERAL))
        if not part.num_rows:
            continue
        grams, others = values(part, MET), values(hot, MET)
        place, hot_place = (np.repeat(some.column(0).to_numpy(), v.get("rows", np.zeros(0, np.int64))) for some, v in ((part, grams), (hot, others)))
        slots = np.uint32(1 + len(place) // GRAMS_AT_ONCE)
        held = []
        for slot in range(slots):
            at, hot_at = (np.flatnonzero(v["h"] % slots == slot) for v in (grams, others))
            h, hot_h = (p[k].astype(np.uint64) << np.uint64(40) | v["g"][k].astype(np.uint64) << np.uint64(32) | v["h"][k] for p, v, k in ((place, grams, at), (hot_place, others, hot_at)))
            if not len(h):
                continue
            order = np.argsort(h)
            g, lo = h[order], grams["lo"][at[order]]
            new = np.r_[True, g[1:] != g[:-1]]
            start = np.flatnonzero(new)
            shared = np.minimum.reduceat(lo, start) < np.maximum.reduceat(lo, start)
            if len(hot_h):
                shared |= np.isin(g[start], hot_h)
            held.append(lo[shared[np.cumsum(new) - 1]])
        lo, n = np.unique(np.concatenate(held), return_counts=True)
        if len(lo):
            yield by_task(HELD, lo, tasks, lo=lo, held=n)


def settle_nodes(part: dict[str, np.ndarray], held: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """lo, hi, n, held of each node, by lo and hi."""
    order = np.lexsort((part["hi"], part["lo"]))
    lo, hi = part["lo"][order], part["hi"][order]
    start = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    total = np.add.reduceat(part["held"][order].astype(np.int64), start)
    lo, hi, n = lo[start], hi[start], part["n"][order][start].astype(np.int64)
    if len(held["lo"]):
        kinds, code = np.unique(held["lo"], return_inverse=True)
        more = np.bincount(code, held["held"]).astype(np.int64)
        at = np.minimum(np.searchsorted(kinds, lo), len(kinds) - 1)
        total += np.where(kinds[at] == lo, more[at], 0)
    return lo, hi, n, total


def tasks_of(df: DataFrame) -> int:
    return min(1 << 16, partitions(df.sparkSession))


def travelled(rows: DataFrame) -> DataFrame:
    """Rows of emit_grams() after both shuffles: by n-gram, then by node. A task is a partition."""
    tasks = tasks_of(rows)
    met = rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("task").mapInArrow(lean(lambda batches: count_shared(batches, tasks)), MET_ROW)
    return met.repartitionById(tasks, F.col("task")).sortWithinPartitions("task")


def meeting(texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(lo, hi, n, maybe): the nodes of texts (t), and whether they can be in a pair. lo and hi are the key's halves.

    N-grams that several nodes of a slice have are counted there and go on as one, so a
    frequent n-gram makes an entry for each slice, not for each node. They travel by 40
    bits of hash and their task: what falls together can only keep a node that might go.
    """
    check_similarity(num, den)
    tasks = tasks_of(texts)

    def emit(batches):
        out = Outgoing(tasks)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                emit_grams(list({(t or "").encode() for t in batch.column(0).slice(at, SLICE).to_pylist()}), size, out)
                if out.full():
                    yield from out.rows()
        yield from out.rows()

    def decide(batches):
        for b in whole_tasks(batches):
            kinds = b.column(1).to_numpy()
            nodes, held = (b.filter(pa.array(kinds == kind)) for kind in (NODE, HELD))
            if nodes.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in settle_nodes(values(nodes, MET), values(held, MET))], ["lo", "hi", "n", "held"])

    found = travelled(texts.select("t").mapInArrow(lean(emit), MET_ROW)).mapInArrow(lean(decide), "lo long, hi long, n long, held long")
    return durable(found.select("lo", "hi", "n", (F.col("held") >= least_shared()).alias("maybe")))


def check_similarity(num: int, den: int) -> None:
    if 100 * num < 75 * den:
        raise ValueError("the first comparison is made for similarities of 0.75 or more")


def meeting_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component): nodes of sets (node, n, s) that meet on n-grams of their prefixes, rare n-grams first, directly or over others."""
    grams = sets.select("node", "n", F.explode("s").alias("h"))
    often = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    per_node = Window.partitionBy("node")
    ranked = grams.join(often, "h").select("node", "n", "h", F.row_number().over(per_node.orderBy("df", "h")).alias("r"), F.count("*").over(per_node).alias("m"))
    # n-grams of one node only come first in the order, so the prefix has that many fewer of the others
    head = durable(ranked.where(F.expr(f"r <= n - ceil({num} * n / {den}) + 1 - (n - m)")).select("node", "h"))
    hub = head.groupBy("h").agg(F.min("node").alias("hub"))
    out = connected_components(head.join(hub, "h").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    discard(head)
    return out


def deal_groups(sets: DataFrame, group: DataFrame) -> DataFrame:
    """sets with a column task: one for each group, or one for each pair of blocks of a group with many n-grams. Sorted by task inside partitions."""
    members = sets.join(group.withColumnRenamed("component", "group"), "node")
    wide = members.groupBy("group").agg(F.ceil(2 * F.sum("n") / GROUP_TOKENS).cast("int").alias("blocks")).where("blocks > 2")
    dealt = members.join(wide, "group", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).otherwise(0))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit("-"))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.concat_ws("-", F.least(x, "own"), F.greatest(x, "own"))))
    dealt = dealt.select("group", F.explode(pairs).alias("pair"), *sets.columns).select(F.concat_ws(":", "group", "pair").alias("task"), *sets.columns)
    return dealt.repartition("task").sortWithinPartitions("task")


def shingle_components(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of n-grams and component of each row of docs: id, n_shingles, component_id.

    Two rows link when den * intersection >= num * union of their sets of distinct word
    n-grams (with fewer words, the whole sequence as one); component_id is the smallest id
    reachable by links, the row's own included. One row comes out for each row that goes
    in: repeated rows stay; a null text or one without words has no n-grams and its own id
    as component; a row with a null id has a null component and links with nothing. Other
    columns are left out.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    nodes = meeting(texts.where("id IS NOT NULL"), size, num, den)

    def sizes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(shingles(t, size)[1]) for t in b.column(1).to_pylist()], pa.int64())], ["id", "n"])

    def keys_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                keys = [word_key(t) for t in b.column(1).to_pylist()]
                lo, hi = np.frombuffer(b"".join(k or b"\0" * 16 for k in keys), "<i8").reshape(-1, 2).T
                none = np.array([k is None for k in keys], bool)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lo, mask=none), pa.array(hi, mask=none)], ["id", "lo", "hi"])

    keyed = durable(texts.mapInArrow(lean(keys_of), f"id {kind}, lo long, hi long"))
    first = durable(keyed.where("id IS NOT NULL AND lo IS NOT NULL").groupBy("lo", "hi").agg(F.min("id").alias("first")))
    reps = nodes.where("maybe").select("lo", "hi").join(first, ["lo", "hi"]).select(F.monotonically_increasing_id().alias("node"), "lo", "hi", F.col("first").alias("id"))
    reps = durable(reps)

    def full_sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                node, lo, hi, t = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                keys, n, h = gram_sets([x.encode() for x in t], size)
                own = np.array([k == struct.pack("<qq", a, b) for k, a, b in zip(keys, lo, hi)], bool)  # else another row of a repeated id
                yield pa.RecordBatch.from_arrays([pa.array(np.array(node)[own], pa.int64()), as_lists(n[own], h[np.repeat(own, n)])], ["node", "s"])

    sets = texts.where("id IS NOT NULL").join(sent(reps), "id").select("node", "lo", "hi", "t").mapInArrow(lean(full_sets), "node long, s array<long>")
    sets = durable(sets.withColumn("n", F.size("s")))
    if sets.count() > reps.count():  # repeated rows
        sets = durable(sets.dropDuplicates(["node"]))
    group = meeting_groups(sets, num, den)

    def join_groups(batches):
        for _, rows in groups(batches):
            found = tree_links([r[2].view(np.uint64) for r in rows], num, den) if len(rows) > 1 else []
            links = [(r[1], rows[f][1]) for r, f in zip(rows, found) if rows[f][1] != r[1]]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    links = deal_groups(sets.select("node", "s", "n"), group).mapInArrow(lean(join_groups), "a long, b long")
    component = connected_components(links)

    joined = reps.select("lo", "hi", "node", "id").join(component, "node")
    least = joined.groupBy("component").agg(F.min("id").alias("least"))
    moved = joined.join(least, "component").select("lo", "hi", "least")
    place = nodes.select("lo", "hi", "n").join(first, ["lo", "hi"]).join(moved, ["lo", "hi"], "left").select("lo", "hi", "n", F.coalesce("least", "first").alias("least"))
    out = keyed.join(durable(place), ["lo", "hi"], "left")
    discard(nodes, first, reps, sets, group, component)
    if docs.where(F.col(id_col).isNull()).limit(1).count():  # they link with nothing and were left out above
        lone = texts.where("id IS NULL").mapInArrow(lean(sizes_of), f"id {kind}, n long").select("id", "n", F.lit(None).cast(kind).alias("least"))
        out = out.where("id IS NOT NULL").select("id", "n", "least").unionByName(lone)
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
