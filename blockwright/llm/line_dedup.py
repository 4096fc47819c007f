"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct five-word runs (with fewer words, the whole line as
one). Tokens are ordered from rare to frequent; two lines at Jaccard t share one of the
first n - ceil(t n) + 1 tokens, differ in size by the factor t at most, and can't make up
for what lies before the first shared token. Pairs that pass these prefix, length and
positional filters are verified on the whole sets, and the later line is removed.

Five words and 0.75 are the convention for near copies here. Runs keep the order of words,
so lines that say something else in the same words stay apart. What they cost: one changed
word inside a line of w words leaves (w - 9) / (w + 1) of the runs, so such lines are found
from 39 words on, and shorter ones where the change is near an end; size=1 joins the sets
of single words instead, for tables whose rare words are rare enough. On the corpora here
they aren't: the first three rarest words of lines gave 52 million candidate pairs on 0.1 GB
and 25 times as many on five times the size.

Lines with equal words are one node, so copies of a line meet no filter at all: of each
slice of texts only a node's first place travels on, the others are copies for certain.
Lines that share no token with another line leave early, as in the n-gram join; candidate
groups are joined in tasks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm.common import discard, durable, groups, lean, sent, values, whole_tasks
from blockwright.llm.shingle_join import COPY, HELD, MET, MET_ROW, NODE, PLACE, SLICE, Outgoing, as_lists, check_similarity, deal_groups, emit_grams, gram_sets, least_shared, meeting_groups, prefix_size, settle_nodes, tasks_of, travelled


def lines_in(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def later_matches(sets: list[list[int]], num: int, den: int) -> list[int]:
    """Indexes of the sets that some set before them matches. Sets come in the order of their lines."""
    often: dict[int, int] = {}
    for s in sets:
        for x in s:
            often[x] = often.get(x, 0) + 1
    index: dict[int, list[tuple[int, int]]] = {}
    ordered, found = [], []
    for j, s in enumerate(sets):
        own = sorted(s, key=lambda x: (often[x], x))
        n, whole, tried, hit = len(own), set(own), set(), False
        p = prefix_size(n, num, den)
        for at, x in enumerate(own[:p]):
            for i, spot in index.get(x, ()):
                m = len(ordered[i])
                if i in tried or den * min(n, m) < num * max(n, m):
                    continue
                if (num + den) * min(n - at, m - spot) < num * (n + m):  # nothing before their first common token is common
                    continue
                tried.add(i)
                both = len(whole.intersection(ordered[i]))
                if den * both >= num * (n + m - both):
                    hit = True
                    break
            if hit:
                found.append(j)
                break
        ordered.append(own)
        for at, x in enumerate(own[:p]):
            index.setdefault(x, []).append((j, at))
    return found


def dedup_lines(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs without the lines that an earlier line matches: all columns, the text replaced, and with counts n_lines, n_removed.

    Lines are what stands between line feeds; "earlier" goes by id, then place in the text.
    Matches are judged on the input: a removed line still removes later ones. Lines without
    words stay. A-Z count as lower case. One row comes out for each row that goes in, with a
    text that may be empty; a null text stays null and has no lines. Rows of one id and one
    text are one text and lose the same lines; other rows of one id come in the order of a
    hash of the text; null ids come last. Ids are integers. Columns of docs may have any name
    but those with two underscores in front.
    """
    check_similarity(num, den)
    if counts and {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError("docs has a column of the result")
    tasks = tasks_of(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("t"))

    def emit(batches):
        """N-grams and nodes of the lines of a slice of texts, and each node's first place there; its other places are copies."""
        sending = Outgoing(tasks)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, marks, t = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                split = [lines_in(x) for x in t]
                number = {u: k for k, u in enumerate({u for lines in split for u in lines})}
                units = list(number)
                known: dict[bytes, int] = {}
                node = np.zeros(len(units), np.int64)
                for part in range(0, len(units), 1 << 16):
                    keys = emit_grams(units[part : part + (1 << 16)], size, sending)
                    node[part : part + len(keys)] = [-1 if k is None else known.setdefault(k, len(known)) for k in keys]
                if not known:
                    continue
                count = np.fromiter(map(len, split), np.int64, len(split))
                of = node[np.fromiter((number[u] for lines in split for u in lines), np.int64, int(count.sum()))]
                row = np.repeat(np.arange(len(split)), count)[of >= 0]
                line = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))[of >= 0]
                of = of[of >= 0]
                lo, hi = np.frombuffer(b"".join(known), "<i8").reshape(-1, 2).T
                none = np.array([i is None for i in ids])
                place = {"lo": lo[of], "hi": hi[of], "none": none[row], "id": np.array([i or 0 for i in ids], np.int64)[row], "mark": np.array(marks, np.int64)[row], "line": line}
                first_places(place, of, sending)
                if sending.full():
                    yield from sending.rows()
        yield from sending.rows()

    def decide(batches):
        """Lines that are copies of an earlier one, and the first lines of nodes that can be in a pair."""
        for b in whole_tasks(batches):
            kinds = b.column(1).to_numpy()
            nodes, held, places, copies = (values(b.filter(pa.array(kinds == k)), MET) for k in (NODE, HELD, PLACE, COPY))
            if len(nodes["lo"]):
                _, _, n, total = settle_nodes(nodes, held)
                order = np.lexsort((places["line"], places["mark"], places["id"], places["none"], places["hi"], places["lo"]))
                p = {c: places[c][order] for c in ("lo", "hi", "none", "id", "mark", "line")}
                first = ~same_as_before(p, ("lo", "hi"))  # nodes and first places have one order
                yield out(p, first, n, total)
                yield out(p, ~first & ~same_as_before(p, ("lo", "hi", "none", "id", "mark", "line")))
            if len(copies["mark"]):
                yield out(copies, slice(None))

    def out(p, some, n=None, held=None):
        ids = pa.array(p["id"][some], mask=p["none"][some].astype(bool))
        size = len(ids)
        return pa.RecordBatch.from_arrays([ids, pa.array(p["mark"][some]), pa.array(p["line"][some].astype(np.int32)), *[pa.nulls(size, pa.int64()) if x is None else pa.array(x) for x in (n, held)]], ["id", "mark", "line", "n", "held"])

    found = travelled(texts.mapInArrow(lean(emit), MET_ROW)).mapInArrow(lean(decide), "id long, mark long, line int, n long, held long")
    found = durable(found.where(F.col("n").isNull() | (F.col("held") >= least_shared())))
    nodes = durable(found.where("n IS NOT NULL").select(F.monotonically_increasing_id().alias("node"), "id", "mark", "line"))

    def sets_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                units, rows = [], []
                for i, mark, t, wanted in zip(*[c.to_pylist() for c in batch.slice(at, SLICE).columns]):
                    split = lines_in(t)
                    rows += [(w["node"], i, mark, w["line"]) for w in wanted]
                    units += [split[w["line"]] for w in wanted]
                for k in range(0, len(units), 1 << 16):
                    _, n, h = gram_sets(units[k : k + (1 << 16)], size)
                    own = [pa.array([r[j] for r in rows[k : k + (1 << 16)]], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int32)), as_lists(n, h)], ["node", "id", "mark", "line", "n", "s"])

    per_text = nodes.groupBy("id", "mark").agg(F.collect_list(F.struct("node", "line")).alias("wanted")).withColumnsRenamed({"id": "wid", "mark": "wmark"})
    same = F.col("id").eqNullSafe(F.col("wid")) & (F.col("mark") == F.col("wmark"))
    per_text = durable(per_text)
    wanted = texts.where("t IS NOT NULL").join(sent(per_text), same).select("id", "mark", "t", "wanted")
    sets = durable(wanted.mapInArrow(lean(sets_of), "node long, id long, mark long, line int, n int, s array<long>"))
    if sets.count() > nodes.count():  # repeated rows
        sets = durable(sets.dropDuplicates(["node"]))
    group = meeting_groups(sets.select("node", "n", "s"), num, den)

    def match(batches):
        for _, rows in groups(batches):
            rows.sort(key=lambda r: (r[3] is None, r[3] if r[3] is not None else 0, r[4], r[5]))
            matched = later_matches([r[2].tolist() for r in rows], num, den)
            if matched:
                yield rows_of([rows[j][3:6] for j in matched])

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["id", "mark", "line"])

    later = deal_groups(sets.select("node", "s", "id", "mark", "line", "n"), group).mapInArrow(lean(match), "id long, mark long, line int")
    gone = found.where("n IS NULL").select("id", "mark", "line").unionByName(later)
    gone = durable(gone.groupBy("id", "mark").agg(F.collect_set("line").alias("__drop")).withColumnsRenamed({"id": "__id", "mark": "__mark"}))
    discard(found, nodes, per_text, sets, group)
    here = (F.col("__own").eqNullSafe(F.col("__id"))) & (F.col("__text") == F.col("__mark"))
    out_rows = docs.withColumns({"__own": F.col(id_col).cast("long"), "__text": F.xxhash64(text_col)}).join(gone, here, "left")
    rest = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains("__drop", i))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", rest))
    feeds = F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit("")))
    own = [F.coalesce(feeds + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    return out_rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *own)


def same_as_before(place: dict[str, np.ndarray], columns: tuple[str, ...]) -> np.ndarray:
    return np.r_[False, np.logical_and.reduce([place[c][1:] == place[c][:-1] for c in columns])][: len(place["id"])]


def first_places(place: dict[str, np.ndarray], node: np.ndarray, sending: Outgoing) -> None:
    """Send the first place of each node as a PLACE, the others as copies; repeated rows have one place."""
    order = np.lexsort((place["line"], place["mark"], place["id"], place["none"], node))
    place = {c: v[order] for c, v in place.items()} | {"node": node[order]}
    first = ~same_as_before(place, ("node",))
    other = ~first & ~same_as_before(place, ("node", "none", "id", "mark", "line"))
    sending.add(PLACE, place["lo"][first], **{c: place[c][first] for c in ("lo", "hi", "none", "id", "mark", "line")})
    sending.add(COPY, place["mark"][other], **{c: place[c][other] for c in ("none", "id", "mark", "line")})


def digests(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return cleaned.select(id_col, "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
