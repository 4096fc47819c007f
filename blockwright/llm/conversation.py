"""Conversation structure repair by generalised LR parsing.

The role grammar allows an optional system turn and then pairs of user and assistant turns.
Its LR automaton runs over all repairs of a conversation at once: the stacks that the edits
lead to are nodes of one graph, which share what lies below them, and edits that lead to the
same stack top are merged, the cheapest and then the ASCII-least audit staying. Equal costs
over the same rows never belong to two audits of which one begins the other, so merging
early gives the ASCII-least whole audit.

Spark sorts the rows by range of (conversation, turn), so a long conversation lies in many
tasks. A conversation that lies in one task, in one piece of bounded size, is repaired
there. The others are cut into pieces; each piece gives its cheapest edits from each stack to
each stack, these are joined along the conversation, and then every piece is rebuilt on its
own. Only the digest of a whole conversation needs its text in order: it passes as a stream.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blockwright.llm.common import durable, lean, partitions, sent

#: The role grammar over initials. S is the start; as P recurs on the left, stacks stay short.
GRAMMAR = (("S", ""), ("S", "sP"), ("S", "P"), ("P", "Pua"), ("P", "ua"))
#: Costs of the edits; an undeleted truncated row costs TRUNCATED more. Rerole and insert give these roles.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
GIVEN = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\f\r"
#: Rows and characters of a piece, at most (one longer row makes its own); repetitions of one row in one step.
PIECE_ROWS, PIECE_CHARS, TIMES = 256, 1 << 20, 1 << 16


def lr_states(rules):
    """Item sets of the LR(0) automaton, and where each symbol leads from each."""

    def closure(items):
        items, size = set(items), -1
        while len(items) != size:
            size = len(items)
            wanted = {rules[r][1][dot] for r, dot in items if dot < len(rules[r][1])}
            items |= {(r, 0) for r, (left, _) in enumerate(rules) if left in wanted}
        return frozenset(items)

    states, goto = [closure({(r, 0) for r, (left, _) in enumerate(rules) if left == "S"})], {}
    for k, state in enumerate(states):  # grows meanwhile
        for symbol in sorted({rules[r][1][dot] for r, dot in state if dot < len(rules[r][1])}):
            new = closure({(r, dot + 1) for r, dot in state if rules[r][1][dot : dot + 1] == symbol})
            if new not in states:
                states.append(new)
            goto[k, symbol] = states.index(new)
    return states, goto


class StackGraph:
    """The graph-structured stack: nodes (state, node below), each kept once. shift: for each node, where a role's initial leads after all reductions; accepts: whether a conversation may end there."""

    def __init__(self, rules=GRAMMAR):
        states, goto = lr_states(rules)
        done = [[rules[r] for r, dot in sorted(s) if dot == len(rules[r][1])] for s in states]
        nodes, number = [(0, -1)], {(0, -1): 0}

        def push(below, symbol):
            state = goto.get((nodes[below][0], symbol))
            if state is None:
                return None
            at = number.setdefault((state, below), len(nodes))
            if at == len(nodes):
                nodes.append((state, below))
            for left, right in done[state]:
                if left != "S":
                    for _ in right:
                        at = nodes[at][1]
                    return push(at, left)
            return at

        self.shift: list[dict[str, int]] = []
        while len(self.shift) < len(nodes):
            at = len(self.shift)
            self.shift.append({t: to for t in "sua" if (to := push(at, t)) is not None})
        #: The nodes that are stack tops between rows; others only stand while they are reduced.
        self.tops = sorted({0, *(to for after in self.shift for to in after.values())})
        self.accepts = [any(left == "S" for left, _ in done[state]) for state, _ in nodes]
        self.moves: dict[tuple, list] = {}

    def of_row(self, initial: str, must_go: bool, truncated: bool):
        """For each node: (next node, cost, letter) of what may be done with such a row."""
        key = initial if initial in GIVEN or initial == "s" else "", must_go, truncated
        if key not in self.moves:
            more = TRUNCATED * truncated
            self.moves[key] = [
                [(node, DELETE, "D")] + ([] if must_go else [(to[r], REROLE + more, "R") for r in GIVEN if r in to] + [(to[r], KEEP + more, "K") for r in key[0] if r in to])
                for node, to in enumerate(self.shift)
            ]
        return self.moves[key]

    def inserted(self, front: dict) -> dict:
        """Stack tops that are reached by inserting turns."""
        out, grown = dict(front), list(front)
        while grown:
            node = grown.pop()
            cost, audit = out[node]
            for r in GIVEN:
                to = self.shift[node].get(r)
                if to is not None and (to not in out or (cost + INSERT, audit + "I") < out[to]):
                    out[to] = cost + INSERT, audit + "I"
                    grown.append(to)
        return out

    def parse(self, units, start: int = 0) -> dict:
        """The cheapest (cost, audit) for each stack top after the rows, from a stack on."""
        front = {start: (0, "")}
        for role, _, must_go, truncated, times in units:
            moves, after = self.of_row(role[:1], must_go, truncated), {}
            for node, (cost, audit) in self.inserted(front).items():
                for to, more, letter in moves[node]:
                    new = cost + more * times, audit + letter * times
                    if to not in after or new < after[to]:
                        after[to] = new
            front = after
        return front

    def end(self, front: dict) -> tuple[int, str, int]:
        """Cheapest end: (cost, audit, node)."""
        return min((*best, node) for node, best in self.inserted(front).items() if self.accepts[node])

    def rebuilt(self, units, audit: str, node: int = 0) -> list[tuple[str, str]]:
        """(role, text) of what an audit leaves of rows, from a stack on."""
        out, letters = [], iter(audit)
        rows = (u[:2] for u in units for _ in range(u[4]))

        def given() -> tuple[str, int]:
            return next((GIVEN[r], to) for r, to in self.shift[node].items() if r in GIVEN)

        for letter in letters:
            if letter == "I":
                role, node = given()
                out.append((role, ""))
                continue
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role, node = given()
            else:
                node = self.shift[node][role[:1]]
            out.append((role, text))
        return out


GRAPH = StackGraph()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of rows whose crc32 of "conv_id:turn", modulo 20, says what happens to them: 0 drops a row (copies 0), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 gives it the role user. Nulls count as one space there; null turns stay null."""
    what = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), what.alias("what"))
    role = F.when(F.col("what") == 0, "").when(F.col("what") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("what") <= 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, blank, known, truncated: each different row once. known: an earlier turn has the role and text. Equal rows are counted before they travel, and so are first turns, so a text that is everywhere gathers nowhere."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    core = F.expr("rtrim({}, text)".format("concat(' ', " + ", ".join(f"char({ord(c)})" for c in WHITE[1:]) + ")"))
    rows = rows.withColumn("core", F.right(core, F.lit(1)))
    rows = rows.select("conv_id", "turn", "role", "text", "copies", (F.col("core") == "").alias("blank"), (~F.col("core").isin("", ".", "!", "?")).alias("truncated"), F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("sha"))
    rows = durable(rows)
    at = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    several = rows.where("copies > 0").groupBy("conv_id", "sha").agg(F.min(at).alias("at"), F.count("*").alias("k")).where("k > 1")
    several = durable(several.select(F.col("conv_id").alias("__conv"), F.col("sha").alias("__sha"), F.col("at.turn").alias("__turn")))
    met = rows.join(sent(several), F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("sha") == F.col("__sha")), "left")
    known = F.col("__sha").isNotNull() & ~F.col("turn").eqNullSafe(F.col("__turn"))
    return met.select("conv_id", "turn", "role", "text", "copies", "blank", known.alias("known"), "truncated")


STATS = ("gap_low", "gap_high", "turns", "blank", "duplicate", "truncated", "illegal")
PIECE = (
    "part int, no long, gap_low long, gap_high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "cost long, audit string, repaired binary, roles array<string>, texts array<string>, must array<boolean>, cut array<boolean>, times array<int>, costs array<long>, audits array<string>"
)


class Piece:
    """Neighbouring rows of a conversation, and what is counted over them."""

    def __init__(self):
        self.units, self.chars = [], 0
        self.low = self.high = self.head = self.tail = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def full(self, most_rows: int) -> bool:
        return len(self.units) >= most_rows or self.chars >= PIECE_CHARS

    def add(self, turn, role, text, fault: str | None, times: int) -> None:
        """fault: the name of the counter of the row's first fault."""
        if fault:
            setattr(self, fault, getattr(self, fault) + times)
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        self.illegal += times - 1 + (self.tail is not None and self.tail + initial not in ("su", "ua", "au"))
        self.head, self.tail = initial if self.head is None else self.head, initial
        self.units.append((role, "" if fault in ("blank", "duplicate") else text, fault in ("blank", "duplicate"), fault == "truncated", times))
        self.chars += len(text) + times

    def row(self, part: int, no: int) -> dict:
        return {"part": part, "no": no, "gap_low": self.low, "gap_high": self.high, "head": self.head, "tail": self.tail} | {k: getattr(self, k) for k in ("turns", "blank", "duplicate", "truncated", "illegal")}

    def closed(self) -> dict:
        cost, audit, _ = GRAPH.end(GRAPH.parse(self.units))
        return {"cost": cost, "audit": audit, "repaired": joined(GRAPH.rebuilt(self.units, audit))}

    def open(self) -> dict:
        """The rows, and the cheapest edits from each stack to each."""
        ways, n = [GRAPH.parse(self.units, start) for start in GRAPH.tops], GRAPH.tops
        columns = zip(*self.units) if self.units else [[]] * 5
        return dict(zip(("roles", "texts", "must", "cut", "times"), map(list, columns))) | {"costs": [w[to][0] if to in w else -1 for w in ways for to in n], "audits": [w[to][1] if to in w else "" for w in ways for to in n]}


def joined(turns) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode(errors="surrogatepass")


def pieces_of(rows, most_rows: int):
    """Cut the sorted rows of one conversation; without rows one empty piece."""
    piece = Piece()
    for _, turn, role, text, copies, blank, known, truncated in rows:
        fault = "blank" if blank else "duplicate" if known else "truncated" if truncated else None
        steps = [(fault, 1)] if copies and not (blank or known) else []
        rest = copies - len(steps)
        for fault, times in itertools.chain(steps, (("blank" if blank else "duplicate", min(TIMES, rest - k)) for k in range(0, rest, TIMES))):
            if piece.full(most_rows):
                yield piece
                piece = Piece()
            piece.add(turn, role, text, fault, times)
    yield piece


def tuples(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def in_batches(rows, schema, most: int = 64):
    """Dictionaries as Arrow batches of a few rows, as a row may be a megabyte."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def cut_and_repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows of judged() in pieces: repaired ones (cost, audit, repaired) where a conversation is one piece inside one task, and open ones (rows, costs, audits) of all others."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    columns = f"conv_id {kind}, {PIECE}"
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches):
        part = TaskContext.get().partitionId()

        def found():
            no, waiting = itertools.count(), None
            for k, (conv, own) in enumerate(itertools.groupby(tuples(batches), key=lambda r: r[0])):
                if waiting:
                    yield {"conv_id": waiting[0], **waiting[1].row(part, next(no)), **waiting[1].closed()}
                    waiting = None
                own = pieces_of(own, piece_rows)
                head = list(itertools.islice(own, 2))
                if k and len(head) == 1:
                    waiting = conv, head[0]  # unless it goes on in the next task
                    continue
                for piece in itertools.chain(head, own):
                    yield {"conv_id": conv, **piece.row(part, next(no)), **piece.open()}
            if waiting:
                yield {"conv_id": waiting[0], **waiting[1].row(part, next(no)), **waiting[1].open()}

        yield from in_batches(found(), schema)

    n = partitions(rows.sparkSession)
    keys = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(lean(run), columns)


def ways(open_pieces: DataFrame) -> DataFrame:
    """part, no, start, audit, cost: the stack and the edits of each open piece in the cheapest repair of its conversation; last pieces include what is inserted behind them. Of a conversation's pieces only costs and audits come to one task, as a stream."""

    def chosen(rows):
        tops = GRAPH.tops
        front, back, places = {0: (0, "")}, [], []
        for _, part, no, costs, audits in rows:
            after, came = {}, {}
            for node, (cost, audit) in front.items():
                own = tops.index(node) * len(tops)
                for to, more, letters in zip(tops, costs[own : own + len(tops)], audits[own : own + len(tops)]):
                    new = cost + more, audit + letters
                    if more >= 0 and (to not in after or new < after[to]):
                        after[to], came[to] = new, (node, more, letters)
            shared, whole = 0, [a for _, a in after.values()]
            while all(len(a) > shared and a[shared] == whole[0][shared] for a in whole):
                shared += 1
            front = {node: (cost, audit[shared:]) for node, (cost, audit) in after.items()}  # what all share can't tell them apart any more
            back.append(came)
            places.append((part, no))
        cost, audit, node = min((*best, node) for node, best in GRAPH.inserted(front).items() if GRAPH.accepts[node])
        for ending in sorted(front):  # the stack before what is inserted at the end
            own = {ending: front[ending]}
            if GRAPH.inserted(own).get(node) == (cost, audit):
                break
        behind, out = audit[len(front[ending][1]) :], []
        for (part, no), came in zip(reversed(places), reversed(back)):
            ending, more, letters = came[ending]
            out.append({"part": part, "no": no, "start": ending, "way": letters + behind, "way_cost": more + INSERT * len(behind)})
            behind = ""
        return out

    def run(batches):
        for _, rows in itertools.groupby(tuples(batches), key=lambda r: r[0]):
            yield from in_batches(chosen(rows), schema, 4096)

    columns = "part int, no long, start int, way string, way_cost long"
    schema = to_arrow_schema(StructType.fromDDL(columns))
    heads = open_pieces.select("conv_id", "part", "no", "costs", "audits")
    return heads.repartition(partitions(heads.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(lean(run), columns)


def repair_pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The general operator: conv_id, part, no (order of the pieces), counts, cost, audit and repaired (UTF-8 of "role:text" lines) of each piece of each conversation.

    rows: conv_id, turn, role, text, copies, as damaged() gives them; rows of copies 0 only
    name their conversation. Turns of one number are ordered by role and text.
    """
    pieces = durable(cut_and_repair(judged(rows), piece_rows))
    open_pieces = pieces.where("repaired IS NULL")
    kept = ("conv_id", "part", "no", *STATS, "head", "tail", "cost", "audit", "repaired")
    closed = pieces.where("repaired IS NOT NULL").select(*kept)
    best = durable(ways(open_pieces))
    met = open_pieces.select("conv_id", "part", "no", *STATS, "head", "tail", "roles", "texts", "must", "cut", "times").join(sent(best), ["part", "no"])
    columns = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*kept[1:]).schema)
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches):
        def found():
            for *given, roles, texts, must, cut, times, start, way, cost in tuples(batches):
                turns = GRAPH.rebuilt(list(zip(roles, texts, must, cut, times)), way, start)
                yield dict(zip(kept, given)) | {"cost": cost, "audit": way, "repaired": joined(turns)}

        yield from in_batches(found(), schema)

    rebuilt = met.select("conv_id", "part", "no", *STATS, "head", "tail", "roles", "texts", "must", "cut", "times", "start", "way", "way_cost").mapInArrow(lean(run), columns)
    return closed.unionByName(rebuilt)


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Pieces pass in order as a stream."""
    columns = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def whole(conv, rows):
        total, audit, sha, empty = dict.fromkeys((*STATS[2:], "cost"), 0), [], hashlib.sha256(), True
        low = high = tail = None
        for _, _, _, first, last, turns, blank, duplicate, truncated, illegal, head, end, cost, letters, text in rows:
            for k, v in zip((*STATS[2:], "cost"), (turns, blank, duplicate, truncated, illegal, cost)):
                total[k] += v
            total["turns"] -= first is not None and first == high
            total["illegal"] += tail is not None and head is not None and tail + head not in ("su", "ua", "au")
            low, high, tail = first if low is None else low, high if last is None else last, tail if end is None else end
            audit.append(letters)
            if text:
                sha.update(text if empty else b"\n" + text)
                empty = False
        gaps = 0 if low is None else high - low + 1 - total.pop("turns")
        total.pop("turns", None)
        return {"conv_id": conv, "gaps": gaps, **total, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    def run(batches):
        yield from in_batches((whole(conv, rows) for conv, rows in itertools.groupby(tuples(batches), key=lambda r: r[0])), schema, 1024)

    rows = pieces.select("conv_id", "part", "no", *STATS, "head", "tail", "cost", "audit", "repaired")
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(lean(run), columns)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """What is wrong with each conversation of a table (conv_id, turn, role, text) after damaged(), and its cheapest repair.

    One row for each conversation, null ids being one of their own. Null roles and texts
    are one space, null turns come first and leave no gaps; repeated rows are duplicates;
    an empty role has no initial and can't be kept; an empty table gives no rows; other columns are left alone.
    """
    return digests(repair_pieces(damaged(rows)))


def sql() -> str:
    """The same in DuckDB: one row of every conversation at a time, four stacks in the columns."""

    def edit(front: str, letter: str, cost: str, turn: str = "''") -> str:
        return f"{{c: {front}.c + {cost}, a: {front}.a || '{letter}', t: {front}.t || {turn}}}"

    def text(role: str, own: str) -> str:
        return f"chr(10) || {role} || ':' || {own}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def reached(start: tuple[str, ...], initial: str) -> list[str]:
        keep = [f"CASE WHEN NOT must AND left(role, 1) = '{initial}' THEN {edit(f, 'K', 'more', text('role', 'text'))} END" for f in start]
        give = [f"CASE WHEN NOT must THEN {edit(f, 'R', '1 + more', text(chr(39) + GIVEN[initial] + chr(39), 'text'))} END" for f in start if initial in GIVEN]
        return keep + give

    user, assistant = (text(f"'{r}'", "''") for r in ("user", "assistant"))
    insert_user = least("f2", edit("f0", "I", "5", user), edit("f1", "I", "5", user), edit("f3", "I", "5", user))
    return f"""
WITH RECURSIVE bits AS (
    SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tbl
    FROM (SELECT range::BIGINT AS b FROM range(256))
), coded AS (
    SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT) AS bytes FROM conversations
), hashed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS what FROM coded, bits
), names AS (
    SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)
), damaged AS (
    SELECT conv, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE what WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed h JOIN names n ON h.conv_id IS NOT DISTINCT FROM n.conv_id WHERE what <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS k, regexp_replace(text, '[ \t\n\x0b\f\r]+$', '') AS core FROM damaged
), judged AS (
    SELECT *, core = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 AS seen, right(core, 1) NOT IN ('.', '!', '?') AS ends_open,
        lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) || left(role, 1) AS pair FROM placed
), facts AS (
    SELECT conv, k, role, text, turn, pair, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND ends_open AS truncated, blank OR seen AS must, CASE WHEN NOT blank AND NOT seen AND ends_open THEN 5 ELSE 0 END AS more FROM judged
), counted AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
        count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM facts GROUP BY conv
), stacks(conv, k, f0, f1, f2, f3) AS (
    SELECT conv, 0::BIGINT, {{c: 0::BIGINT, a: '', t: ''}}, {{c: 1000000000::BIGINT, a: '', t: ''}}, {{c: 1000000000::BIGINT, a: '', t: ''}}, {{c: 1000000000::BIGINT, a: '', t: ''}} FROM names
    UNION ALL
    SELECT conv, k, {edit("f0", "D", "2")}, {least(edit("f1", "D", "2"), *reached(("f0",), "s"))},
        {least(edit("f2", "D", "2"), *reached(("f0", "f1", "f3"), "u"))}, {least(edit("f3", "D", "2"), *reached(("f2",), "a"))}
    FROM (
        SELECT facts.*, f0, f1, f2, {least("f3", edit("f2", "I", "5", assistant))} AS f3
        FROM (SELECT conv, k, f0, f1, {insert_user} AS f2, f3 FROM stacks) s JOIN facts ON facts.conv = s.conv AND facts.k = s.k + 1
    )
), ended AS (
    SELECT conv, k, {least("f0", "f3", edit("f2", "I", "5", assistant))} AS best FROM (SELECT conv, k, f0, f3, {insert_user} AS f2 FROM stacks)
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM names JOIN ended ON names.conv = ended.conv LEFT JOIN counted ON names.conv = counted.conv WHERE ended.k = coalesce(size, 0)
"""
