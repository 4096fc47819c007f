"""Exact token counts at every prefix of a text.

Byte-level BPE splits a text into pieces by a fixed pattern and merges inside each
piece only. Inside a piece a dynamic program walks the bytes: the last token of the
encoding of a prefix is the one vocabulary entry that ends there and may follow the
last token of the prefix before it. Its count is that prefix's count plus one, so one
walk gives the exact count at every byte. Piece counts add up over the text, which
answers "how many tokens", "how many tokens up to here" and "how far does a budget
reach" without encoding again.
"""

from __future__ import annotations

import functools
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from blockwright.llm.common import lean

#: Entries that a worker remembers, and characters of one that is worth it; beyond them pieces are computed each time.
MOST_REMEMBERED, LONG = 400_000, 64
MOST_STATES = 1_200_000
FOREVER = 1 << 60
# The piece pattern of this vocabulary file and two white spaces that touch.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = regex.compile(r" ?(\p{L}+|\p{N}+)")
TOUCHING = re.compile(r"\s \s|  ")
BEYOND_LATIN = re.compile("[^\\x00-\u024f]")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("pieces are cut by the byte-level pattern without a normalizer; this file has another")
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        vocab = {raw(t) for t in spec["model"]["vocab"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.rank:
            self.made.setdefault(a + b, (a, b))
        self.tokens = {t for t in vocab if len(t) == 1 or t in self.made}
        #: Every end of an entry, and whether it is an entry itself: walked from a byte backwards, the tree of reversed entries.
        self.tails = {t[k:]: t[k:] in self.tokens for t in self.tokens for k in range(len(t))}
        self.library = Tokenizer.from_file(path)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.chains: tuple[dict, dict] = ({}, {})
        self.known: dict[str, int] = {}
        self.states: dict[bytes, tuple[int, bytes]] = {}

    def edges(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """Parts that stand at one edge of a token while it is built, last part first, each with the rank of the merge that uses it up."""
        chain = self.chains[right].get(token)
        if chain is None:
            chain, part, until = [], token, FOREVER
            while part in self.made:
                chain.append((part, until))
                until = self.rank[self.made[part]]
                part = self.made[part][right]
            chain.append((part, until))
            self.chains[right][token] = chain
        return chain

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """True if merging a + b leaves the two tokens as they are.

        A merge over the border happens when a part at the right edge of a and one at
        the left edge of b stand side by side and their own merge ranks before those
        that use them up; of equal merges the left one goes first.
        """
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            ok, rank = True, self.rank
            left, right = self.edges(a, True), self.edges(b, False)
            i, j = len(left) - 1, len(right) - 1
            while True:
                (p, until_p), (q, until_q) = left[i], right[j]
                r = rank.get((p, q), FOREVER)
                if r < until_p and r <= until_q and r != FOREVER:
                    ok = False
                    break
                if until_p == until_q == FOREVER:
                    break
                if until_p <= until_q:
                    i -= 1
                else:
                    j -= 1
            if len(self.fits) > MOST_REMEMBERED:
                self.fits.clear()
            self.fits[key] = ok
        return ok

    def ending(self, piece: bytes, end: int) -> list[bytes]:
        """The entries that end at a byte of a piece, the longest first. Only ends of entries are walked, whatever script the piece has."""
        tails, found = self.tails, []
        for start in range(end - 1, -1, -1):
            is_token = tails.get(part := piece[start:end])
            if is_token is None:
                break
            if is_token:
                found.append(part)
        found.reverse()
        return found

    def state(self, piece: bytes) -> tuple[int, bytes]:
        """Count and last token of the encoding of one piece.

        Both belong to the bytes so far and not to what follows, so pieces share the
        states of their common beginnings.
        """
        states = self.states
        known = states.get(piece)
        if known is not None:
            return known
        n = len(piece)
        have = min(n - 1, 23)
        while have and piece[:have] not in states:
            have -= 1
        known = states[piece[:have]] if have else (0, b"")
        row = {have: known}
        for end in range(have + 1, n + 1):
            for token in self.ending(piece, end):
                start = end - len(token)
                before = row.get(start) or (states[piece[:start]] if start and piece[:start] in states else self.state(piece[:start]) if start else (0, b""))
                if not start or self.may_follow(before[1], token):
                    known = row[end] = before[0] + 1, token
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            if end < 24 and len(states) < MOST_STATES:
                states[piece[:end]] = known
        return known

    def inside(self, piece: bytes) -> list[int]:
        """Counts at the bytes 1..n of one piece, in one walk."""
        row, states = [(0, b"")], self.states
        for end in range(1, len(piece) + 1):
            known = states.get(piece[:end]) if end < 24 else None
            for token in self.ending(piece, end) if known is None else ():
                start = end - len(token)
                if not start or self.may_follow(row[start][1], token):
                    known = row[start][0] + 1, token
                    break
            row.append(known)
        return [n for n, _ in row[1:]]

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        return self.state(text.encode())[0]

    def cut(self, text: str) -> list[str]:
        """Pieces of a text without special strings. Beyond Latin letters the library itself cuts: it knows its own Unicode version."""
        if BEYOND_LATIN.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return PIECE.findall(text)

    def parts(self, text: str) -> list[str]:
        """The text between special strings and these strings themselves."""
        return [p for p in self.special_split.split(text) if p] if self.special_split and "<|" in text else [text] if text else []

    def prefix(self, text: str) -> tuple[list[int], list[int]]:
        """Ends in bytes and running counts, one pair for each byte end that starts or goes on in a token."""
        ends, counts, at, total = [], [], 0, 0
        for part in self.parts(text):
            if part in self.special:
                at, total = at + len(part.encode()), total + 1
                ends.append(at)
                counts.append(total)
                continue
            for piece in map(str.encode, self.cut(part)):
                for i, c in enumerate(self.inside(piece), 1):
                    ends.append(at + i)
                    counts.append(total + c)
                at, total = at + len(piece), counts[-1]
        return ends, counts

    def budget(self, text: str, limit: int) -> int:
        """Characters of the longest prefix that has at most limit tokens, cut between pieces or inside one of letters or digits."""
        chars, total = 0, 0
        for part in self.parts(text):
            for piece in [part] if part in self.special else self.cut(part):
                n = 1 if part in self.special else self.piece(piece)
                if total + n > limit:
                    if part not in self.special and PLAIN.fullmatch(piece):  # the first bytes of such a piece are a piece as well
                        counts = self.inside(piece.encode())
                        ends = [len(c.encode()) for c in piece]
                        at = sum(ends)
                        for k in range(len(piece) - 1, int(piece[0] == " "), -1):
                            at -= ends[k]
                            if total + counts[at - 1] <= limit:
                                return chars + k
                    return chars
                chars, total = chars + len(piece), total + n
        return chars

    def chunk(self, text: str) -> int:
        """Tokens of a run of pieces; remembered."""
        n = self.known.get(text)
        if n is None:
            n = sum(map(self.piece, self.cut(text)))
            if len(self.known) < MOST_REMEMBERED and len(text) <= LONG:
                self.known[text] = n
        return n

    def running(self, text: str) -> list[int]:
        """Tokens of the chunks of a text, in order. A chunk starts at each single space: no piece goes on past one."""
        out: list[int] = []
        known, chunk = self.known, self.chunk
        for part in self.parts(text):
            if part in self.special:
                out.append(1)
            elif TOUCHING.search(part):
                out += [chunk(p) for p in self.cut(part)]
            else:
                first, *rest = part.split(" ")
                out.append(chunk(first))
                for word in rest:
                    word = " " + word
                    n = known.get(word)
                    out.append(chunk(word) if n is None else n)
        return out


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, exact tokens, and whether the limit is passed, for each row of docs.

    path: a byte-level BPE file in the form of the tokenizers library. One row comes out
    for each row that goes in, whatever its id: null ids and repeated rows stay, a null or
    empty text has no bytes and no tokens, other columns are left out. No shuffle.
    """

    def count(batches):
        pc = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [sum(pc.running(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(count), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
