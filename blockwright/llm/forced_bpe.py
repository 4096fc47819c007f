"""BPE encoding by forced boundaries, and decoding.

A pair of neighbouring symbols that occurs inside no vocabulary entry can never end up
in one token, so a cut between them is certain. Each word is cut at all such pairs, the
fragments are encoded on their own by the merge list, and their ids are concatenated.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockwright.llm.common import lean
from blockwright.llm.prefix_counts import BEYOND_LATIN, byte_letters

# Fixed value: the word pattern of this vocabulary file.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words and fragments that a worker remembers, and the symbols of a fragment that is worth it: some 80 MB at most.
MOST_WORDS, MOST_FRAGMENTS, LONG = 300_000, 60_000, 64
#: Marks the last byte of a word: symbols 0-255 are bytes, 256-511 bytes that end a word.
LAST = 256


def normalize(text: str) -> str:
    """NFC and lower case of a text in Latin letters."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


class ForcedBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, end = byte_letters(), spec["model"]["end_of_word_suffix"]

        def symbols(token: str) -> tuple[int, ...]:
            body = token.removesuffix(end)
            out = [letters[c] for c in body]
            return (*out[:-1], out[-1] + LAST) if len(body) < len(token) else tuple(out)

        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id = {symbols(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(symbols(a), symbols(b)): r for r, (a, b) in enumerate(pairs)}
        self.inside = np.zeros((256, 512), bool)
        for token in self.id:
            for a, b in zip(token, token[1:]):
                self.inside[a, b] = True
        self.joined = [set(np.flatnonzero(row).tolist()) for row in self.inside]
        self.special = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.library = Tokenizer.from_file(path)
        self.letters = letters
        self.text = {i: t for t, i in (spec["model"]["vocab"] | added).items()}
        self.fragments: dict[tuple[int, ...], list[int]] = {}
        self.known: dict[str, bytes] = {}

    def fragment(self, parts: tuple[int, ...]) -> list[int]:
        ids = self.fragments.get(parts)
        if ids is None:
            ids = [self.id[t] for t in self.merged(parts)]
            if len(self.fragments) < MOST_FRAGMENTS and len(parts) <= LONG:
                self.fragments[parts] = ids
        return ids

    def merged(self, parts: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Tokens of a fragment: the pair of the lowest rank is merged, the leftmost first. A heap holds the pairs, so that long fragments take n log n."""
        n, rank = len(parts), self.rank
        tokens: list[tuple[int, ...] | None] = [(s,) for s in parts]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            k = after[i]
            if tokens[i] is None or k == n or rank.get((tokens[i], tokens[k])) != r:  # merged meanwhile
                continue
            tokens[i], tokens[k] = tokens[i] + tokens[k], None
            after[i] = m = after[k]
            if m < n:
                before[m] = i
                if (r := rank.get((tokens[i], tokens[m]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (a := before[i]) >= 0 and (r := rank.get((tokens[a], tokens[i]))) is not None:
                heapq.heappush(heap, (r, a))
        return [t for t in tokens if t is not None]

    def words(self, text: str) -> list[bytes]:
        """Beyond Latin letters the library itself tells words apart: it knows its own Unicode version."""
        if BEYOND_LATIN.search(text):
            return [bytes(self.letters[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return [w.encode() for w in WORD.findall(text)]

    def cut(self, word: bytes) -> list[tuple[int, ...]]:
        """The fragments between forced boundaries."""
        raw = list(word)
        raw[-1] += LAST
        out, start = [], 0
        for i in range(1, len(raw)):
            if raw[i] not in self.joined[raw[i - 1]]:
                out.append(tuple(raw[start:i]))
                start = i
        return [*out, tuple(raw[start:])]

    def decode(self, ids: list[int]) -> str:
        """As a vocabulary without a decoder is read: the entries, with spaces between."""
        return " ".join(map(self.text.__getitem__, ids))

    def chunk(self, text: str) -> bytes:
        """The ids, as little-endian 32-bit integers, of what stands between two spaces."""
        found = self.known.get(text)
        if found is None:
            found = array("I", [i for w in self.words(text) for f in self.cut(w) for i in self.fragment(f)]).tobytes()
            if len(self.known) < MOST_WORDS and len(text) <= LONG:
                self.known[text] = found
        return found

    def encode(self, text: str) -> tuple[int, bytes, str]:
        """Number of ids, the ids, and their text."""
        chunks: list[bytes] = []
        known, chunk = self.known, self.chunk
        for part in self.split.split(text) if "<|" in text else [text]:
            if part in self.special:
                chunks.append(array("I", [self.special[part]]).tobytes())
            elif part:
                plain = self.library.normalizer.normalize_str(part) if BEYOND_LATIN.search(part) else normalize(part)
                chunks += [known.get(c) or chunk(c) for c in plain.split(" ")]
        ids = b"".join(chunks)
        return len(ids) // 4, ids, self.decode(np.frombuffer(ids, "<u4").tolist())


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBpe:
    return ForcedBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of each row: id, n_tokens, ids (binary, little-endian unsigned 32-bit integers), decoded.

    path: a BPE file with a word-end suffix, in the form of the tokenizers library. One
    row comes out for each row that goes in: null ids and repeated rows stay, a null or
    empty text has no ids and decodes to an empty text, other columns are left out. Rows
    pass in slices of bounded size; there is no shuffle.
    """

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [bpe.encode(t) if t else (0, b"", "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.string())],
                    [id_col, "n_tokens", "ids", "decoded"],
                )
        encoder.cache_clear()  # the worker goes on to other tasks, whose memory this would be

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
