"""Secrets in texts and in what their texts encode.

A worklist holds layers: the text itself, then what URL escapes, Unicode escapes and
look-alike letters, base64 runs and compressed streams in it say, then what is encoded in
those, until nothing new turns up. Every layer is scanned by the same patterns, and each of
its bytes knows the code points of the text that it comes from. A layer that has been seen
for the same place is not unwrapped again, so streams that unpack to themselves end.
"""

from __future__ import annotations

import binascii
import bz2
import functools
import hashlib
import lzma
import re
import sys
import unicodedata
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm.common import lean

try:
    import zstandard
except ImportError:  # then such streams stay closed
    zstandard = None

# The kinds of secrets in order, their patterns, the group that is measured, its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
ORDER = {kind: k for k, kind in enumerate(KINDS)}
#: A match of these is cheap to rule out: what the pattern needs, in lower case.
NEEDS = {"assign": (b"passw", b"secret", b"token", b"api"), "access": (b"akia",), "hex": ()}
#: The least encoded form of a secret: 12 bytes, so 16 base64 letters.
LEAST_BYTES, LEAST_LETTERS = 12, 16
#: Bytes of all layers of one text; what is beyond is counted as unread, never dropped silently.
MOST_BYTES = 64 << 20
#: Bytes that a decompressor gets at a time.
FED_BYTES = 1 << 12
#: First bytes by which a stream is known again where layers overlap: a line of wrapped base64 has the start of what all lines have.
MARK_BYTES = 32


class Layer(NamedTuple):
    """Bytes, and where each of them starts and ends in the text, in code points. how: the ways it was unwrapped, from the outside. stream: where the stream starts that it was packed in, and its first bytes."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    how: tuple[str, ...] = ()
    stream: tuple[int, bytes] | None = None

    def key(self) -> bytes:
        return hashlib.blake2b(self.data, digest_size=16).digest() + self.start[:1].tobytes() + self.end[-1:].tobytes()


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    how: tuple[str, ...]
    value: str


def patterns(of_bytes: bool):
    # Runs are maximal, so a least length inside the pattern of the plain ones finds the same.
    plain = {k: p.replace("+", f"{{{least - 4 if k == 'access' else least},}}") if group == 0 else p for k, (p, group, least) in KINDS.items()}
    return {k: re.compile(p.encode()) if of_bytes else re.compile(p, re.ASCII) for k, p in plain.items()}


IN_TEXT, IN_BYTES = patterns(False), patterns(True)
URL = re.compile(rb"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(rb"""\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\|%)u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|&\#[xX]([0-9A-Fa-f]{1,6});|&\#([0-9]{1,7});|\\x([0-9A-Fa-f]{2})|\\(["'/\\])""")
RUN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
WRAPPED = re.compile(rb"(?:[A-Za-z0-9+/_-]{60,76}\r?\n)+[A-Za-z0-9+/_-]+")
#: Twelve letters of UTF-8: less can't be a secret or lead to one, and chance seldom makes as many.
WORTH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
STREAM = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
STANDARD = bytes.maketrans(b"-_", b"+/")


@functools.cache
def look_alikes() -> tuple[re.Pattern, dict[str, str]]:
    """Letters beyond ASCII whose compatibility form is ASCII, and characters without width, which have none."""
    table = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        form = "" if unicodedata.category(c) == "Cf" else unicodedata.normalize("NFKC", c)
        if form.isascii():
            table[c] = form
    spans: list[list[int]] = []
    for code in map(ord, table):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]"), table


def first_layer(text: str) -> Layer:
    data = text.encode("utf-8", "surrogatepass")
    at = np.arange(len(data)) if len(data) == len(text) else np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return Layer(data, at, at + 1)


def replaced(layer: Layer, how: str, new: list[tuple[int, int, bytes]]) -> Layer:
    """With some ranges of bytes saying something else."""
    first, behind = (np.array([r[k] for r in new]) for k in (0, 1))
    sizes = np.array([len(what) for *_, what in new])
    gone = np.zeros(len(layer.data) + 1, np.int64)
    np.add.at(gone, first, 1)
    np.add.at(gone, behind, -1)
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    order = np.argsort(np.concatenate([kept, np.repeat(first, sizes)]), kind="stable")
    said = np.frombuffer(b"".join(what for *_, what in new), np.uint8)
    data = np.concatenate([np.frombuffer(layer.data, np.uint8)[kept], said])[order].tobytes()
    start = np.concatenate([layer.start[kept], np.repeat(layer.start[first], sizes)])[order]
    end = np.concatenate([layer.end[kept], np.repeat(layer.end[behind - 1], sizes)])[order]
    return Layer(data, start, end, (*layer.how, how))


def of_escape(m: re.Match) -> bytes:
    if m[7]:
        return m[7]
    if m[6]:
        return bytes([int(m[6], 16)])
    code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
    return chr(code).encode("utf-8", "surrogatepass") if code <= sys.maxunicode else m[0]


def unescaped(layer: Layer):
    if b"%" in layer.data and (new := [(m.start(), m.end(), bytes([int(m[0][1:], 16)])) for m in URL.finditer(layer.data)]):
        yield replaced(layer, "url", new)
    if (b"\\" in layer.data or b"&#" in layer.data or b"%u" in layer.data) and (new := [(m.start(), m.end(), of_escape(m)) for m in ESCAPE.finditer(layer.data)]):
        yield replaced(layer, "unicode", new)
    if not layer.data.isascii():
        wanted, form = look_alikes()
        text = layer.data.decode("utf-8", "surrogateescape")
        if wanted.search(text):
            sizes = np.fromiter((len(c.encode("utf-8", "surrogateescape")) for c in text), np.int64, len(text))
            at = np.cumsum(sizes) - sizes
            yield replaced(layer, "unicode", [(int(at[m.start()]), int(at[m.start()] + sizes[m.start()]), form[m[0]].encode()) for m in wanted.finditer(text)])


def from_base64(layer: Layer):
    """What runs of base64 letters say, from each of the four places in a group of letters: the run may begin before the code does."""
    runs = [np.arange(*m.span()) for m in RUN.finditer(layer.data)]
    if b"\n" in layer.data:
        for m in WRAPPED.finditer(layer.data):
            own = np.arange(*m.span())
            runs.append(own[~np.isin(np.frombuffer(m[0], np.uint8), (10, 13))])
    data = np.frombuffer(layer.data, np.uint8)
    for at in runs:
        letters = data[at].tobytes().translate(STANDARD)
        for shift in range(4):
            code = letters[shift:]
            code = code[: len(code) - (len(code) % 4 == 1)]
            said = binascii.a2b_base64(code + b"=" * (-len(code) % 4))
            if len(said) >= LEAST_BYTES and (WORTH.search(said) or STREAM.search(said)):
                k = np.arange(len(said))
                yield Layer(said, layer.start[at[shift + 4 * k // 3]], layer.end[at[shift + (8 * k + 7) // 6]], (*layer.how, "base64"))
                if shift == 0 and said.isascii() and WORTH.fullmatch(said):
                    break


def unpacked(data: memoryview, most: int) -> tuple[bytes, int, bool] | None:
    """What a compressed stream at the start of data says, how long the stream is, and whether that is all of it; None where there is none.

    A stream that is cut short or damaged says what it has before that, and that it isn't all.
    Two bytes that may begin a zlib stream are often there by chance: where nothing comes of
    them there is none. Longer marks are those of a stream, even if nothing of it can be read.
    """
    kind, said = data[:1].tobytes(), bytearray()
    if kind == b"\x28" and zstandard is None:
        return b"", len(data), False
    try:
        if kind == b"\x28":
            box = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(read_across_frames=False)
        else:
            box = bz2.BZ2Decompressor() if kind == b"B" else lzma.LZMADecompressor() if kind == b"\xfd" else zlib.decompressobj(47)
        for at in range(0, len(data), FED_BYTES):  # little at a time: what lies behind a stream is copied
            part = data[at : at + FED_BYTES]
            said += box.decompress(part) if kind == b"\x28" else box.decompress(part, most + 1 - len(said))
            if box.eof or len(said) > most:
                return bytes(said[:most]), at + len(part) - len(box.unused_data), len(said) <= most
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, *([zstandard.ZstdError] if zstandard else [])):
        pass
    return None if kind == b"x" and not said else (bytes(said[:most]), len(data), False)


def decompressed(layer: Layer, most: int):
    """Layers of the streams inside a layer. All bytes of such a layer come from the whole stream."""
    at = 0
    while m := STREAM.search(layer.data, at):
        at = m.start() + 1
        found = unpacked(memoryview(layer.data)[m.start() :], most)
        if found and (found[0] or not found[2]):
            said, size, whole = found
            at = m.start() + max(1, size if whole else 1)
            start, end = layer.start[m.start()], layer.end[m.start() + size - 1]
            yield Layer(said, np.broadcast_to(start, len(said)), np.broadcast_to(end, len(said)), (*layer.how, "compressed"), (int(start), layer.data[m.start() : m.start() + MARK_BYTES])), whole


def wanted(kind: str, lower: bytes) -> bool:
    return not NEEDS[kind] or any(w in lower for w in NEEDS[kind])


def long_enough(kind: str, m: re.Match) -> bool:
    _, group, least = KINDS[kind]
    return len(m[group]) >= least


def scan_text(text: str, lower: bytes) -> list[Found]:
    return [Found(kind, *m.span(), (), m[0]) for kind, p in IN_TEXT.items() if wanted(kind, lower) for m in p.finditer(text) if long_enough(kind, m)]


def scan_layer(layer: Layer) -> list[Found]:
    lower = layer.data.lower()
    return [
        Found(kind, int(layer.start[m.start()]), int(layer.end[m.end() - 1]), layer.how, m[0].decode())
        for kind, p in IN_BYTES.items() if wanted(kind, lower) for m in p.finditer(layer.data) if long_enough(kind, m)
    ]


def secrets_of(text: str | None, most_bytes: int = MOST_BYTES) -> tuple[list[Found], int]:
    """All secrets of a text and of its layers, sorted by place and kind, and the number of layers that were left unread, as a whole or in part.

    Layers are left unread, and the rest is still found, where all layers of the text
    together pass most_bytes, as streams that unpack to gigabytes do, and where a stream is
    cut short, damaged or of a kind that can't be opened here.
    """
    if not text:
        return [], 0
    layer = first_layer(text)
    found, work, unread, size = scan_text(text, layer.data.lower()), [layer], 0, 0
    seen, read, left = {layer.key()}, set(), set()
    while work:
        layer = work.pop()
        streams = decompressed(layer, max(1, most_bytes - size)) if layer.how else ()
        news = [*((new, True) for new in (*unescaped(layer), *from_base64(layer))), *streams]
        for new, whole in news:
            if new.stream:
                (read if whole else left).add(new.stream)
            if not new.data or (key := new.key()) in seen:
                continue
            seen.add(key)
            size += len(new.data)
            if size > most_bytes:
                unread += whole
                continue
            found += scan_layer(new)
            work.append(new)
    return sorted(set(found), key=lambda f: (f.start, ORDER[f.kind], f.end, f.how)), unread + sum(all(at != own or not first.startswith(mark) for own, first in read) for at, mark in left)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, findings, unread of each row: an array of (kind, start, end, how, value).

    start and end are code points of the text, end exclusive; how is the path of layers,
    empty for what stands in the text itself. One row for each row of docs: null and empty
    texts have none, repeated rows and null ids stay, other columns are left out.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                results = [secrets_of(t, most_bytes) for t in part.column(1).to_pylist()]
                rows = [[{"kind": f.kind, "start": f.start, "end": f.end, "how": ">".join(f.how), "value": f.value} for f in found] for found, _ in results]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind), pa.array([n for _, n in results], pa.int64())], [id_col, "findings", "unread"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("how", pa.string()), ("value", pa.string())]))
    own = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {own}, findings array<struct<kind:string,start:bigint,end:bigint,how:string,value:string>>, unread long")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of what stands in the texts, and the spans of all that was found."""
    base = F.filter("findings", lambda f: f["how"] == "")

    def listed(findings):
        return F.array_distinct(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))

    def number(kind):
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(number, KINDS), F.sha2(F.array_join(listed(base), ","), 256).alias("base_sha256"), F.array_join(listed(F.col("findings")), ",").alias("spans"), "unread")
