"""Byte-level BPE by a bounded-lookahead streaming transducer, and its decoder.

The merge list bounds how far the end of an input can reach back. Take two inputs with a common prefix and
apply the merges in order: each merge can take at most one token off the end of what the two still have in
common, namely its left part, and after a merge that took ``a`` only a merge whose right part begins
with ``a`` can take the next one. The heaviest chain of such merges is the sufficient lookahead (320
bytes for a list of 50,000 merges): a token that ends that far before the end of what has been read stays, whatever
follows. The transducer holds a window of a few times that, emits the tokens that are stable and forgets them.

Text is first cut into pieces (contractions, words, numbers, signs, white space) as a byte-level
pre-tokenizer does; the strings of special tokens are cut out before. Pieces come from a reader that holds a bounded part of the
text too: a run of letters without end is passed on while it is read.

Decoding feeds the bytes of the ids to a state machine that keeps an unfinished character (three bytes at most) until the rest comes; bytes that
form no character become U+FFFD.

Defined cases: a null text is an empty one and gives no ids; a very long text without any break takes no more memory than the
window; equal texts have equal ids, and a row that repeats is encoded each time; an empty table gives no rows; other columns are not
read by the query and carried by ``encode``, which refuses to overwrite a column.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters taken from a text at a time, and the length from which a run is passed on unfinished.
CHUNK, RUN = 1 << 16, 1 << 12
#: Pieces whose ids are remembered (twice as many at most), and the longest of them.
REMEMBERED, SHORT = 1 << 19, 64
#: Above any merge; and what lies beyond the basic plane.
NEVER, BEYOND = 1 << 62, re.compile("[\U00010000-\U0010ffff]")
#: The contractions that are pieces of their own.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of the input beyond which tokens are stable: the heaviest chain of merges, each weighing as
    much as its left part, where the right part of each begins with the left part of the one before."""
    left: dict[bytes, bytes] = {}
    best: dict[bytes, int] = {}
    for a, b in merges:
        if a + b in left or any(len(t) > 1 and t not in left for t in (a, b)):
            raise ValueError("a merge must join what earlier merges made, and make what none has made")
        weight, start = 0, b
        while True:
            weight = max(weight, best.get(start, 0))
            if start not in left:
                break
            start = left[start]
        left[a + b] = a
        best[a] = max(best.get(a, 0), weight + len(a))
    return max(best.values(), default=0)


@dataclass
class Tokenizer:
    """What workers need of a vocabulary: bytes of each id, merges by pair of ids, special strings, letter classes."""

    pieces: list[bytes]
    merges: dict[int, int]  # left id << 32 | right id: rank << 32 | id
    single: list[int]
    special: dict[str, int]
    classes: dict[str, tuple[str, str]]
    reach: int

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self.window = max(4 * self.reach, self.reach + 2 * self.longest)
        self.known, self.older = {}, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"} | {"known": {}, "older": {}}

    def patterns(self, text: str) -> tuple[re.Pattern, dict[str, re.Pattern]]:
        """Patterns of pieces and of what continues a run. Text within the basic plane takes classes that are looked up at once."""
        if not hasattr(self, "_made"):
            self._made = {}
        plane = bool(BEYOND.search(text))
        if plane not in self._made:
            letter, number, space = (low + high * plane for low, high in (self.classes[k] for k in ("letter", "number", "space")))
            sign = f"[^{letter}{number}{space}]"
            short = "|".join(map(re.escape, CONTRACTIONS))
            pattern = f" ?[{letter}]+|{short}| ?[{number}]+| ?{sign}+|[{space}]+(?![^{space}])|[{space}]+"
            rest = {"letter": f"[{letter}]*", "number": f"[{number}]*", "sign": f"{sign}*", "space": f"[{space}]*"}
            self._made[plane] = re.compile(pattern), {k: re.compile(v) for k, v in rest.items()}
        return self._made[plane]

    def tokens(self, data: bytes) -> list[int]:
        """The tokens of a short input: the merge of least rank first, the leftmost of equal ones."""
        ids, find = [self.single[b] for b in data], self.merges.get
        if len(ids) <= 32:  # searching a short list is faster than a heap
            ranks = [find(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) != NEVER:
                i = ranks.index(best)
                made = ids[i] = best & 0xFFFFFFFF
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = find(made << 32 | ids[i + 1], NEVER)
                if i:
                    ranks[i - 1] = find(ids[i - 1] << 32 | made, NEVER)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := find(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or find(ids[i] << 32 | ids[j]) != m:
                continue  # one of the two is gone
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := find(ids[i] << 32 | ids[k]):
                    heapq.heappush(heap, (m, i))
            h = before[i]
            if h >= 0 and (m := find(ids[h] << 32 | ids[i])):
                heapq.heappush(heap, (m, h))
        return [t for t in ids if t >= 0]

    def packed(self, piece: str) -> bytes:
        """Ids of a piece, four bytes each."""
        out = self.known.get(piece)
        if out is None:
            out = self.older.get(piece)
            if out is None:
                data = piece.encode()
                if len(data) <= self.window:
                    out = pack(self.tokens(data))
                else:
                    run = Transducer(self)
                    out = run.feed(data) + run.finish()
            if len(piece) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[piece] = out
        return out


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Transducer:
    """Bytes of one piece in, ids out as soon as they are stable."""

    def __init__(self, tokenizer: Tokenizer):
        self.of, self.held, self.most = tokenizer, bytearray(), 0

    def feed(self, data: bytes) -> bytes:
        out, t = [], self.of
        for i in range(0, len(data), t.window):
            self.held += data[i : i + t.window]
            self.most = max(self.most, len(self.held))
            while len(self.held) >= t.window:
                end, limit = 0, t.window - t.reach
                for token in t.tokens(bytes(self.held[: t.window])):
                    if end + len(t.pieces[token]) > limit:
                        break
                    end += len(t.pieces[token])
                    out.append(token)
                del self.held[:end]
        return pack(out)

    def finish(self) -> bytes:
        out = pack(self.of.tokens(bytes(self.held)))
        self.held.clear()
        return out


def encoded(chunks: Iterable[str], t: Tokenizer) -> Iterator[bytes]:
    """Packed ids of a text that comes in chunks; of the text only what no piece has taken yet is held."""
    special = re.compile("|".join(map(re.escape, sorted(t.special, key=len, reverse=True)))) if t.special else None
    back = max(3, *(len(s) for s in t.special), 0) if t.special else 3
    kind, run, held = "", Transducer(t), ""

    def take(text: str, more: bool) -> tuple[list[bytes], str]:
        """Ids of the pieces of text that are sure, and the rest of it; all of it unless more may follow."""
        nonlocal kind
        out = []
        pattern, rest = t.patterns(text)
        if kind:
            end = rest[kind].match(text).end()
            over = end == len(text)
            if kind == "space" and end and (more or not over):
                end -= 1  # the last one may belong to what follows
            stop = max(0, min(end, len(text) - back)) if over and more else end
            out.append(run.feed(text[:stop].encode()))
            text = text[stop:]
            if over and more:
                return out, text
            out.append(run.finish())
            kind = ""
        if not more:
            return [*out, *map(t.packed, pattern.findall(text))], ""
        cut, tries = text.rfind(" "), 64
        while cut > 0 and tries and rest["space"].match(text[cut - 1]).end():
            cut, tries = text.rfind(" ", 0, cut), tries - 1
        if cut > 0 and tries:  # a blank after a letter or sign begins a piece
            return [*out, *map(t.packed, pattern.findall(text[:cut]))], text[cut:]
        if len(text) < RUN:
            return out, text
        end = 0
        for m in pattern.finditer(text):
            if m.end() > len(text) - back:
                if len(text) - m.start() > RUN // 2:
                    first = text[m.start() + 1]
                    kind = next(k for k in ("letter", "number", "space", "sign") if rest[k].match(first).end())
                    out.append(run.feed(text[m.start() : len(text) - back].encode()))
                    end = len(text) - back
                break
            out.append(t.packed(m[0]))
            end = m.end()
        return out, text[end:]

    for chunk in chunks:
        text = held + chunk
        while special and (m := special.search(text)):
            out, _ = take(text[: m.start()], False)
            yield from out
            yield pack([t.special[m[0]]])
            text = text[m.end() :]
        out, held = take(text, True)
        yield from out
    yield from take(held, False)[0]


class Decoder:
    """Ids in, text out; an unfinished character waits for the ids that finish it."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.state = pieces, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        of = self.pieces
        return self.state.decode(b"".join([of[i] for i in np.frombuffer(packed, "<u4").tolist()]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def ranges(flags: np.ndarray, first: int) -> str:
    """The inside of a character class with the code points whose flag is set."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))) + first
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@functools.cache
def letter_classes() -> dict[str, tuple[str, str]]:
    """Letters, numbers and white space, within the basic plane and beyond it, of the version of Unicode that the tokenizers library has."""
    from tokenizers import Regex, pre_tokenizers

    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, points, classes = "".join(map(chr, every)), np.array(every), {}
    for name, pattern in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s")):
        flags = np.zeros(0x110000, bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(f"(?:{pattern})+"), "removed", invert=True).pre_tokenize_str(text):
            flags[points[a:b]] = True
        classes[name] = ranges(flags[:0x10000], 0), ranges(flags[0x10000:], 0x10000)
    return classes


def load(path: str) -> Tokenizer:
    """A vocabulary file of the tokenizers library: byte-level BPE without normaliser, prefix space or dropout. The driver reads it;
    its size is that of a vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file["normalizer"] or file["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path} is not plain byte-level BPE")
    of = {letter: b for b, letter in enumerate(byte_letters())}
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    if any(x[k] for x in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", s) for s in special):
        raise ValueError("special tokens must stand for themselves and hold no white space")
    vocabulary = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [tuple(bytes(of[c] for c in x) for x in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    pieces = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for token, i in [*vocabulary.items(), *((s.encode(), i) for s, i in special.items())]:
        pieces[i] = token
    ranked = {vocabulary[a] << 32 | vocabulary[b]: (rank + 1) << 32 | vocabulary[a + b] for rank, (a, b) in enumerate(merges)}
    return Tokenizer(pieces, ranked, [vocabulary[bytes([b])] for b in range(256)], special, letter_classes(), lookahead(merges))


def parts(text: str) -> Iterator[str]:
    return (text[i : i + CHUNK] for i in range(0, len(text), CHUNK))


def encode(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """docs with the ids of each text as an array."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            ids = [np.frombuffer(b"".join(encoded(parts(x.as_py() or ""), t)), "<u4").astype(np.int32) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` array<int>"
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text that an array of ids stands for; a null array gives an empty text."""
    if name.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"there is a column {name}")
    shared = rows.sparkSession.sparkContext.broadcast(load(path).pieces)

    def text(packed: bytes) -> str:
        d = Decoder(shared.value)
        return "".join([*(d.feed(packed[i : i + 4 * CHUNK]) for i in range(0, len(packed), 4 * CHUNK)), d.finish()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [text(pack(x.as_py() or [])) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` string"
    return rows.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids go through the decoder as they come, so that neither the ids nor the
    decoded text of a document is ever held whole."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def one(text: str | None, t: Tokenizer) -> tuple[int, str, str]:
        n, ids, out, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t.pieces)

        def step(packed: bytes) -> int:
            ids.update(packed)
            out.update(decoder.feed(packed).encode())
            return len(packed) // 4

        waiting, size = [], 0
        for packed in encoded(parts(text or ""), t):
            waiting.append(packed)
            size += len(packed)
            if size >= CHUNK:
                n, waiting, size = n + step(b"".join(waiting)), [], 0
        n += step(b"".join(waiting))
        out.update(decoder.finish().encode())
        return n, ids.hexdigest(), out.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            n, ids, out = zip(*(one(x.as_py(), t) for x in batch.column("text")), strict=True) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
