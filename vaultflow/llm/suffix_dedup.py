"""Suffix-array dedup: bytes under strings of ``LENGTH`` bytes that start twice or more.

Suffixes are compared by their first LENGTH bytes, which is all that decides; prefix polynomial
hashes give the hash of any such piece in two look-ups, suffixes are mergesorted by it, and
neighbours with equal hashes are verified byte by byte (a run of neighbours that are equal one
byte further on needs one more byte each).

No machine sorts all suffixes. Each suffix belongs to an anchor: the least hash of ``GRAM`` bytes
among the grams in its first SEEK bytes. The anchor depends on these bytes alone, so equal strings have
equal anchors, and suffixes that share an anchor are neighbours in the text: one row stands for a run of
some 100 suffixes, or for up to RUN in periodic text, whose grams are all alike. Anchors with a single place are
dropped; the surroundings of the others are shuffled by anchor and their suffixes sorted there. Equal texts are folded
first; a text that occurs twice is covered whole.

An anchor with more than HOT suffixes isn't sorted in one task: its equal surroundings are folded by their bytes, and the
suffixes of those that differ become rows of their own hashes, which Spark counts with partial sums.

SEEK is the length of the shortest string that is looked for: beside the bytes to remove the result tells
whether a passage of more than ``PASSAGE`` words, all under repeated strings of SEEK bytes, stands in the text.

Defined cases: a null text is empty; texts shorter than LENGTH have nothing to remove; a string that
overlaps itself counts; repeated rows are copies of each other; very long texts are whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .texthash import BYTE, U, chunks, mix, powers, prefix_hashes, slices, text_bytes

LENGTH, SEEK, GRAM = 400, 240, 48
#: Words that a repeated passage has at least, less one.
PASSAGE = 50
#: Suffixes of an anchor that one task sorts, and of a row.
HOT, RUN = 2_000_000, 1 << 15
#: Bytes of surroundings that are sorted together.
SORTED = 1 << 20


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, U)
    full[: len(x)] = x
    square = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def piece_hashes(data: np.ndarray, starts: np.ndarray, length: int, table: np.ndarray = BYTE) -> np.ndarray:
    c = prefix_hashes(table[data])
    inverse = powers(len(data) + 1)[1]
    with np.errstate(over="ignore"):
        return mix((c[starts + length] - c[starts]) * inverse[starts])


def anchors(data: np.ndarray, offsets: np.ndarray, seek: int, gram: int):
    """(text, anchor's hash, first and last suffix, whether the anchor has several places there), places counted in the text."""
    n, none = len(data), np.zeros(0, np.int64)
    long_enough = np.flatnonzero(np.diff(offsets) >= seek)
    if not len(long_enough):
        return none, none, none, none, none.astype(bool)
    g = piece_hashes(data, np.arange(n - gram + 1), gram)
    # The least hash, and of equal ones the first in the text.
    packed = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U)
    least = (sliding_least(packed, seek - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    edge[offsets[long_enough]] += 1
    edge[offsets[long_enough + 1] - seek + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    h = g[least[at]]
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
    text = np.searchsorted(offsets, at, "right") - 1
    new[1:] |= text[1:] != text[:-1]
    # Long runs are cut.
    i = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(i, np.diff(np.append(i, len(at))))
    i = np.flatnonzero(since % RUN == 0)
    ends = np.append(i[1:], len(at)) - 1
    base = offsets[text[i]]
    return text[i], h[i].view(np.int64), at[i] - base, at[ends] - base, least[at[i]] != least[at[ends]]


def anchor_rows(seek: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            fresh = np.zeros(len(t1), bool)
            for i, key in enumerate(zip(t1.tolist(), t2.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh[i] = True
            kept = batch.filter(pa.array(fresh))
            t1, t2 = t1[fresh], t2[fresh]
            data, offsets = text_bytes(kept.column("text"))
            for i, j in chunks(offsets):
                text, h, first, last, several = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], seek, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, t1[i:j][text], t2[i:j][text], first, last, several)], names=["h", "t1", "t2", "first", "last", "several"])

    return run


def cut_out(length: int):
    """The bytes under each row's suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            data, offsets = text_bytes(batch.column("text"))
            buffer, out, held = data.tobytes(), [], 0
            rows = batch.column("rows").to_pylist()
            for base, end, own, t1, t2 in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows, batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True):
                for r in own:
                    piece = buffer[base + r["first"] : min(base + r["last"] + length, end)]
                    out.append((r["h"], r["hot"], t1, t2, r["first"], r["last"] - r["first"] + 1, piece))
                    held += len(piece)
                    if held > 4 << 20:
                        yield _surroundings(out)
                        out, held = [], 0
            yield _surroundings(out)

    return run


def _surroundings(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    cols = list(zip(*out, strict=True)) if out else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "hot", "t1", "t2", "first", "n", "piece"])


def twice(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at starts (ascending) have their first length bytes in common with another."""
    h = piece_hashes(data, starts, length)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    x, y = order[:-1][same], order[1:][same]
    partner = np.full(len(starts), -1)
    partner[x] = y
    # If the suffixes one byte before are partners too, all but the last byte is known to be equal.
    known = np.zeros(len(x), bool)
    inner = (x > 0) & (y > 0)
    xi, yi = x[inner], y[inner]
    known[inner] = (starts[xi - 1] == starts[xi] - 1) & (starts[yi - 1] == starts[yi] - 1) & (partner[xi - 1] == yi - 1)
    equal = data[starts[x] + length - 1] == data[starts[y] + length - 1]
    rest = np.flatnonzero(~known)
    for i in range(0, len(rest), 4096):
        some = rest[i : i + 4096]
        span = np.arange(length)
        equal[some] = (data[starts[x[some]][:, None] + span] == data[starts[y[some]][:, None] + span]).all(axis=1)
    found = np.zeros(len(starts), bool)
    if equal.all():
        found[x] = found[y] = True
        return found
    # A collision of hashes: the bytes themselves decide for all suffixes of these hashes.
    buffer, count = data.tobytes(), {}
    for i in np.unique(np.concatenate([x, y])).tolist():
        count.setdefault(buffer[starts[i] : starts[i] + length], []).append(i)
    for group in count.values():
        found[group] = len(group) > 1
    return found


def bytes_of(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, raw = pieces.buffers()
    offsets = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8), offsets - offsets[0]


def suffixes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Bytes of all pieces; of each suffix its row, where it starts in the bytes and in its text, and its bytes to the piece's end."""
    data, offsets = bytes_of(batch.column("piece"))
    counts = batch.column("n").to_numpy()
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[row] + inside
    return data, row, starts, batch.column("first").to_numpy()[row] + inside, offsets[row + 1] - starts


def runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of neighbouring suffixes."""
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(new)
    return i, np.append(i[1:], len(at)) - 1 if len(at) else i


def spans_of(batch: pa.RecordBatch, length: int, seek: int) -> pa.RecordBatch:
    """(t1, t2, from, to, full) of the bytes under repeated strings among the rows of batch: of length bytes (full) and of seek."""
    data, row, starts, at, room = suffixes(batch)
    t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
    out, some = [], np.arange(len(starts))
    for size in (seek, length):
        some = some[room[some] >= size]
        some = some[twice(data, starts[some], size)]
        i, j = runs(row[some], at[some])
        own = row[some][i]
        out.append((t1[own], t2[own], at[some][i], at[some][j] + size, np.full(len(i), size == length)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["t1", "t2", "from", "to", "full"])


def sort_groups(length: int, seek: int):
    """Rows come sorted by anchor; whole anchors are sorted together, many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def together() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += int(bytes_of(batch.column("piece"))[1][-1])
            if size < SORTED or batch.column("h")[-1] == held[0].column("h")[0]:
                continue
            all_rows = together()
            h = all_rows.column("h").to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
            yield spans_of(all_rows.slice(0, cut), length, seek)
            held = [all_rows.slice(cut)]
            size = int(bytes_of(held[0].column("piece"))[1][-1])
        if held:
            yield spans_of(together(), length, seek)

    return run


def suffix_rows(length: int, seek: int):
    """A row for each suffix: two hashes of its first bytes, seek and length (full) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = bytes_of(batch.column("piece"))
            for i, j in chunks(offsets, 1 << 18):
                part = batch.slice(i, j - i)
                data, row, starts, at, room = suffixes(part)
                for size in (seek, length):
                    some = room >= size
                    a, b = (piece_hashes(data, starts[some], size, t).view(np.int64) for t in (BYTE, BYTE[::-1]))
                    own = row[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), pa.array(b), pa.array(np.full(len(a), size == length)), *(part.column(c).take(pa.array(own)) for c in ("t1", "t2", "first")), pa.array(at[some])],
                        names=["a", "b", "full", "t1", "t2", "first", "from"],
                    )

    return run


def join_runs(length: int, seek: int):
    """Spans from the places of a row's repeated suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            row = np.repeat(np.arange(len(batch)), places.value_lengths().to_numpy())
            at = places.flatten().to_numpy()
            i, j = runs(row, at)
            own = pa.array(row[i])
            full = batch.column("full").take(own)
            size = np.where(full.to_numpy(zero_copy_only=False), length, seek)
            yield pa.RecordBatch.from_arrays([batch.column("t1").take(own), batch.column("t2").take(own), pa.array(at[i]), pa.array(at[j] + size), full], names=["t1", "t2", "from", "to", "full"])

    return run


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cleaned(length: int, seek: int):
    """What each document loses and keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            for text, copies, spans in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode()
                cut, told = ([(0, len(data))] if copies > 1 and len(data) >= size else merged([(s["from"], s["to"]) for s in spans or () if s["full"] == full]) for full, size in ((True, length), (False, seek)))
                keep, at = [], 0
                for a, b in cut:
                    keep.append(data[at:a])
                    at = b
                keep.append(data[at:])
                rest = b"".join(keep)
                repeats = any(len(data[a:b].split()) > PASSAGE for a, b in told)
                rows.append((len(data), len(data) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), repeats, [{"from": a, "to": b} for a, b in cut], rest.decode(errors="ignore")))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "removed", "kept"])

    return run


SPAN = "t1 long, t2 long, from long, to long, full boolean"


def repeated_spans(docs: DataFrame, length: int = LENGTH, seek: int = SEEK, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs keyed by the hash of the text (t1, t2); (t1, t2, spans, copies) of each text that has repeated strings or copies."""
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    rows = keyed.filter(F.octet_length("text") >= seek).select("t1", "t2", "text").mapInArrow(anchor_rows(seek, gram), "h long, t1 long, t2 long, first long, last long, several boolean")
    # A text that several tasks have seen gives its rows several times.
    rows = materialize(rows)
    places = rows.groupBy("h").agg(F.sum(F.when(F.col("several"), 2).otherwise(1)).alias("places"), F.sum(F.col("last") - F.col("first") + 1).alias("n"))
    shared = rows.join(places.filter("places > 1").select("h", (F.col("n") > hot).alias("hot")), "h")
    of_text = shared.groupBy("t1", "t2").agg(F.collect_set(F.struct("h", "hot", "first", "last")).alias("rows"))
    # One document stands for all with its text.
    copies = keyed.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    stands = materialize(of_text.join(copies, ["t1", "t2"]).select("doc_id", "t1", "t2", "rows"))
    discard(rows)
    pieces = keyed.join(stands, (keyed["t1"] == stands["t1"]) & (keyed["t2"] == stands["t2"]) & keyed["doc_id"].eqNullSafe(stands["doc_id"]))
    pieces = pieces.select(stands["t1"], stands["t2"], "text", "rows").mapInArrow(cut_out(length), "h long, hot boolean, t1 long, t2 long, first long, n long, piece binary")
    pieces = materialize(pieces)
    discard(stands)
    few = pieces.filter("not hot").select("h", "t1", "t2", "first", "n", "piece").repartition("h").sortWithinPartitions("h")
    spans = few.mapInArrow(sort_groups(length, seek), SPAN)
    # Hot anchors: equal surroundings are covered whole; one of each kind is compared with the others.
    many = pieces.filter("hot")
    kinds = materialize(many.groupBy("h", "n", "piece").agg(F.count("*").alias("rows"), F.min(F.struct("t1", "t2", "first")).alias("one")))
    whole = many.join(kinds.filter("rows > 1").select("h", "n", "piece"), ["h", "n", "piece"], "left_semi")
    sizes = F.explode(F.array(F.struct(F.lit(seek).alias("size"), F.lit(False).alias("full")), F.struct(F.lit(length).alias("size"), F.lit(True).alias("full"))))
    whole = whole.withColumn("s", sizes).filter("octet_length(piece) >= s.size")
    whole = whole.select("t1", "t2", F.col("first").alias("from"), F.least(F.col("first") + F.octet_length("piece"), F.col("first") + F.col("n") - 1 + F.col("s.size")).alias("to"), "s.full")
    each = materialize(kinds.select("h", "n", "piece", "one.*").mapInArrow(suffix_rows(length, seek), "a long, b long, full boolean, t1 long, t2 long, first long, from long"))
    again = each.groupBy("a", "b", "full").agg(F.count("*").alias("rows")).filter("rows > 1").select("a", "b", "full")
    rest = each.join(again, ["a", "b", "full"], "left_semi").groupBy("t1", "t2", "first", "full").agg(F.sort_array(F.collect_set("from")).alias("places"))
    spans = spans.unionByName(whole).unionByName(rest.select("t1", "t2", "full", "places").mapInArrow(join_runs(length, seek), SPAN))
    found = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("from", "to", "full")).alias("spans"))
    found = copies.select("t1", "t2", "copies").join(found, ["t1", "t2"], "left").filter("copies > 1 or spans is not null")
    found = materialize(found)
    discard(pieces, kinds, each)
    return keyed, found


def dedup_documents(docs: DataFrame, length: int = LENGTH, seek: int = SEEK, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats, removed, kept): ``repeats`` tells whether a passage of more than
    PASSAGE words repeats, ``removed`` lists the byte ranges, ``kept`` is the text that is left (a character that is cut
    through is dropped from it)."""
    keyed, found = repeated_spans(docs, length, seek, gram, hot)
    both = keyed.join(found, ["t1", "t2"], "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    schema = "doc_id {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean, removed array<struct<from:long,to:long>>, kept string"
    return both.mapInArrow(cleaned(length, seek), schema.format(docs.schema["doc_id"].dataType.simpleString()))
