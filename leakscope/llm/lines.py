"""Line dedup by a segment-partition edit join.

Equal lines are one class, and so are lines that differ by one edit for every full
``per_edit`` bytes of the shorter one, ``distance`` edits at most (chained).  Only the
first line of a class stays, by document id and line number.  Lines are compared
without the white space around them and with A-Z lower-cased; edits are of bytes.
The limit is relative because two edits turn any line of two bytes into any other.

A line is cut into one segment more than the edits it may have.  If two lines are within the distance,
one has a segment that the other contains, near the same place: which places is
known from both lengths, so a line only asks for a few substrings per length.
Segments and substrings are hashes from running sums, exchanged as packed blobs;
lines that share one meet in a bucket.  Pairs whose bigram parities differ by
more bits than the edits can flip are out, the others are verified by a banded
bit-parallel edit distance, many pairs at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm import textarrays as ta
from leakscope.llm.components import Allowed, settle
from leakscope.llm.mixing import word_count
from leakscope.llm.neardup import all_differing, differing, sizes_and_bits
from leakscope.session import materialize, release

DISTANCE = 2
PER_EDIT = 10              # bytes of the shorter line that one edit takes
PARITY_BITS = 128
BUFFER = 32 << 20
BUCKET_BYTES = 8 << 20
# The parity bit of every pair of bytes.
_BIGRAM_BITS = (ta.mix(np.arange(1, 65537, dtype=np.uint64)) % np.uint64(PARITY_BITS)).astype(np.int64)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, and trimmed start, stop, text and number of every line that is not blank."""
    data = ta.LOWER[data]
    starts, stops, texts = ta.line_spans(data, offsets)
    begin, end = ta.word_spans(data, offsets)
    first, last = np.searchsorted(begin, starts, "left"), np.searchsorted(begin, stops, "left")
    number = np.arange(len(starts)) - np.searchsorted(texts, np.arange(len(offsets) - 1))[texts]
    filled = np.flatnonzero(last > first)
    return data, begin[first[filled]], end[last[filled] - 1], texts[filled], number[filled]


def parities(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Parity of the bigrams of every line, folded into bits; an edit flips four at most."""
    sizes = stops - starts - 1
    line = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(line)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    bits = _BIGRAM_BITS[data[at].astype(np.uint16) << np.uint16(8) | data[at + 1]]
    odd = np.bincount(line * PARITY_BITS + bits, minlength=len(starts) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1).view(">u8").astype(np.uint64)


def segment_codes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, distance: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(line, code) of all segments of every line, and of all substrings that may equal a
    segment of a line up to ``distance`` bytes shorter."""
    count = distance + 1
    sums = ta.running_sums(codes)
    lines, found = [], []
    length = stops - starts
    for shorter in range(distance + 1):
        whole = length - shorter
        size, longer = whole // count, whole % count
        for i in range(count):
            # the first segments are one byte shorter where the length does not divide
            extra = np.maximum(0, i - (count - longer))
            begin, span = i * size + extra, size + (i >= count - longer)
            low = max(-i, shorter - (distance - i))
            high = min(i, shorter + (distance - i))
            for shift in range(low, high + 1):
                at = begin + shift
                fits = np.flatnonzero((at >= 0) & (at + span <= length) & (span > 0))
                a = starts[fits] + at[fits]
                code = ta.range_hashes(sums, a, a + span[fits])
                lines.append(fits)
                found.append(ta.mix(code ^ ta.mix((whole[fits] * 64 + i + 1).astype(np.uint64))))
    return np.concatenate(lines), np.concatenate(found)


def near_codes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, distance: int, per_edit: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """(line, code) for every number of edits a pair may have.  Pairs that may have fewer than
    ``distance`` edits have a shorter line in one range of lengths, and the longer line is in it
    too or above it by no more than the edits."""
    length = stops - starts
    lines, found = [], []
    for edits in range(1, distance + 1):
        most = per_edit * (edits + 1) - 1 + edits if edits < distance else length.max(initial=0)
        own = np.flatnonzero((length >= per_edit * edits) & (length <= most))
        of, code = segment_codes(codes, starts[own], stops[own], edits)
        lines.append(own[of])
        found.append(code)
    return np.concatenate(lines), np.concatenate(found)


OCCURRENCES = "doc_id long, text_hash long, number int, line long, size int, parity array<long>"


def tell_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ta.slices(batches):
        data, starts, stops, texts, number = lines_of(*ta.text_bytes(batch.column("text")))
        line = ta.sequence_hashes(ta.BYTE_CODES[data], starts, stops)
        odd = parities(data, starts, stops)
        at = pa.array(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("text_hash").take(at),
             pa.array(number.astype(np.int32)), pa.array(ta.signed(line)),
             pa.array((stops - starts).astype(np.int32)),
             ta.list_array(pa.array(ta.signed(odd.ravel())), np.full(len(line), PARITY_BITS // 64))],
            ["doc_id", "text_hash", "number", "line", "size", "parity"])


def tell_codes(distance: int, per_edit: int, buckets: int
               ) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed (code, line) pairs by bucket, each once per buffer."""

    def hand_over(lines: list[np.ndarray], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sum(map(len, lines)):
            return
        line, code = np.concatenate(lines), np.concatenate(codes)
        home, code = (code & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), code >> np.uint64(32)
        order = np.lexsort((line, code, home))
        line, code, home = line[order], code[order], home[order]
        new = np.ones(len(line), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (code[1:] != code[:-1])
        line, code, home = line[new], code[new], home[new].astype(np.int64)
        edges = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        ends = np.append(edges[1:], len(home))
        yield pa.RecordBatch.from_arrays(
            [pa.array(home[edges].astype(np.int32)),
             pa.array([ta.pack_ints(code[a:b], True) for a, b in zip(edges, ends)], pa.binary()),
             pa.array([line[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary())],
            ["home", "codes", "lines"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, codes, size, known = [], [], 0, np.zeros(0, np.uint64)
        for batch in ta.slices(batches):
            data, starts, stops, _, _ = lines_of(*ta.text_bytes(batch.column("text")))
            values = ta.BYTE_CODES[data]
            line, first = np.unique(ta.sequence_hashes(values, starts, stops), return_index=True)
            new = ~np.isin(line, known)
            line, first = line[new], first[new]
            known = np.concatenate([known, line])
            of, code = near_codes(values, starts[first], stops[first], distance, per_edit)
            lines.append(line[of])
            codes.append(code)
            size += len(data)
            if size >= BUFFER:
                yield from hand_over(lines, codes)
                lines, codes, size, known = [], [], 0, known[:0]
        yield from hand_over(lines, codes)

    return run


def shared_codes(table: pa.Table) -> pa.Table:
    """(bucket, node): lines of a blob bucket that share a code with another line."""
    code = np.concatenate([ta.unpack_ints(c, True) for c in table.column("codes").to_pylist()])
    line = np.frombuffer(b"".join(table.column("lines").to_pylist()), np.uint64)
    home = table.column("home")[0].as_py()
    order = np.lexsort((line, code))
    code, line = code[order], line[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (line[1:] != line[:-1])
    code, line = code[new], line[new]
    edges = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    sizes = np.diff(np.append(edges, len(code)))
    several = np.repeat(sizes > 1, sizes)
    return pa.table({"bucket": pa.array(code[several] | home << 32),
                     "node": pa.array(ta.signed(line[several]))})


def within_distance(left: list[bytes], right: list[bytes], distance: int, limits: np.ndarray | None = None
                    ) -> np.ndarray:
    """Whether each pair of byte strings is within ``distance`` edits, or within its own limit,
    which is no larger.

    Bit-parallel, banded: of every column only the 2 x distance + 1 cells around the
    diagonal are kept, as bits that say where the distance rises and falls; a
    column is a few word operations for all pairs together.
    """
    n = len(left)
    swap = [len(a) < len(b) for a, b in zip(left, right)]
    a = [y if s else x for s, x, y in zip(swap, left, right)]      # the longer one, down the rows
    b = [x if s else y for s, x, y in zip(swap, left, right)]
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    good = la - lb <= distance
    width, band = int(max(la.max(initial=0), 1)), 2 * distance + 1
    rows = np.full((n, width + 2 * band), 256, dtype=np.int16)     # 256 and 257 equal nothing
    columns = np.full((n, width), 257, dtype=np.int16)
    for i, (x, y) in enumerate(zip(a, b)):
        rows[i, band:band + len(x)] = np.frombuffer(x, np.uint8)
        columns[i, :len(y)] = np.frombuffer(y, np.uint8)
    mask = np.uint64((1 << band) - 1)
    one = np.uint64(1)
    # bit k of column j stands for row j + k - distance
    up = np.full(n, ((1 << (distance + 1)) - 1) << distance & int(mask), dtype=np.uint64)
    down = np.zeros(n, dtype=np.uint64)
    bottom = np.full(n, distance, dtype=np.int64)                  # value of the band's last cell
    diagonal = np.uint64(1 << (band - 1))
    ends = np.zeros(n, dtype=np.int64)
    for j in range(int(lb.max(initial=0))):
        equal = np.zeros(n, dtype=np.uint64)
        for k in range(band):
            hit = rows[:, band + j + k - distance] == columns[:, j]
            equal |= hit.astype(np.uint64) << np.uint64(k)
        d0 = ((((equal & up) + up) ^ up) | equal | down) & mask
        hp = (down | ~(d0 | up)) & mask
        hn = d0 & up
        bottom += (d0 & diagonal) == 0
        d1 = d0 >> one
        up = (hn | ~(d1 | hp)) & mask
        down = hp & d1
        done = lb == j + 1
        if done.any():
            # from the band's last row up to the last row of the longer string
            value = bottom.copy()
            for k in range(band - 1, 0, -1):
                above = j + 1 + (k - distance) > la
                bit = np.uint64(k - 1)         # the bits have moved on to the next column
                value -= np.where(above, ((up >> bit) & one).astype(np.int64) - ((down >> bit) & one).astype(np.int64), 0)
            ends[done] = value[done]
    ends[lb == 0] = la[lb == 0]
    return good & (ends <= (distance if limits is None else limits))


def _verify(distance: int, per_edit: int, most: int = 1 << 21) -> Callable[[pa.Array, pa.Array], np.ndarray]:
    """Whether each pair of lines is within the distance, lines of like length together."""

    def run(left: pa.Array, right: pa.Array) -> np.ndarray:
        left, right = left.to_pylist(), right.to_pylist()
        sizes = [max(len(x), len(y)) for x, y in zip(left, right)]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        limits = np.minimum(np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64) // per_edit, distance)
        good = np.zeros(len(sizes), dtype=bool)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at) * sizes[order[end]] < most and (
                    sizes[order[end]] <= 2 * sizes[order[at]] + 64):
                end += 1
            own = order[at:end]
            good[own] = within_distance([left[i] for i in own], [right[i] for i in own], distance, limits[own])
            at = end
        return good

    return run


def _allowed(distance: int, per_edit: int) -> Allowed:
    """Pairs whose lengths and parities leave few enough edits possible."""

    def run(here: list[np.ndarray], there: list[np.ndarray]) -> np.ndarray:
        (a, x), (b, y) = here, there
        edits = np.minimum(np.minimum(a[:, None], b) // per_edit, distance)
        return (np.abs(a[:, None] - b) <= edits) & (all_differing(x, y) <= 4 * edits)

    return run


def _wanted_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, bytes) of the lines a document is asked for."""
    for batch in ta.slices(batches):
        data, starts, stops, texts, _ = lines_of(*ta.text_bytes(batch.column("text")))
        line = ta.signed(ta.sequence_hashes(ta.BYTE_CODES[data], starts, stops))
        wanted = batch.column("wanted")
        asked = wanted.values.to_numpy()[wanted.offsets[0].as_py():wanted.offsets[-1].as_py()]
        hit = np.flatnonzero(np.isin(line, asked))
        yield pa.RecordBatch.from_arrays(
            [pa.array(line[hit]), pa.array([data[starts[i]:stops[i]].tobytes() for i in hit], pa.binary())],
            ["line", "bytes"])


def duplicate_lines(docs: DataFrame, distance: int = DISTANCE, per_edit: int = PER_EDIT) -> DataFrame:
    """doc_id, text_hash, removed: array of (number, near, keep_doc, keep_number) of the lines
    to remove, for every different (doc_id, text) that loses some.

    Numbers count from 0.  ``near`` says that the kept line is not equal.  Rows
    without an id come last, so they lose to any other; rows equal in id and text
    are one document and keep the same lines.  All lines that are not blank take
    part; lines under ``per_edit`` bytes (3 at least, so that a segment is never
    empty) only equal others.
    """
    if per_edit < 3:
        raise ValueError("an edit takes 3 bytes at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    told = materialize(rows.mapInArrow(tell_lines, OCCURRENCES), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "number")
    lines = materialize(told.groupBy("line").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"),
        F.first(F.struct("size", "parity")).alias("trait")), "distinct")
    members = materialize(
        rows.select("text").mapInArrow(tell_codes(distance, per_edit, buckets), "home int, codes binary, lines binary")
        .groupBy("home").applyInArrow(shared_codes, "bucket long, node long"), "members")
    meeting = lines.join(members.select(F.col("node").alias("line")).distinct(), "line", "left_semi")
    asked = (meeting.select("line", "first.*").groupBy("doc_id", "text_hash")
             .agg(F.collect_list("line").alias("wanted")))
    same = (F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.text_hash") == F.col("w.text_hash")))
    texts = materialize(
        rows.alias("r").join(asked.alias("w"), same).select("r.text", "w.wanted")
        .mapInArrow(_wanted_texts, "line long, bytes binary").dropDuplicates(["line"]), "texts")

    def near(x: Column, y: Column) -> Column:
        edits = F.least(F.floor(F.least(x["size"], y["size"]) / per_edit), F.lit(distance))
        return (F.abs(x["size"] - y["size"]) <= edits) & (
            differing(x["parity"], y["parity"], PARITY_BITS // 64) <= 4 * edits)

    traits = meeting.select(F.col("line").alias("node"), "trait")
    contents = texts.withColumnsRenamed({"line": "node", "bytes": "content"})
    labels = settle(members, traits, contents, near, lambda t: sizes_and_bits(t, "parity", PARITY_BITS // 64),
                    _allowed(distance, per_edit), _verify(distance, per_edit)
                    ).withColumnRenamed("node", "line")
    release(members, texts)
    linked = lines.select("line", "first", "n").join(labels, "line", "left")
    chosen = linked.filter("component is not null").groupBy("component").agg(F.min("first").alias("keep"))
    # lines that occur once and are near no other have nothing to lose
    repeated = (linked.filter("n > 1 or component is not null").join(chosen, "component", "left")
                .select("line", F.col("first"), F.coalesce("keep", "first").alias("keep")))
    gone = (told.join(repeated, "line")
            .filter(~(place.eqNullSafe(F.col("keep"))))
            .select("doc_id", "text_hash", "number", (F.col("first") != F.col("keep")).alias("near"),
                    F.col("keep.doc_id").alias("keep_doc"), F.col("keep.number").alias("keep_number")))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(
        F.struct("number", "near", "keep_doc", "keep_number"))).alias("removed"))


def _with_removed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of id, hash of the text and more, with the lines they lose."""
    same = F.col("r.id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.hash") == F.col("g.text_hash"))
    return rows.alias("r").join(gone.alias("g"), same, "left").select("r.*", "g.removed")


def report(docs: DataFrame, distance: int = DISTANCE, per_edit: int = PER_EDIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, n_near (removed lines whose
    kept line is not equal), removed (line numbers) and kept_in (document:line of the
    line that stays for each of them).  A null text has no lines."""
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"),
                       lines.cast("long").alias("n_lines"))
    out = _with_removed(slim, duplicate_lines(docs, distance, per_edit))
    removed = F.coalesce("removed", F.array().cast("array<struct<number:int,near:boolean,keep_doc:bigint,keep_number:int>>"))
    return out.select(
        F.col("id").alias("doc_id"), "n_lines", F.size(removed).cast("long").alias("n_removed"),
        F.size(F.filter(removed, lambda x: x["near"])).cast("long").alias("n_near"),
        F.array_join(F.transform(removed, lambda x: x["number"].cast("string")), ",").alias("removed"),
        F.array_join(F.transform(removed, lambda x: F.concat_ws(
            ":", F.coalesce(x["keep_doc"].cast("string"), F.lit("")), x["keep_number"].cast("string"))), ",").alias("kept_in"))


def dedup_lines(docs: DataFrame, distance: int = DISTANCE, per_edit: int = PER_EDIT, least_left: float = 0.0
                ) -> DataFrame:
    """The documents in the columns they came in, whatever their names, without their removed lines.

    A document that loses lines goes if it has no words left, or less than the share
    ``least_left`` of its words: it was mostly a copy of earlier ones.  Documents that lose
    no line stay, null and empty texts included; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    text = F.col("document.text")
    numbers = F.transform("removed", lambda x: x["number"])
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(numbers, i)), "\n")
    out = _with_removed(rows, duplicate_lines(docs, distance, per_edit)).withColumn(
        "left", F.when(F.col("removed").isNull(), text).otherwise(left))
    words, before = word_count(F.col("left")), word_count(text)
    out = out.filter(F.col("removed").isNull() | ((words > 0) & (words >= F.lit(least_left) * before)))
    changed = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return out.select(*[changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns])
