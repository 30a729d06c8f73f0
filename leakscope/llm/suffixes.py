"""Long repeats across documents by suffix arrays.

A byte goes if a string of ``length`` bytes around it also starts in a document of
a smaller id.  The work is narrowed exactly before suffixes are sorted:

1. Every window of ``length`` bytes is named by the smallest hash of the short
   strings in it.  Neighbouring windows mostly share their name, so a text has
   about one name per 14 bytes, and equal windows have equal names.
2. Names are compared across documents; names of one document are done with.
3. Stretches of windows with a shared name travel, with their bytes, to the
   bucket of the name.  Equal ones are one there, and one that is then alone with
   its name has no equal windows in others.  Those with a name in common are cut
   into shards.  A shard sorts its suffixes
   by Larsson-Sadakane refinement, finds common prefixes by Kasai's
   rule, and merges with the other shards of its bucket by binary search.
4. Every group of equal windows has a smallest document; it keeps them.

Names and stretches that already repeat inside a mapper's buffer are settled
there and sent once, so a passage that a third of all documents share reaches its
bucket about once per buffer, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import textarrays as ta
from leakscope.session import materialize

LENGTH = 50
GRAM = 24
SLICE = 1 << 18            # bytes worked on at once
BUFFER = 32 << 20          # bytes of text between two hand-overs of a mapper
BUCKET_BYTES = 8 << 20     # bytes of text per bucket
SHARD_BYTES = 1 << 20      # bytes of stretches per suffix array
NAMED_AT_ONCE = 1 << 12    # stretches of a bucket whose names are worked out together


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from every position on (fewer positions than bytes)."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data).data, strides=(1,))
    n = len(data) - GRAM + 1
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += words[8:8 + n]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out += words[16:16 + n]
    return ta.mix(out)


def window_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of neighbouring windows of one name: name, first window, windows, unit."""
    starts = np.zeros(0, dtype=np.int64)
    if len(data) >= LENGTH:
        span, width = LENGTH - GRAM + 1, 1
        low = _gram_hashes(data)
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:-(span - width)], low[span - width:])
        counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        units = np.repeat(np.arange(len(counts)), counts)
        starts = np.arange(len(units)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    if not len(starts):
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    names = low[starts]
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (units[1:] != units[:-1])
    first = np.flatnonzero(new)
    return names[first], starts[first], np.diff(np.append(first, len(names))), units[first]


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows as (rows, bytes, unit offsets, row of each unit, its place in the
    row's text); a text longer than a slice is cut into units that overlap by a window."""
    for batch in ta.slices(batches, limit=SLICE):
        data, offsets = ta.text_bytes(batch.column("text"))
        if len(offsets) == 2 and offsets[1] > 2 * SLICE:
            for at in range(0, int(offsets[1]) - LENGTH + 1, SLICE):
                piece = data[at:at + SLICE + LENGTH - 1]
                yield batch, piece, np.array([0, len(piece)]), np.zeros(1, np.int64), np.array([at])
        else:
            yield batch, data, offsets, np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)


def short_names(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a name (by its low half), and its high half, which tells names of a bucket
    apart; the few that it does not are told apart by their bytes later."""
    home = (names & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    return (home << np.uint64(32) | names >> np.uint64(32)).astype(np.int64)


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted bucket column."""
    if not len(buckets):
        return
    starts = _groups(buckets)
    for a, b in zip(starts, np.append(starts[1:], len(buckets))):
        yield int(buckets[a]), slice(a, b)


NAMES = "bucket int, asked boolean, names binary, docs binary"


def tell_names(buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Names of the documents by bucket.  ``asked`` rows hold each name once per
    buffer, others pairs whose name is known to repeat."""

    def hand_over(names: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not names:
            return
        name, doc = short_names(np.concatenate(names), buckets), np.concatenate(docs)
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        name, doc = name[new], doc[new]
        starts = _groups(name)
        many = np.diff(np.append(starts, len(name))) > 1
        known = np.repeat(many, np.diff(np.append(starts, len(name))))
        # one document asks for a name, the smallest; the others are answered already
        asked = np.zeros(len(name), dtype=bool)
        asked[starts] = True
        rows = []
        for ask, chosen in ((True, asked), (False, known)):
            own, own_doc = name[chosen], doc[chosen]
            home = own >> 32 if ask else own_doc % buckets
            order = np.lexsort((own, home))
            own, own_doc, home = own[order], own_doc[order], home[order]
            rows += [(b, ask, ta.pack_ints(own[s], True), ta.pack_ints(own_doc[s])) for b, s in _by_bucket(home)]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows[at:at + 64]), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))],
                ["bucket", "asked", "names", "docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, docs, size = [], [], 0
        for batch, data, offsets, rows, _ in _units(batches):
            name, _, _, unit = window_names(data, offsets)
            ids = batch.column("doc_id").to_numpy()[rows]
            names.append(name)
            docs.append(ids[unit])
            size += len(data)
            if size >= BUFFER:
                yield from hand_over(names, docs)
                names, docs, size = [], [], 0
        yield from hand_over(names, docs)

    return run


def _column(table: pa.Table, name: str, ascending: bool = False) -> np.ndarray:
    parts = [ta.unpack_ints(p, ascending) for p in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def shared_names(table: pa.Table) -> pa.Table:
    """(doc_id, name) of the names in a bucket that several documents have."""
    asked = table.filter(table.column("asked"))
    known = table.filter(pa.compute.invert(table.column("asked")))
    name, doc = _column(asked, "names", True), _column(asked, "docs")
    order = np.argsort(name, kind="stable")
    name, doc = name[order], doc[order]
    out_name, out_doc = _column(known, "names", True), _column(known, "docs")
    if len(name):
        starts = _groups(name)
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        chosen = np.repeat(several, np.diff(np.append(starts, len(name))))
        out_name, out_doc = np.concatenate([out_name, name[chosen]]), np.concatenate([out_doc, doc[chosen]])
    return pa.table({"doc_id": pa.array(out_doc, pa.int64()), "name": pa.array(out_name, pa.int64())})


STRETCHES = "bucket int, settled boolean, docs binary, variants binary, starts binary, counts binary, bytes binary"


def tell_stretches(buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches of shared names by bucket, with their bytes.  Equal stretches of a buffer
    are sent for their smallest document; in the others all of it goes, as
    ``settled`` rows say."""

    def hand_over(found: dict[bytes, list[tuple[int, int, int]]], homes: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        open_rows: dict[int, list] = {}
        settled: dict[int, list] = {}
        for piece, places in found.items():
            least = min(doc for doc, _, _ in places)
            count = len(piece) - LENGTH + 1
            for doc, variant, start in places:
                if doc == least:
                    open_rows.setdefault(homes[piece], []).append((doc, variant, start, count, piece))
                else:
                    settled.setdefault(doc % buckets, []).append((doc, variant, start, count, b""))
        for done, rows in ((False, open_rows), (True, settled)):
            if rows:
                columns = [(b, done, *(ta.pack_ints(np.array(c, np.int64)) for c in list(zip(*r))[:4]),
                            ta.pack_bytes(b"".join(x[4] for x in r))) for b, r in rows.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*columns), (
                        pa.int32(), pa.bool_(), *[pa.binary()] * 5))],
                    ["bucket", "settled", "docs", "variants", "starts", "counts", "bytes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[tuple[int, int, int]]] = {}
        homes: dict[bytes, int] = {}
        size = 0
        for batch, data, offsets, rows, places in _units(batches):
            name, start, count, unit = window_names(data, offsets)
            names = batch.column("names")
            wanted = names.values.to_numpy()[names.offsets[0].as_py():names.offsets[-1].as_py()].view(np.uint64)
            short = short_names(name, buckets).astype(np.uint64)
            lengths = np.diff(names.offsets.to_numpy())
            # names are wanted per document: tell them apart by the row
            of_row = np.repeat(np.arange(batch.num_rows), lengths).astype(np.uint64)
            chosen = np.isin(short ^ ta.mix(rows[unit].astype(np.uint64)), wanted ^ ta.mix(of_row))
            start, count, unit = start[chosen], count[chosen], unit[chosen]
            home = (short[chosen] >> np.uint64(32)).tolist()
            docs = batch.column("doc_id").to_numpy()[rows[unit]].tolist()
            variants = batch.column("variant").to_numpy()[rows[unit]].tolist()
            in_text = (start - offsets[unit] + places[unit]).tolist()
            raw = data.tobytes()
            for h, d, v, p, s, c in zip(home, docs, variants, in_text, start.tolist(), count.tolist()):
                piece = raw[s:s + c + LENGTH - 1]
                if piece in found:
                    found[piece].append((d, v, p))
                else:
                    found[piece] = [(d, v, p)]
                    homes[piece] = h
                    size += len(piece)
            size += len(docs)
            if size >= BUFFER // 2:
                yield from hand_over(found, homes)
                found, homes, size = {}, {}, 0
        yield from hand_over(found, homes)

    return run


def suffix_order(data: np.ndarray, stretch: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``LENGTH`` bytes or more, the windows, in the order of their bytes,
    and whether each ties with the one before it.

    Each suffix ends with its stretch, ``limits`` bytes on.  Larsson-Sadakane: ranks
    of the first 7 bytes (and the end, if it comes sooner) become ranks of 14, 28,
    56 bytes by pairing a suffix's rank with that of the suffix so many bytes on.
    A suffix alone with its rank is in its place and is not sorted again, and neither
    is one that no window is read on to: a window needs the one 28 bytes on, and
    those two need what is 14 bytes on.  Windows equal in what is compared stay in the
    order of their stretches, which is that of their places in ``data``.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.ndarray((n,), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    known, reach = 7, [7]
    while reach[-1] < LENGTH:
        reach.append(2 * reach[-1])
    # bytes that a suffix must have left for its rank to be asked for, once ranks cover so many bytes
    least = {reach[-1]: LENGTH}
    for longer, shorter in zip(reach[::-1], reach[-2::-1]):
        least[shorter] = max(1, least[longer] - shorter)
    short = np.minimum(limits, known).astype(np.uint64)
    cut = np.uint64(64) - short * np.uint64(8)
    keys = (keys >> cut) << cut | short
    at = np.arange(n)
    rank = np.zeros(n, dtype=np.int64)
    while len(at):
        order = np.argsort(keys)
        at, keys = at[order], keys[order]
        starts = _groups(keys)
        sizes = np.diff(np.append(starts, len(keys)))
        # the old rank is where the group begins; the new one counts on from there
        olds = _groups(rank[at])
        base = np.repeat(olds, np.diff(np.append(olds, len(at))))
        rank[at] = rank[at] + np.repeat(starts, sizes) - base
        if known >= LENGTH:
            break
        at = at[np.repeat(sizes > 1, sizes)]
        at = at[limits[at] >= max(known, least[2 * known])]
        on = np.minimum(at + known, n - 1)
        further = np.where(limits[at] > known, rank[on] + 1, 0)
        keys = (rank[at].astype(np.uint64) << np.uint64(32)) | further.astype(np.uint64)
        known *= 2
    windows = np.flatnonzero(limits >= LENGTH)
    windows = np.sort(rank[windows] << 32 | windows) & 0xFFFFFFFF
    tied = np.zeros(len(windows), dtype=bool)
    tied[1:] = rank[windows[1:]] == rank[windows[:-1]]
    return windows, tied


def common_prefixes(data: np.ndarray, windows: np.ndarray, tied: np.ndarray, limits: np.ndarray, place: np.ndarray,
                    stretch: np.ndarray) -> np.ndarray:
    """Common prefix of each window, in order, with the one before it, up to ``LENGTH``.

    Kasai's rule, for all stretches side by side: the window one byte on shares at
    least one byte less with its predecessor, so a prefix is read on, not anew.  That
    holds where the two windows differ in what was sorted by and the predecessor has
    a window one byte on as well; elsewhere reading starts again.  ``limits``,
    ``place`` and ``stretch`` are by byte: bytes left in the stretch, number in it,
    and which it is."""
    n = len(data)
    before, same_rank = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=bool)
    before[windows[1:]] = windows[:-1]
    same_rank[windows] = tied
    shared = np.zeros(n, dtype=np.int64)
    carried = np.zeros(int(stretch.max(initial=0)) + 1, dtype=np.int64)
    by_place = windows[np.argsort(place[windows], kind="stable")]
    bounds = np.append(_groups(place[by_place]), len(by_place)) if len(by_place) else []
    for a, b in zip(bounds, bounds[1:]):
        now = by_place[a:b]
        prior = before[now]
        have = np.where(same_rank[now], LENGTH, np.maximum(carried[stretch[now]] - 1, 0))
        have[prior < 0] = 0
        live = np.flatnonzero((have < LENGTH) & (prior >= 0))
        while len(live):
            same = data[now[live] + have[live]] == data[prior[live] + have[live]]
            live = live[same]
            have[live] += 1
            live = live[have[live] < LENGTH]
        shared[now] = have
        carried[stretch[now]] = np.where(~same_rank[now] & (limits[prior] > LENGTH), have, 0)
    return shared[windows]


class Shard:
    """Distinct stretches and their windows in order, equal windows as one group."""

    def __init__(self, pieces: list[bytes]) -> None:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        counts = lengths - LENGTH + 1
        stretch = np.repeat(np.arange(len(pieces)), lengths)
        place = np.arange(len(data)) - (ends - lengths)[stretch]
        limits = ends[stretch] - np.arange(len(data))
        suffixes, tied = suffix_order(data, stretch, limits)
        first = common_prefixes(data, suffixes, tied, limits, place, stretch) < LENGTH
        self.stretch = stretch[suffixes]
        self.number = (np.cumsum(counts) - counts)[self.stretch] + place[suffixes]   # in stretch order
        self.group = np.cumsum(first) - 1
        heads = suffixes[first]
        self.windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[heads].copy().view(f"S{LENGTH}").ravel() \
            if len(heads) else np.zeros(0, f"S{LENGTH}")

    def least(self, docs: np.ndarray) -> np.ndarray:
        """Smallest document of every group, from the smallest of every stretch."""
        return np.minimum.reduceat(docs[self.stretch], _groups(self.group)) if len(self.group) \
            else np.zeros(0, np.int64)

    def per_window(self, least: np.ndarray) -> np.ndarray:
        """A group's value at each window, in stretch order."""
        out = np.empty(len(self.number), dtype=np.int64)
        out[self.number] = least[self.group]
        return out


def merge_shards(shards: list[Shard], least: list[np.ndarray]) -> list[np.ndarray]:
    """Smallest documents over all shards: each shard's ordered windows are searched in the others'."""
    out = [v.copy() for v in least]
    for i, one in enumerate(shards):
        for j, other in enumerate(shards):
            if i != j and len(one.windows) and len(other.windows):
                at = np.minimum(np.searchsorted(other.windows, one.windows), len(other.windows) - 1)
                hit = other.windows[at] == one.windows
                out[i][hit] = np.minimum(out[i][hit], least[j][at[hit]])
    return out


def with_namesakes(pieces: list[bytes]) -> np.ndarray:
    """Which of some different stretches have their name in common with another one."""
    names = []
    for at in range(0, len(pieces), NAMED_AT_ONCE):
        heads = b"".join([p[:LENGTH] for p in pieces[at:at + NAMED_AT_ONCE]])
        names.append(window_names(np.frombuffer(heads, np.uint8), np.arange(0, len(heads) + 1, LENGTH))[0])
    _, which, sizes = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    return sizes[which] > 1


def repeated_windows(table: pa.Table) -> pa.Table:
    """(doc_id, variant, start, stop): runs of windows of a bucket that start in a smaller document too."""
    settled = table.filter(table.column("settled"))
    docs, variants, starts, counts = (_column(settled, c) for c in ("docs", "variants", "starts", "counts"))
    out = [(docs, variants, starts, starts + counts)]
    asked = table.filter(pa.compute.invert(table.column("settled")))
    docs, variants, starts, counts = (_column(asked, c) for c in ("docs", "variants", "starts", "counts"))
    if len(docs):
        raw = b"".join(map(ta.unpack_bytes, asked.column("bytes").to_pylist()))
        ends = np.cumsum(counts + LENGTH - 1).tolist()
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends], ends)])
        pieces = list(number)
        smallest = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(smallest, which, docs)
        widths = np.array([len(p) for p in pieces]) - LENGTH + 1
        first = np.concatenate([[0], np.cumsum(widths)])
        # equal windows have equal names, so a stretch without namesakes is the only one with its windows
        windows = np.repeat(smallest, widths)
        alike = with_namesakes(pieces)
        compared = np.flatnonzero(alike).tolist()
        shards, least = [], []
        at = 0
        while at < len(compared):
            end, size = at, 0
            while end < len(compared) and size < SHARD_BYTES:
                size += len(pieces[compared[end]])
                end += 1
            shards.append(Shard([pieces[i] for i in compared[at:end]]))
            least.append(shards[-1].least(smallest[compared[at:end]]))
            at = end
        if shards:
            merged = merge_shards(shards, least)
            windows[np.repeat(alike, widths)] = np.concatenate([s.per_window(m) for s, m in zip(shards, merged)])
        # every place of a stretch against the smallest document of each of its windows
        owner = np.repeat(np.arange(len(docs)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        gone = windows[first[which[owner]] + inside] < docs[owner]
        edge = np.ones(len(gone), dtype=bool)
        edge[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, len(gone)))
        begin, size = begin[gone[begin]], size[gone[begin]]
        found = owner[begin]
        out.append((docs[found], variants[found], starts[found] + inside[begin], starts[found] + inside[begin] + size))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "variant", "start", "stop"), columns)})


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ta.slices(batches):
        data, offsets = ta.text_bytes(batch.column("text"))
        runs = batch.column("runs")
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(runs).fill_null(0).to_numpy())
        variant, start, stop = (runs.flatten().field(c).to_numpy() for c in ("variant", "start", "stop"))
        # an id's runs, of which a row takes those of its own text
        own = variant == batch.column("variant").to_numpy()[row]
        at = offsets[row[own]]
        edges = np.zeros(len(data) + 1, dtype=np.int64)
        np.add.at(edges, at + start[own], 1)
        np.add.at(edges, at + stop[own] + LENGTH - 1, -1)
        gone = np.cumsum(edges[:-1]) > 0
        # a span begins where the byte before stays, or belongs to another text
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = gone[heads]
        before = np.concatenate([[0], np.cumsum(gone)])[offsets]
        spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
        left, ends = memoryview(data[~gone]), (offsets - before).tolist()
        kept = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(before)), pa.array(spans), pa.array(kept, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _variants(rows: DataFrame) -> DataFrame:
    """Numbers the different texts of ids that have several, from 0 on: (doc_id, text hash, variant)."""
    texts = rows.groupBy("doc_id", F.xxhash64("text").alias("_hash")).agg(F.lit(1).alias("_one"))
    several = texts.groupBy("doc_id").agg(F.collect_list("_hash").alias("_hashes")).filter(F.size("_hashes") > 1)
    return several.select(F.col("doc_id").alias("_id"), F.posexplode(F.array_sort("_hashes")).alias("_variant", "_hash"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A null text is empty.  Rows without an id neither lose bytes nor take them
    from others; rows of one id are one document, so they leave each other alone,
    whether their texts are equal or not.  Extra columns are not read.
    """
    rows = docs.select(ta.long_column(docs, "doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    # stored, so that its size, mostly nothing, is known when the texts meet it
    variants = materialize(_variants(rows.filter("doc_id is not null")), "variants")
    known = (rows.filter("doc_id is not null").join(
        variants, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
        .select("doc_id", "text", F.coalesce("_variant", F.lit(0)).cast("long").alias("variant")))
    names = (known.select("doc_id", "text").mapInArrow(tell_names(buckets), NAMES).groupBy("bucket")
             .applyInArrow(shared_names, "doc_id long, name long"))
    names = names.groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    # both joins ask for the texts by id; Spark shuffles them once
    dealt = known.repartition("doc_id")
    runs = (dealt.join(names, "doc_id").select("doc_id", "variant", "text", "names")
            .mapInArrow(tell_stretches(buckets), STRETCHES).groupBy("bucket")
            .applyInArrow(repeated_windows, "doc_id long, variant long, start long, stop long"))
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("variant", "start", "stop")).alias("runs"))
    none = F.lit(None).cast("array<struct<variant:long,start:long,stop:long>>")
    whole = (dealt.join(runs, "doc_id", "left").select("doc_id", "variant", "text", "runs")
             .unionByName(rows.filter("doc_id is null").withColumns({"variant": F.lit(0).cast("long"), "runs": none})))
    return whole.mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
