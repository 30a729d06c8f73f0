"""MinHash near-duplicates with odd sketches.

1. Every text becomes the set of its distinct word shingles (64-bit hashes).
   Texts of equal sets are one class, so copies cost nothing from here on.
2. A class keeps ``bands x rows`` MinHash samples.  The samples' parities, folded
   into a bitmap, are its odd sketch: the bits in which two sketches differ
   estimate how many samples differ, most precisely where few do.
3. Classes that agree on a whole band meet in a bucket, see ``components.settle``:
   copies of one original never meet pairwise, and no pair that could join two
   groups is left out.
4. Pairs whose sketches allow the wanted similarity are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm import textarrays as ta
from leakscope.llm.components import Allowed, settle
from leakscope.session import materialize, release

BANDS, ROWS = 24, 6
SKETCH_WORDS = 8          # of 64 bits
_MULTIPLIERS = ta.mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = ta.mix(np.arange(9001, 9001 + BANDS * ROWS, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text end to end, sorted in each text, and their
    number per text.  A text of fewer words is one shingle; without words it has none."""
    n = len(offsets) - 1
    begin, end = ta.word_spans(data, offsets)
    words = ta.sequence_hashes(ta.BYTE_CODES[ta.LOWER[data]], begin, end)
    first = np.searchsorted(begin, offsets, "left")
    length = np.diff(first)
    at = np.arange(len(words))
    texts = np.repeat(np.arange(n), length)
    stops = first[1:][texts]
    starts = at[(at + width <= stops) | (at == first[:-1][texts])]
    texts, stops = texts[starts], stops[starts]
    hashes = ta.sequence_hashes(words, starts, np.minimum(starts + width, stops))
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    return hashes[new], np.bincount(texts[new], minlength=n)


def min_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples x texts; ``starts`` are the beginnings of the (filled) texts' sets."""
    out = np.empty((len(_MULTIPLIERS), len(starts)), dtype=np.uint64)
    for i, (factor, shift) in enumerate(zip(_MULTIPLIERS, _SHIFTS)):
        out[i] = np.minimum.reduceat((hashes ^ shift) * factor, starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Texts x words: every sample flips the bit its number and value name."""
    bits = SKETCH_WORDS * 64
    names = ta.mix(samples + _SHIFTS[:, None]) % np.uint64(bits)
    texts = np.arange(samples.shape[1], dtype=np.int64)
    flips = np.bincount((names.astype(np.int64) + texts * bits).ravel(), minlength=bits * len(texts)) & 1
    return np.packbits(flips.astype(np.uint8).reshape(-1, 64), axis=1).view(">u8").astype(np.uint64).reshape(-1, SKETCH_WORDS)


def farthest(percent: int) -> int:
    """Differing sketch bits that pairs at the wanted similarity practically never exceed:
    the expected number at a similarity five standard deviations of the sample below."""
    wanted, samples, bits = percent / 100, len(_MULTIPLIERS), SKETCH_WORDS * 64
    low = wanted - 5 * (wanted * (1 - wanted) / samples) ** 0.5
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - low)))) + 1


def describe(width: int, sketches: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text: set size and signature, with band keys and odd sketch, or with the set itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.slices(batches):
            hashes, counts = shingle_sets(*ta.text_bytes(batch.column("text")), width)
            keys = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            if not sketches:
                yield pa.RecordBatch.from_arrays(
                    [*keys, ta.list_array(pa.array(ta.signed(hashes)), counts)], [*names, "shingles"])
                continue
            filled = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[filled]
            total, spread = np.zeros((2, len(counts)), dtype=np.uint64)
            bands = np.zeros((0, BANDS), dtype=np.uint64)
            sketch = np.zeros((0, SKETCH_WORDS), dtype=np.uint64)
            if len(filled):
                total[filled] = np.add.reduceat(hashes, starts)
                spread[filled] = np.add.reduceat(ta.mix(hashes ^ _SHIFTS[0]), starts)
                samples = min_hashes(hashes, starts)
                sketch = odd_sketches(samples)
                bands = np.zeros((BANDS, len(filled)), dtype=np.uint64)
                for row in range(ROWS):
                    bands = ta.mix(bands * np.uint64(31) + samples[row::ROWS])
                bands = (ta.mix(bands + np.arange(BANDS, dtype=np.uint64)[:, None])).T
            has = (counts > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(counts.astype(np.int64)), pa.array(ta.signed(total)), pa.array(ta.signed(spread)),
                 ta.list_array(pa.array(ta.signed(np.ascontiguousarray(bands).ravel())), has * BANDS),
                 ta.list_array(pa.array(ta.signed(np.ascontiguousarray(sketch).ravel())), has * SKETCH_WORDS)],
                [*names, "n_shingles", "_total", "_spread", "_bands", "_sketch"])

    return run


def differing(a: Column, b: Column, words: int = SKETCH_WORDS) -> Column:
    """Bits in which two sketches, arrays of longs, differ."""
    bits: Column = F.lit(0)
    for i in range(words):
        bits = bits + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return bits


def _similar(percent: int) -> Callable[[pa.Array, pa.Array], np.ndarray]:
    """Whether full sets reach the similarity; the sets are sorted and free of repetition."""

    def run(left: pa.Array, right: pa.Array) -> np.ndarray:
        lv, lo = left.values.to_numpy(), left.offsets.to_numpy()
        rv, ro = right.values.to_numpy(), right.offsets.to_numpy()
        good = np.zeros(len(left), dtype=bool)
        for i in range(len(left)):
            x, y = lv[lo[i]:lo[i + 1]].view(np.uint64), rv[ro[i]:ro[i + 1]].view(np.uint64)
            if not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            good[i] = both * 100 >= percent * (len(x) + len(y) - both)
        return good

    return run


def bit_rows(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows x words of a column of equally long lists."""
    return column.values.to_numpy()[column.offsets[0].as_py():column.offsets[-1].as_py()].view(np.uint64).reshape(-1, width)


def sizes_and_bits(traits: pa.StructArray, bits: str, width: int) -> list[np.ndarray]:
    return [traits.field("size").to_numpy(), bit_rows(traits.field(bits), width)]


def all_differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which every row of x differs from every row of y."""
    bits = np.zeros((len(x), len(y)), dtype=np.int64)
    for word in range(x.shape[1]):
        bits += np.bitwise_count(x[:, word][:, None] ^ y[:, word])
    return bits


def _allowed(percent: int) -> Allowed:
    """Pairs whose set sizes and sketches leave the similarity possible."""
    most = farthest(percent)

    def run(here: list[np.ndarray], there: list[np.ndarray]) -> np.ndarray:
        (a, x), (b, y) = here, there
        a = a[:, None]
        return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (all_differing(x, y) <= most)

    return run


def _grouped(docs: DataFrame, width: int, percent: int, key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_shingles, _group and component_id of every row; the last two are
    null without shingles, component_id also where a group has no id."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    measured = materialize(
        rows.mapInArrow(describe(width, True), "doc_id long, text_hash long, n_shingles long, _total long, "
                        "_spread long, _bands array<long>, _sketch array<long>")
        .withColumn("_row", F.monotonically_increasing_id()), "sketches")
    signature = ["n_shingles", "_total", "_spread"]
    classes = materialize(
        measured.filter("n_shingles > 0").groupBy(*signature).agg(
            F.min("_row").alias("_class"), F.min("doc_id").alias("_first"),
            F.min_by(F.struct("doc_id", "text_hash", "_bands", "_sketch"), "_row").alias("_one")), "classes")
    told = classes.select(F.col("_class").alias("node"), F.posexplode("_one._bands").alias("_no", "_key")).select(
        "node", F.xxhash64("_no", "_key").alias("bucket"))
    shared = told.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = materialize(told.join(shared, "bucket"), "members")
    # full sets of the classes that meet another one, made once for both rounds
    meeting = members.select(F.col("node").alias("_class")).distinct()
    wanted = classes.join(meeting, "_class", "left_semi").select(
        "_class", F.col("_one.doc_id").alias("_doc"), F.col("_one.text_hash").alias("_hash"))
    sets = materialize(
        rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
        .dropDuplicates(["_class"]).select("_class", "text")
        .mapInArrow(describe(width, False), "_class long, shingles array<long>"), "sets")

    traits = classes.select(F.col("_class").alias("node"), F.struct(
        F.col("n_shingles").alias("size"), F.col("_one._sketch").alias("sketch")).alias("trait"))
    contents = sets.withColumnsRenamed({"_class": "node", "shingles": "content"})

    def near(x: Column, y: Column) -> Column:
        return differing(x["sketch"], y["sketch"]) <= farthest(percent)

    labels = settle(members, traits, contents, near, lambda t: sizes_and_bits(t, "sketch", SKETCH_WORDS),
                    _allowed(percent), _similar(percent))
    release(members, sets)
    joined = classes.join(labels, F.col("_class") == F.col("node"), "left").withColumn(
        "_group", F.coalesce("component", "_class"))
    smallest = joined.groupBy("_group").agg(F.min("_first").alias("component_id"))
    found = joined.join(smallest, "_group").select(*signature, "_group", "component_id")
    return measured.join(found, signature, "left").select(
        "doc_id", "text_hash", "n_shingles", "_group", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept, for every row.

    Rows are linked where 100 x intersection >= percent x union of their shingle
    sets; component_id is the smallest id a row reaches, itself included.  Null,
    empty and blank texts have no shingles and link to nothing.  Repeated rows
    are each other's copies; an id that is null counts for nobody, and where no
    id is reached component_id is null and the row is kept.
    """
    out = _grouped(docs, width, percent, key)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.col("component_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of every group, in the columns they came in, whatever their names; rows
    without a shingle (null, empty and blank texts) stay, an empty table gives an empty one.

    The smallest id of a group stays, or any of its rows where none has an id; of
    rows that repeat it in id and text, one.
    """
    rows = _grouped(docs, width, percent)
    alike = (rows.filter("n_shingles > 0").groupBy("_group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n"))
                                    .alias("one")).select("one.doc_id", "one.text_hash", "one.n"))
    blank = rows.filter("n_shingles = 0").select("doc_id", "text_hash", F.lit(1).cast("long").alias("n")).distinct()
    kept = materialize(alike.union(blank).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"}), "kept")
    told = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash"))
    # only rows that repeat are shuffled with their texts, to take one of them
    single = told.join(kept.filter("n = 1"), same, "left_semi")
    several = told.join(kept.filter("n > 1"), same, "left_semi").dropDuplicates(["_id", "_text"])
    return single.union(several).select("document.*")
