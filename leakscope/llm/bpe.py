"""Byte-level BPE over chunks of a text.

A long text is cut into overlapping chunks that are split into pre-tokens
independently.  The pattern never looks back, so two chunks that agree on one
boundary inside their overlap agree on all later ones: there they are stitched.
Where an overlap holds no common boundary (one run of letters longer than it)
the pattern goes on from the last certain boundary until one is met.  The pieces
are then encoded by the merge ranks, and their tokens hashed and decoded as they
come, chunk by chunk, so that a task holds one chunk at a time.  A text of one
chunk takes the same way without the shuffles between the steps.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import textarrays as ta

CHUNK = 1 << 15
OVERLAP = 256
# Characters a piece needs after it to be certain: "'l" may still become "'ll".
LOOKAHEAD = 2
# Pieces a worker keeps the tokens of; others are worked out again.
KNOWN_PIECES = 1 << 18


def parse_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}


class Codec:
    """Pre-token pattern, merge ranks, and the pieces met so far."""

    def __init__(self, file: bytes, pattern: str) -> None:
        ranks = parse_ranks(file)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: b",%d" % rank for rank in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def encode_piece(self, piece: str) -> list[int]:
        return self.merges._encode_single_piece(piece)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def piece(self, piece: str) -> tuple[int, bytes, bytes]:
        """How many tokens, their ids as text with a comma before each, and the bytes they stand for."""
        found = self.known.get(piece)
        if found is None:
            ids = self.encode_piece(piece)
            found = len(ids), b"".join([self.text_of[i] for i in ids]), self.decode(ids)
            if len(self.known) < KNOWN_PIECES and len(piece) <= 64:
                self.known[piece] = found
        return found

    def render(self, pieces: list[str]) -> tuple[np.ndarray, Rendered, Rendered]:
        """Tokens before each piece, and the ids and the decoded bytes of all pieces end to
        end.  Each different piece is looked at once; Arrow lays out the repetitions."""
        column = pa.array(pieces, pa.string()).dictionary_encode()
        different = [self.piece(p) for p in column.dictionary.to_numpy(zero_copy_only=False).tolist()]
        counts = np.array([d[0] for d in different], dtype=np.int64)[column.indices.to_numpy()]
        before = np.zeros(len(pieces) + 1, dtype=np.int64)
        np.cumsum(counts, out=before[1:])
        return before, *(Rendered(pa.array([d[i] for d in different], pa.large_binary()).take(column.indices))
                         for i in (1, 2))


class Rendered:
    """Byte strings end to end; any range of them is one stretch of the buffer."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = ta.text_bytes(column)

    def range(self, first: int, stop: int) -> memoryview:
        return memoryview(self.data)[self.offsets[first]:self.offsets[stop]]


class Digest:
    """Running count and hashes of one document's tokens."""

    def __init__(self) -> None:
        self.count, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, tokens: int, ids: memoryview, decoded: memoryview) -> None:
        if tokens:
            self.ids.update(ids if self.count else ids[1:])
            self.decoded.update(decoded)
            self.count += tokens

    def row(self) -> tuple[int, str, str]:
        return self.count, self.ids.hexdigest(), self.decoded.hexdigest()


def boundaries(pattern: regex.Pattern, chunk: str, last: bool) -> list[int]:
    """Where the pieces of a chunk that starts at a boundary begin and end, as far as is certain."""
    limit = len(chunk) if last else len(chunk) - LOOKAHEAD
    return [0] + [m.end() for m in pattern.finditer(chunk) if m.end() <= limit]


class Stitcher:
    """Joins the pre-tokens of a document's chunks, given in order."""

    def __init__(self, pattern: regex.Pattern) -> None:
        self.pattern = pattern
        self.tail = ""   # text after the last certain boundary

    def pieces(self, chunk: str, cuts: list[int], overlap: int, last: bool) -> list[str]:
        """The pieces that are certain now; ``overlap`` characters of the chunk were seen before."""
        text = self.tail + chunk[overlap:]
        shift = overlap - len(self.tail)     # place in the chunk of the text's first character
        known, out, at = set(cuts), [], 0
        # on from the certain boundary until it is one of the chunk's own
        while at < len(text) and at + shift not in known:
            end = self.pattern.match(text, at).end()
            if not last and end > len(text) - LOOKAHEAD:
                self.tail = text[at:]
                return out
            out.append(text[at:end])
            at = end
        ends = cuts[bisect.bisect_left(cuts, at + shift):]
        out.extend([chunk[a:b] for a, b in zip(ends, ends[1:])])
        self.tail = chunk[ends[-1]:] if ends else text[at:]
        return out


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, bool, str]]:
    """(number, characters seen before, whether it is the last, chunk)."""
    for number, at in enumerate(range(0, max(1, len(text)), size)):
        last = at + size + overlap >= len(text)
        yield number, overlap if number else 0, last, text[at:at + size + overlap]
        if last:
            return


def load(path: str) -> bytes:
    """The rank file; its size is bounded by the vocabulary."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    """One per Python worker, with the pieces it has met."""
    return Codec(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK,
                     overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    A null or empty text has no tokens and the hashes of nothing.  Rows count by
    themselves, whether their id is null or repeated; extra columns are not read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.length("text") <= chunk + overlap

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in ta.slices(batches):
            split = [codec.pattern.findall(text) for text in batch.column("text").to_pylist()]
            before, ids, decoded = codec.render([piece for pieces in split for piece in pieces])
            out, at = [], 0
            for pieces in split:
                digest, end = Digest(), at + len(pieces)
                digest.add(int(before[end] - before[at]), ids.range(at, end), decoded.range(at, end))
                out.append(digest.row())
                at = end
            yield _table([batch.column("doc_id")], out)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.slices(batches):
            for row, doc, text in zip(*[batch.column(c).to_pylist() for c in ("_row", "doc_id", "text")]):
                parts = list(chunks(text, chunk, overlap))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(parts)), pa.array([doc] * len(parts), pa.int64()),
                     *[pa.array(c) for c in zip(*parts)]],
                    ["_row", "doc_id", "number", "overlap", "last", "text"])

    def pre_tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _codec(ranks.value, pattern).pattern
        for batch in ta.slices(batches):
            cuts = [boundaries(split, text, last) for text, last in zip(
                batch.column("text").to_pylist(), batch.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cuts, pa.list_(pa.int32()))], [*batch.schema.names, "cuts"])

    def stitch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, stitcher, digest = _codec(ranks.value, pattern), None, None
        for batch in ta.slices(batches):
            out, ids = [], []
            for r in batch.to_pylist():
                if not r["number"]:
                    stitcher, digest = Stitcher(codec.pattern), Digest()
                pieces = stitcher.pieces(r["text"], r["cuts"], r["overlap"], r["last"])
                before, tokens, decoded = codec.render(pieces)
                digest.add(int(before[-1]), tokens.range(0, len(pieces)), decoded.range(0, len(pieces)))
                if r["last"]:
                    out.append(digest.row())
                    ids.append(r["doc_id"])
            yield _table([pa.array(ids, pa.int64())], out)

    part = "_row long, doc_id long, number long, overlap long, last boolean, text string"
    pieces = (rows.withColumn("_row", F.monotonically_increasing_id()).filter(~whole)
              .mapInArrow(cut, part))
    stitched = (pieces.repartition("_row", "number").mapInArrow(pre_tokenise, part + ", cuts array<int>")
                .repartition("_row").sortWithinPartitions("_row", "number").mapInArrow(stitch, schema))
    return rows.filter(whole).mapInArrow(encode, schema).unionByName(stitched)


def _table(keys: list[pa.Array], digests: list[tuple[int, str, str]]) -> pa.RecordBatch:
    count, ids, decoded = zip(*digests) if digests else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
