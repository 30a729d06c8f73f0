"""Turns of conversations in order, and digests over many rows that no task holds at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.operators.ordered import index_in_groups

# Rows that tie are compared by this many characters, then by a digest: a range
# partitioning collects samples of its keys, which must not hold whole texts.
TIE_CHARS = 64


def content_digest(role: Column, text: Column) -> Column:
    """128 bits that tell a turn's role and text."""
    return F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text))


def place_turns(rows: DataFrame, conv: str) -> DataFrame:
    """Rows (conv, turn, role, text) with ``_digest`` and their ``_pos`` in the conversation.

    Ordered by turn (null first), then role and text, so that repeated rows are
    neighbours; a conversation of any length is spread over tasks.
    """
    keyed = rows.select(
        conv, "turn", "role", "text", content_digest(F.col("role"), F.col("text")).alias("_digest"),
        F.substring("role", 1, TIE_CHARS).alias("_role"), F.substring("text", 1, TIE_CHARS).alias("_text"),
        F.rand(1).alias("_salt"))
    placed = index_in_groups(keyed, conv, ["turn", "_role", "_text", "_digest", "_salt"], "_pos")
    return placed.select(conv, "turn", "role", "text", "_digest", "_pos")


def chained_sha256(rows: DataFrame, keys: list[str], order: list[str], piece: str, name: str,
                   between: str) -> DataFrame:
    """SHA-256 of each key's pieces in order, joined by ``between``; null pieces are left out.

    The digest is a chain, so one task reads a key's pieces one after the other;
    it holds one batch of them.  Keys whose pieces are all null have the digest of nothing.
    """
    sorted_rows = (rows.select(*keys, *order, piece).repartition(*keys)
                   .sortWithinPartitions(*keys, *order).select(*keys, piece))
    schema = sorted_rows.select(*keys, F.lit("").alias(name)).schema
    return sorted_rows.mapInArrow(_digester(len(keys), between), schema)


def _digester(n_keys: int, between: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, key, state, empty, fields = between.encode(), None, None, True, None
        for batch in batches:
            fields = batch.schema
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if state is None or row[:n_keys] != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state, empty = row[:n_keys], hashlib.sha256(), True
                if row[n_keys] is not None:
                    if not empty:
                        state.update(joint)
                    state.update(row[n_keys].encode())
                    empty = False
            yield _batch(done, fields)
        if state is not None:
            yield _batch([(*key, state.hexdigest())], fields)

    def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * (n_keys + 1)
        types = [*[fields.field(i).type for i in range(n_keys)], pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          names=[str(i) for i in range(n_keys + 1)])

    return run
