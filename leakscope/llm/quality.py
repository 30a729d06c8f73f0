"""Quality rules: figures of each text, and lines that too many documents of a host share.

Lines are compared by a 64-bit hash of their lower-cased words.  A document tells
each of its distinct lines once; lines are then counted by host over distinct
documents (copies of one text count once), lines above a host's limit are
removed, and a document of which too little is left is rejected.  The count is a
two-step aggregate, so a line or host with a third of all rows is combined
before it is shuffled, and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm import textarrays as ta
from leakscope.session import materialize

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

SCHEMA = ("doc_id long, host string, text_hash long, " + ", ".join(f"{c} long" for c in FIGURES)
          + ", lines array<struct<line:long,words:int>>")


def _repeated_words(words: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in a window found twice or more in their text, by text."""
    count = len(words) - WINDOW + 1
    if count <= 0:
        return np.zeros(n, dtype=np.int64)
    at = np.arange(count)
    at = at[texts[at] == texts[at + WINDOW - 1]]
    codes = ta.sequence_hashes(words, at, at + WINDOW) ^ ta.mix(texts[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    hit = at[twice]
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + WINDOW, -1)
    return ta.per_text(np.cumsum(edges[:-1]) > 0, texts, n)


def _distinct_lines(codes: np.ndarray, words: np.ndarray, texts: np.ndarray, n: int
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lines of each text, the words they have in it, and how many there are per text."""
    keys = np.lexsort((codes, texts))
    codes, words, texts = codes[keys], words[keys], texts[keys]
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (codes[1:] != codes[:-1]) | (texts[1:] != texts[:-1])
    starts = np.flatnonzero(first)
    total = np.add.reduceat(words, starts) if len(starts) else words[:0]
    return codes[starts], total, np.bincount(texts[starts], minlength=n)


def line_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash of the lower-cased words, word range, start, stop and text of every line."""
    starts, stops, line_text = ta.line_spans(data, offsets)
    begin, end = ta.word_spans(data, offsets)
    first = np.searchsorted(begin, starts, "left")
    last = np.searchsorted(begin, stops, "left")
    lowered = ta.sequence_hashes(ta.BYTE_CODES[ta.LOWER[data]], begin, end)
    return ta.sequence_hashes(lowered, first, last), first, last, starts, stops, line_text


def figures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures and distinct lines of every document of (doc_id, host, text_hash, text)."""
    for batch in ta.slices(batches):
        n = batch.num_rows
        data, offsets = ta.text_bytes(batch.column("text"))
        begin, end = ta.word_spans(data, offsets)
        word_text = ta.owners(offsets, begin)
        plain = ta.BYTE_CODES[data]
        words = ta.sequence_hashes(plain, begin, end)
        symbols = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_SYMBOL[data], out=symbols[1:])
        codes, first, last, starts, stops, line_text = line_codes(data, offsets)
        filled = last > first
        in_line = (last - first)[filled].astype(np.int32)
        exact = ta.sequence_hashes(plain, starts[filled], stops[filled])
        texts = line_text[filled]
        _, _, different = _distinct_lines(exact, in_line, texts, n)
        line, in_text, per_doc = _distinct_lines(codes[filled], in_line, texts, n)
        pairs = pa.StructArray.from_arrays(
            [pa.array(ta.signed(line)), pa.array(in_text.astype(np.int32))], ["line", "words"])
        columns = [
            batch.column("doc_id"), batch.column("host"), batch.column("text_hash"),
            pa.array(np.bincount(word_text, minlength=n)),
            pa.array(ta.per_text(ta.lengths_in_characters(data, begin, end), word_text, n)),
            pa.array(symbols[offsets[1:]] - symbols[offsets[:-1]]),
            pa.array(np.bincount(texts, minlength=n) - different),
            pa.array(_repeated_words(words, word_text, n)),
            ta.list_array(pairs, per_doc)]
        yield pa.RecordBatch.from_arrays(
            columns, ["doc_id", "host", "text_hash", *FIGURES, "lines"])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def frequent_lines(measured: DataFrame, fraction: float, at_least: int) -> DataFrame:
    """(host, line) in more than max(at_least, fraction x distinct documents of the host)."""
    told = measured.select("host", "text_hash", F.explode("lines.line").alias("line"))
    counts = (told.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("_one"))
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
              .filter(F.col("docs") > at_least))
    hosts = (measured.groupBy("host", "text_hash").agg(F.lit(1).alias("_one"))
             .groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")))
    return (counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
            .filter(F.col("docs") > F.col("host_docs") * fraction)
            .select(F.col("c.host").alias("host"), "line", "docs"))


def judge(docs: DataFrame, host: str = "source", fraction: float = 0.2, at_least: int = 20,
          least_left: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, text_hash, the figures,
    base_failed, n_removed_lines and n_removed_words (lines above the host's
    limit), removed (their hashes) and kept.

    A text that is null or has no words fails the base rule.  Rows without a
    host form one host, repeated rows get equal verdicts, and extra columns
    are not read.
    """
    measured = materialize(
        docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"),
                    F.xxhash64("text").alias("text_hash"), "text")
        .mapInArrow(figures, SCHEMA).withColumn("_row", F.monotonically_increasing_id()), "quality")
    frequent = frequent_lines(measured, fraction, at_least)
    told = measured.select("_row", "host", F.explode("lines").alias("_l"))
    hits = (told.alias("t").join(frequent.alias("f"), F.col("t.host").eqNullSafe(F.col("f.host"))
                                 & (F.col("t._l.line") == F.col("f.line")))
            .groupBy("_row").agg(F.sum("_l.words").alias("_words"), F.collect_list("_l.line").alias("removed")))
    out = measured.drop("lines").join(hits, "_row", "left")
    gone = F.coalesce("_words", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "host", "text_hash", *FIGURES, base_failed().alias("base_failed"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed_lines"), gone.alias("n_removed_words"),
        "removed", (~base_failed() & (F.col("n_words") - gone >= F.lit(least_left) * F.col("n_words"))).alias("kept"))


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose hashes are in the last column."""
    for batch in ta.slices(batches):
        gone = batch.column(batch.num_columns - 1).to_pylist()
        texts = batch.column("text").to_pylist()
        data, offsets = ta.text_bytes(batch.column("text"))
        codes, first, last, starts, stops, line_text = line_codes(data, offsets)
        edges = np.searchsorted(line_text, np.arange(batch.num_rows + 1))
        codes = ta.signed(codes)
        for i, lines in enumerate(gone):
            if lines:
                own = slice(edges[i], edges[i + 1])
                stay = ~(np.isin(codes[own], lines) & (last[own] > first[own]))
                texts[i] = b"\n".join(bytes(data[a:b]) for a, b in zip(
                    starts[own][stay], stops[own][stay])).decode()
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field("text"), pa.array(texts, pa.string())).select(
            list(range(batch.num_columns - 1)))


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept documents in the columns they came in, whatever their names, without their
    frequent lines.  Null and blank texts fail the base rule and go; repeated rows share
    one verdict; an empty table gives an empty one."""
    verdicts = judge(docs, host, **limits)
    wanted = (verdicts.filter("kept").groupBy("doc_id", "host", "text_hash")
              .agg(F.first("removed").alias("removed")))
    removed = "removed_" + "_".join(docs.columns)
    same = (F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col(f"d.{host}").eqNullSafe(F.col("w.host"))
            & (F.xxhash64("d.text") == F.col("w.text_hash")))
    rows = (docs.alias("d").join(wanted.alias("w"), same)
            .select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("w.removed").alias(removed)))
    out = rows.mapInArrow(_without, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
