"""Repair of damaged conversations: a grammar-compressed shortest edit.

A turn is one of twelve symbols, its role's class and its fault.  What an edit of a
stretch of turns costs is a matrix over the states of the wanted role order, from the
state before the stretch to the state after it, with the audit string of the cheapest
edit as a rope of the parts' audits.  Re-Pair turns the symbol strings of many
conversations into one grammar; each rule's matrix is the min-plus product of its two
sides, computed once and shared by all strings that use it.

Conversations are cut into blocks of bounded length, so one of any length is many
strings; the matrices of its blocks are multiplied in rounds of a fixed fan-in.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.turns import chained_sha256, place_turns
from leakscope.session import materialize

BLOCK = 4096
FAN_IN = 16

# Costs of the edits and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States of the wanted order (s?(ua)+)?: nothing yet, after system, after user, after assistant.
STATES = 4
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
# What may be inserted or given as a new role in a state.
FREE = {0: "u", 1: "u", 2: "a", 3: "u"}
NAMES = {"u": "user", "a": "assistant"}

CLASSES = "sua?"
FAULTS = ("fine", "dead", "truncated")
BROKEN = 1 << 60


def symbol(role_class: int, fault: int) -> int:
    return role_class * len(FAULTS) + fault


class Rope:
    """A string put together from parts, written out only when needed."""

    __slots__ = ("left", "right", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            at = stack.pop()
            if at.text is not None:
                yield at.text
            else:
                stack += (at.right, at.left)

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """By character, reading both only up to the first difference."""
        if self is other:
            return False
        a, b = (c for t in self.leaves() for c in t), (c for t in other.leaves() for c in t)
        for x in a:
            y = next(b, None)
            if x != y:
                return y is not None and x < y
        return next(b, None) is not None


Matrix = list[list[tuple[int, Rope] | None]]
_NOTHING = Rope("")


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1] < old[1])


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest way through any state in between; audits of equal cost are never each
    other's beginnings, so the least of the parts give the least of the whole."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        for q in range(STATES):
            best = None
            for r in range(STATES):
                x, y = a[p][r], b[r][q]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost <= best[0]:
                    found = (cost, Rope(None, x[1], y[1]))
                    if _better(found, best):
                        best = found
            out[p][q] = best
    return out


def _inserts() -> Matrix:
    """Any number of insertions; no cheapest edit passes a state twice."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        at, text = p, ""
        while out[p][at] is None:
            out[p][at] = (INSERT * len(text), Rope(text))
            at, text = STEPS[at, FREE[at]], text + "I"
    return out


INSERTS = _inserts()
# From each state to the end: cost and audit of what has to be inserted.
TAILS = [min((INSERTS[p][q][0], str(INSERTS[p][q][1])) for q in ACCEPTED if INSERTS[p][q]) for p in range(STATES)]


def terminal(x: int) -> Matrix:
    """Insertions in front of a turn, then the turn kept, given another role, or deleted."""
    role, fault = CLASSES[x // len(FAULTS)], FAULTS[x % len(FAULTS)]
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        moves = [(p, DELETE, "D")]
        if fault != "dead":
            extra = TRUNCATED if fault == "truncated" else 0
            if (p, role) in STEPS:
                moves.append((STEPS[p, role], extra, "K"))
            moves.append((STEPS[p, FREE[p]], REROLE + extra, "R"))
        for q, cost, letter in moves:
            new = (cost, Rope(letter))
            if _better(new, out[p][q]):
                out[p][q] = new
    return product(INSERTS, out)


TERMINALS = [terminal(x) for x in range(len(CLASSES) * len(FAULTS))]


def re_pair(strings: list[list[int]], first: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The rules, numbered from ``first``, and what is left of the strings: the most
    frequent pair of neighbours becomes a symbol until no pair is found twice."""
    symbols: list[int] = []
    for s in strings:
        symbols += [*s, -1]
    size = len(symbols)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(size - 1):
        if symbols[i] >= 0 and symbols[i + 1] >= 0:
            places[symbols[i], symbols[i + 1]].add(i)
    queue = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(queue)
    rules: list[tuple[int, int]] = []
    while queue:
        count, pair = heapq.heappop(queue)
        at = places.get(pair, ())
        if len(at) < 2:
            continue
        if len(at) != -count:
            heapq.heappush(queue, (-len(at), pair))
            continue
        new = first + len(rules)
        rules.append(pair)
        touched = set()
        for i in sorted(places.pop(pair)):
            j = after[i]
            if symbols[i] != pair[0] or j >= size or symbols[j] != pair[1]:
                continue  # a run of one symbol: its neighbour took it
            left, right = before[i], after[j]
            if left >= 0 and symbols[left] >= 0:
                places[symbols[left], pair[0]].discard(left)
                places[symbols[left], new].add(left)
                touched.add((symbols[left], new))
            if right < size and symbols[right] >= 0:
                places[pair[1], symbols[right]].discard(j)
                places[new, symbols[right]].add(i)
                touched.add((new, symbols[right]))
            symbols[i], symbols[j] = new, -2
            after[i] = right
            if right < size:
                before[right] = i
        for pair in touched:
            if len(places[pair]) > 1:
                heapq.heappush(queue, (-len(places[pair]), pair))
    rest: list[list[int]] = [[]]
    for x in symbols:
        if x == -1:
            rest.append([])
        elif x >= 0:
            rest[-1].append(x)
    return rules, rest[:-1]


def matrices(strings: list[str]) -> dict[str, Matrix]:
    """The matrix of every different string of symbols (letters from a), none of them empty."""
    different = sorted(set(strings))
    rules, rest = re_pair([[ord(c) - 97 for c in s] for s in different], len(TERMINALS))
    known = list(TERMINALS)
    for a, b in rules:
        known.append(product(known[a], known[b]))
    out = {}
    for text, left in zip(different, rest):
        matrix = known[left[0]]
        for x in left[1:]:
            matrix = product(matrix, known[x])
        out[text] = matrix
    return out


def _cells(matrix: Matrix) -> tuple[list[int], list[str]]:
    flat = [cell for row in matrix for cell in row]
    return [BROKEN if c is None else c[0] for c in flat], ["" if c is None else str(c[1]) for c in flat]


def _block_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, block, strings = (c.to_pylist() for c in batch.columns)
        cells = {s: _cells(m) for s, m in matrices(strings).items()}
        yield _blocks(conv, block, strings, [cells[s][0] for s in strings], [cells[s][1] for s in strings])


def _blocks(conv, block, strings, costs, audits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.string()), pa.array(block, pa.int64()), pa.array(strings, pa.string()),
         pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
        names=["_c", "_b", "_symbols", "_costs", "_audits"])


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of consecutive blocks; each row holds at most FAN_IN of them, in order."""
    for batch in batches:
        rows = []
        for conv, block, parts in zip(*[c.to_pylist() for c in batch.columns]):
            matrix = None
            for part in parts:
                cells = [None if c >= BROKEN else (c, Rope(a)) for c, a in zip(part["_costs"], part["_audits"])]
                one = [cells[p * STATES:(p + 1) * STATES] for p in range(STATES)]
                matrix = one if matrix is None else product(matrix, one)
            rows.append((conv, block, "".join(p["_symbols"] for p in parts), *_cells(matrix)))
        yield _blocks(*(zip(*rows) if rows else [()] * 5))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per turn: roles inserted before it, what becomes of it (k kept, u or a its
    new role, - deleted), and, at the last turn, roles inserted after it."""
    for batch in batches:
        for conv, symbols, audit in zip(*[c.to_pylist() for c in batch.columns]):
            state, front, out = 0, "", []
            for letter in audit:
                if letter == "I":
                    front += FREE[state]
                    state = STEPS[state, FREE[state]]
                    continue
                if letter == "D":
                    fate = "-"
                elif letter == "K":
                    fate = "k"
                    state = STEPS[state, CLASSES[(ord(symbols[len(out)]) - 97) // len(FAULTS)]]
                else:
                    fate = FREE[state]
                    state = STEPS[state, fate]
                out.append([front, fate, ""])
                front = ""
            out[-1][2] = front
            for at in range(0, len(out), BLOCK):
                piece = out[at:at + BLOCK]
                columns = list(zip(*piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(piece), pa.string()), pa.array(range(at, at + len(piece)), pa.int64()),
                     *[pa.array(c, pa.string()) for c in columns]], names=["_c", "_pos", "_front", "_fate", "_back"])


def shortest_edits(symbols: DataFrame) -> DataFrame:
    """Cheapest edit of every string: (_c, _b, _symbols) blocks to (_c, _symbols, cost, audit)."""
    kind = "_c string, _b bigint, _symbols string, _costs array<bigint>, _audits array<string>"
    blocks = materialize(symbols.select("_c", "_b", "_symbols").mapInArrow(_block_matrices, kind), "blocks")
    most = blocks.agg(F.max("_b")).first()[0] or 0
    while most:
        grouped = (blocks.groupBy("_c", F.floor(F.col("_b") / FAN_IN).alias("_up"))
                   .agg(F.sort_array(F.collect_list(F.struct("_b", "_symbols", "_costs", "_audits"))).alias("_parts")))
        blocks = materialize(grouped.mapInArrow(_multiply, kind), "blocks")
        most //= FAN_IN
    # the audit of one conversation is one value; which end is cheapest decides here
    ends = F.array_min(F.array(*[F.when(F.get("_costs", F.lit(q)) < BROKEN, F.struct(
        (F.get("_costs", F.lit(q)) + cost).alias("cost"), F.concat(F.get("_audits", F.lit(q)), F.lit(audit)).alias("audit")))
        for q, (cost, audit) in enumerate(TAILS)]))
    return blocks.withColumn("_end", ends).select("_c", "_symbols", "_end.cost", "_end.audit")


def faults(placed: DataFrame) -> DataFrame:
    """(_c, _pos, turn, _class, _fault): blank, duplicate, truncated or null, the first that holds."""
    copies = (placed.groupBy("_c", "_digest").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
              .filter("_n > 1").drop("_n"))
    plain = placed.select("_c", "_pos", "turn", "_digest", "role", F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")).alias("text"))
    marked = plain.join(copies, ["_c", "_digest"], "left")
    fault = (F.when(F.col("text") == "", "blank").when(F.col("_pos") > F.col("_first"), "duplicate")
             .when(~F.right("text", F.lit(1)).isin(".", "!", "?"), "truncated"))
    initial = F.substring("role", 1, 1)
    return marked.select("_c", "_pos", "turn", F.when(initial == "s", 0).when(initial == "u", 1).when(
        initial == "a", 2).otherwise(3).alias("_class"), fault.alias("_fault"))


def _lines(front: Column, body: Column, back: Column) -> Column:
    def added(roles: Column) -> Column:
        return F.transform(F.filter(F.split(roles, ""), lambda r: r != ""), lambda r: F.when(
            r == "u", F.lit("user:")).otherwise(F.lit("assistant:")))

    return F.concat(added(front), F.filter(F.array(body), lambda b: b.isNotNull()), added(back))


def repair(conversations: DataFrame, conv: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """The figures of every conversation, and its repaired turns.

    Figures: _c (the id as text, null: one space), gaps, blank, duplicate, truncated,
    illegal, cost, audit.  Turns: _c, _pos, lines (role:text, none where deleted).
    """
    rows = conversations.select(
        F.coalesce(F.col(conv).cast("string"), F.lit(" ")).alias("_c"), "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = materialize(place_turns(rows, "_c"), "turns")
    told = materialize(faults(placed), "faults")
    code = F.col("_class") * len(FAULTS) + F.when(F.col("_fault").isNull(), 0).when(
        F.col("_fault") == "truncated", 2).otherwise(1)
    one = F.struct("_pos", F.chr(97 + code).alias("_x"))
    blocks = (told.groupBy("_c", F.floor(F.col("_pos") / BLOCK).alias("_b"))
              .agg(F.sort_array(F.collect_list(one)).alias("_list"))
              .select("_c", "_b", F.array_join(F.transform("_list", lambda v: v["_x"]), "").alias("_symbols")))
    edited = materialize(shortest_edits(blocks), "edits")
    counts = told.groupBy("_c", "turn").agg(F.count("*").alias("_n"), *[
        F.count_if(F.col("_fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    wide = F.col("turn").cast("decimal(38,0)")
    counts = counts.groupBy("_c").agg(
        F.coalesce(F.max(wide) - F.min(wide) + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    # classes only, then every neighbouring pair once: su, ua and au overlap in one letter
    roles = F.translate("_symbols", "abcdefghijkl", "sssuuuaaa???")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.length(roles)), lambda i: F.substr(roles, i, F.lit(2))),
                     lambda p: F.length(p) == 2)
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    figures = edited.withColumn("illegal", illegal).join(counts, "_c").select(
        "_c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    fates = edited.select("_c", "_symbols", "audit").mapInArrow(
        _edits, "_c string, _pos bigint, _front string, _fate string, _back string")
    fate = F.col("_fate")
    body = F.when(fate == "k", F.concat_ws(":", "role", "text")).when(fate == "u", F.concat(F.lit("user:"), "text")).when(
        fate == "a", F.concat(F.lit("assistant:"), "text"))
    # merged, as the size of edits not yet written out is not known
    turns = placed.join(fates.hint("merge"), ["_c", "_pos"]).select("_c", "_pos", _lines(F.col("_front"), body, F.col("_back")).alias("lines"))
    return figures, turns


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as a hash of id and turn damages them: dropped, emptied, without sentence ends,
    repeated, or turned to the user's role."""
    space = F.lit(" ")
    code = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space),
                               F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), code.alias("_code")).filter("_code > 0")
    text = F.when(F.col("_code") == 1, F.lit("")).when(
        F.col("_code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_code") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def report(conversations: DataFrame) -> DataFrame:
    """Damages all conversations and repairs them: one row per original conv_id, null included.

    Null roles and texts are one space.  Turns that tie follow each other by role, then
    text; repeated rows are duplicates.  A role of no letter s, u or a in front is
    never kept.  A conversation without rows after the damage has zeros, an empty
    audit and the digest of nothing.  Extra columns are not looked at; an empty table
    has no rows.
    """
    figures, turns = repair(damage(conversations))
    digests = chained_sha256(
        turns.select("_c", "_pos", F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("_piece")),
        ["_c"], ["_pos"], "_piece", "_sha", "\n")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    ids = conversations.groupBy("conv_id").agg(F.count("*").alias("_n")).select("conv_id", key.alias("_c"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return ids.join(figures, "_c", "left").join(digests, "_c", "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in (
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("_sha", nothing).alias("repaired_sha256"))
