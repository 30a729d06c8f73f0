"""Minimum-cost maximum flow on stop-by-window grids, many graphs of a shape at once.

Graphs of routes with equally many stops differ only in capacities and costs, so a
batch of them is a set of arrays (window, stop, graph), and a step of the algorithm is
a step on all of them.  Successive cheapest paths: distances are corrected in sweeps
along the windows and the stops and back, then every graph is augmented along its own
path; graphs that are done leave the batch.  Node potentials and the source's side of
a minimum cut come with the flow, so anyone can check that no flow is larger and none
of its size is cheaper.

A stop whose cells all take one unit is a cut of one unit per window, which every
maximum flow fills.  As flow moves to later windows only, all of it then stays in its
window between two such stops.  What is left to solve are the stops before the first and
behind the last of them (``_parts``); where most cells are empty, that is little.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.operators.flow import spread

# Workers get the functions below with the task; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells (graphs x windows x stops) that are solved together: arrays that stay in a core's cache.
CELLS = 1 << 18

# The same where only cells that are not empty take memory, and bytes of input that are put together.
SPARSE_CELLS, BATCH_BYTES = 1 << 23, 8 << 20
ROWS_OUT = 10_000

LARGE_SHARE = 20

# A cell where nothing happened takes one unit for this.
EMPTY_PRICE = 100

KINDS = ("segment", "carry", "source", "sink")

# Arcs by the way they enter a node: from the source, the stop before and behind, the window before and behind.
_SOURCE, _RIGHT, _LEFT, _DOWN, _UP = range(5)
_BACK = np.array([_SOURCE, _LEFT, _RIGHT, _UP, _DOWN])


class _Relaxing:
    """Shortens distances along one kind of arc after the other, in arrays it keeps."""

    def __init__(self, dist: np.ndarray, cost: np.ndarray, cause: np.ndarray | None = None) -> None:
        windows, stops, n = dist.shape
        size = max(windows, stops) * n
        way, shorter = np.empty(size, dist.dtype), np.empty(size, bool)

        def step(at, before, code: int):
            goal = dist[at]
            parts = (arr[:goal.size].reshape(goal.shape) for arr in (way, shorter))
            return goal, dist[before], cost[code][at], None if cause is None else cause[at], code, *parts

        row, column = (lambda t: np.s_[t]), (lambda i: np.s_[:, i])
        self.steps = {
            _DOWN: [step(row(t + 1), row(t), _DOWN) for t in range(windows - 1)],
            _RIGHT: [step(column(i + 1), column(i), _RIGHT) for i in range(stops - 1)],
            _LEFT: [step(column(i), column(i + 1), _LEFT) for i in range(stops - 2, -1, -1)],
            _UP: [step(row(t), row(t + 1), _UP) for t in range(windows - 2, -1, -1)]}

    def __call__(self, code: int) -> bool:
        """All arcs of a kind in the order they follow each other; whether anything changed."""
        changed = False
        for goal, before, cost, cause, code, way, shorter in self.steps[code]:
            np.add(before, cost, out=way)
            np.less(way, goal, out=shorter)
            if shorter.any():
                changed = True
                np.minimum(goal, way, out=goal)
                if cause is not None:
                    np.copyto(cause, code, where=shorter)
        return changed


class Grids:
    """A batch of residual graphs: room and cost of the arcs that enter a node, by kind.

    ``load`` and ``price`` are arrays (window, stop, graph).  An arc without room costs
    infinity, so it never shortens a way, and nodes out of reach stay there.
    """

    def __init__(self, load: np.ndarray, price: np.ndarray, open_cells: np.ndarray, carry: int, carry_cost: int) -> None:
        windows, stops, n = load.shape
        self.shape, self.graphs = load.shape, np.arange(n)
        self.caps = load * open_cells
        # whole numbers below this are exact in 32 bits
        dear = max(100, abs(carry_cost)) * 2 * windows * stops
        self.base = np.zeros((5, windows, stops, n), np.float32 if dear < 1 << 24 else np.float64)
        self.base[_RIGHT, :, 1:] = price[:, :-1]
        self.base[_LEFT, :, :-1] = -price[:, :-1]
        self.base[_DOWN], self.base[_UP] = carry_cost, -carry_cost
        # no flow and no room exceeds a capacity
        self.room = np.zeros((5, windows, stops, n), np.int32 if max(carry, self.caps.max(initial=0)) < 1 << 31 else np.int64)
        self.room[_SOURCE, :, 0] = self.caps[:, 0]
        self.room[_RIGHT, :, 1:] = self.caps[:, :-1]
        self.room[_DOWN, 1:] = carry * open_cells[:-1]
        self.sink_room = self.caps[:, -1].astype(self.room.dtype)
        self.cost = np.where(self.room > 0, self.base, self.base.dtype.type(np.inf))

    def take(self, kept: np.ndarray) -> Grids:
        """Some graphs of the batch; they look up capacities and costs where they come from."""
        part, n = object.__new__(Grids), len(kept)
        part.caps, part.base, part.graphs = self.caps, self.base, self.graphs[kept]
        part.shape = (*self.shape[:2], np.count_nonzero(kept))
        places = np.flatnonzero(kept)
        for name in ("room", "sink_room", "cost"):
            old = getattr(self, name)
            setattr(part, name, np.take(old.reshape(-1, n), places, axis=1).reshape(*old.shape[:-1], -1))
        return part

    def flows(self) -> dict[str, np.ndarray]:
        """Flows by kind of arc, at the cell the arc leaves from (the cell it enters, from the source)."""
        found = {"source": self.caps[:, 0] - self.room[_SOURCE, :, 0], "sink": self.caps[:, -1] - self.sink_room,
                 "segment": self.room[_LEFT, :, :-1], "carry": self.room[_UP, :-1]}
        return {kind: flow.astype(np.int64) for kind, flow in found.items()}

    def distances(self) -> tuple[np.ndarray, np.ndarray]:
        """Distance of every node from the source, and the arc it was reached by."""
        dist = np.full(self.shape, np.inf, self.base.dtype)
        dist[:, 0] = self.cost[_SOURCE, :, 0]
        cause = np.zeros(dist.shape, np.int8)
        relax = _Relaxing(dist, self.cost, cause)
        # a kind leaves nothing to itself; after three others without a change nothing is left
        quiet, code = -1, 0
        order = (_DOWN, _RIGHT, _LEFT, _UP)
        while quiet < 3:
            quiet = 0 if relax(order[code]) else quiet + 1
            code = (code + 1) % 4
        return dist, cause

    def augment(self) -> tuple[np.ndarray, np.ndarray]:
        """Cheapest paths in every graph that has one: which have, and which nodes the source reaches.

        One path after the other would be the cheapest one, to the earliest window of several,
        with new distances for each.  Distances never shrink, and along nodes that no path of this
        round has touched neither they nor the arcs they came by change.  So the next end in that
        order is taken from the same distances as long as its path is apart from those before, and
        these have filled the ends they went to.
        """
        windows, stops, n = self.shape
        dist, cause = self.distances()
        ends = np.where(self.sink_room > 0, dist[:, -1], np.inf)
        order = ends.argsort(axis=0, kind="stable")
        found = ends[order[0], np.arange(n)] < np.inf
        graphs, touched = np.flatnonzero(found), np.zeros(windows * stops * n, bool)
        for place in range(windows):
            t = order[place, graphs]
            there = ends[t, graphs] < np.inf
            graphs = self._along(cause, touched, t[there], graphs[there])
            if not len(graphs):
                break
        return found, dist < np.inf

    def _along(self, cause: np.ndarray, touched: np.ndarray, t: np.ndarray, graphs: np.ndarray) -> np.ndarray:
        """Sends what fits along the paths to windows ``t``, if they are apart from touched nodes;
        returns the graphs where this was so and the end is full."""
        windows, stops, n = self.shape
        nodes, back_to = windows * stops, np.array([0, -1, 1, -stops, stops])
        room, cost, cause = self.room.reshape(-1), self.cost.reshape(-1), cause.reshape(-1)
        base = self.base.reshape(5 * nodes, -1)
        push, apart, steps = np.zeros(n, room.dtype), np.zeros(n, bool), []
        push[graphs], apart[graphs] = self.sink_room[t, graphs], True
        node, g = t * stops + stops - 1, graphs
        while len(g):
            at = node * n + g
            clear = ~touched[at]
            if not clear.all():
                apart[g[~clear]] = False
                node, g, at = node[clear], g[clear], at[clear]
            code = cause[at].astype(np.intp)
            arc = code * (nodes * n) + at
            push[g] = np.minimum(push[g], room[arc])
            node = node + back_to[code]
            steps.append((at, arc, _BACK[code] * (nodes * n) + node * n + g, g, code))
            if not code.all():
                going = code != _SOURCE
                node, g = node[going], g[going]
        if not steps or not apart.any():
            return graphs[:0]
        at, arc, back, g, code = (np.concatenate(p) for p in zip(*steps))
        taken = apart[graphs]
        if not taken.all():
            kept = apart[g]
            at, arc, back, g, code = at[kept], arc[kept], back[kept], g[kept], code[kept]
            t, graphs = t[taken], graphs[taken]
        touched[at] = True
        self.sink_room[t, graphs] -= push[graphs]
        room[arc] -= push[g]
        cost[arc[room[arc] == 0]] = np.inf
        inner = code != _SOURCE
        back, g = back[inner], g[inner]
        room[back] += push[g]
        cost[back] = base[back // n, self.graphs[g]]
        return graphs[self.sink_room[t, graphs] == 0]


def _potentials(load: np.ndarray, price: np.ndarray, open_cells: np.ndarray, flow: dict[str, np.ndarray], carry: int,
                carry_cost: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes, the source and the sink: no arc with room leads to a node whose
    potential is above that of its start and the arc's cost."""
    windows, stops, n = load.shape
    # no way is longer than this, so an arc that costs more shortens none
    dear = max(EMPTY_PRICE, abs(carry_cost)) * (2 * windows * stops + 1)
    kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or dear <= np.iinfo(k).max)
    far, caps = kind(dear), load if open_cells.all() else load * open_cells
    cost = np.empty((5, windows, stops, n), kind)
    paid = price[:, :-1].astype(kind)
    cost[_RIGHT, :, 1:] = np.where(flow["segment"] < caps[:, :-1], paid, far)
    cost[_LEFT, :, :-1] = np.where(flow["segment"] > 0, -paid, far)
    cost[_DOWN, 1:] = np.where(flow["carry"] < carry * open_cells[:-1], kind(carry_cost), far)
    cost[_UP, :-1] = np.where(flow["carry"] > 0, kind(-carry_cost), far)
    out_of_source, into_source = flow["source"] < caps[:, 0], flow["source"] > 0
    into_sink, out_of_sink = flow["sink"] < caps[:, -1], flow["sink"] > 0
    # no potential rises above 0
    pi, source, sink = np.zeros(load.shape, kind), np.zeros(n, kind), np.zeros(n, kind)
    relax = _Relaxing(pi, cost)
    changed = True
    while changed:
        ends = source.copy(), sink.copy()
        before = pi[:, 0].copy(), pi[:, -1].copy()
        np.minimum(pi[:, 0], np.where(out_of_source, source, kind(0)), out=pi[:, 0])
        down, right = relax(_DOWN), relax(_RIGHT)
        sink = np.minimum(sink, np.where(into_sink, pi[:, -1], kind(0)).min(axis=0))
        np.minimum(pi[:, -1], np.where(out_of_sink, sink, kind(0)), out=pi[:, -1])
        left, up = relax(_LEFT), relax(_UP)
        source = np.minimum(source, np.where(into_source, pi[:, 0], kind(0)).min(axis=0))
        changed = down or right or left or up or any((a != b).any() for a, b in zip(
            (*ends, *before), (source, sink, pi[:, 0], pi[:, -1])))
    return pi, source, sink


def solve(grids: Grids) -> np.ndarray:
    """Fills in the flows; returns the nodes the source still reaches, per graph."""
    reached = np.zeros(grids.shape, bool)
    work = grids
    while True:
        found, seen = work.augment()
        going = np.count_nonzero(found)
        # a graph that is done is left alone by further steps; leaving the batch copies the others
        if going > 0.7 * len(found):
            continue
        done = work.graphs[~found]
        reached[:, :, done] = seen[:, :, ~found]
        if work is not grids:
            for name in ("room", "sink_room"):
                getattr(grids, name)[..., done] = getattr(work, name)[..., ~found]
        if not going:
            break
        work = work.take(found)
    return reached


CELL = pa.struct([("window_index", pa.int32()), ("stop_index", pa.int32()), ("boardings", pa.int64()), ("tickets", pa.int64())])
USED = pa.struct([("window_index", pa.int32()), ("segment_index", pa.int32()), ("flow_units", pa.int64()), ("flow_cost", pa.int64())])
RESULT = ("total_flow bigint, total_cost bigint, used array<struct<window_index:int,segment_index:int,flow_units:bigint,"
          "flow_cost:bigint>>, loads array<bigint>, prices array<bigint>, source_flow array<bigint>, sink_flow array<bigint>, "
          "segment_flow array<bigint>, carry_flow array<bigint>, potentials array<bigint>, source_potential bigint, "
          "sink_potential bigint, reached array<boolean>, error string")
RESULT_TYPES = [pa.int64(), pa.int64(), pa.list_(USED), *[pa.list_(pa.int64())] * 7, pa.int64(), pa.int64(),
                pa.list_(pa.bool_()), pa.string()]


# As the bytes of long integers: cells that are not empty, with capacity and price, and arcs (kind and cell) with their flow where
# it is not one unit along a window.  Then a whole number per node, and a bit.
SHORT_PROOF = "cells binary, arcs binary, potentials binary, side binary, source_potential bigint, sink_potential bigint, "
SHORT_PROOF_TYPES = [*[pa.binary()] * 4, pa.int64(), pa.int64()]


def _lists(values: np.ndarray) -> pa.ListArray:
    """The arrays of a batch (window, stop, graph) or (window, graph) as one list per graph."""
    per_graph = np.ascontiguousarray(values.reshape(-1, values.shape[-1]).T)
    n, size = per_graph.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * size, pa.array(per_graph.reshape(-1)))


def _first_stop(load: np.ndarray, price: np.ndarray, carry: int, carry_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest flows of grids (window, graph) where all behind the first stop takes one unit per window.

    Units that leave the first stop in a window before their own wait behind it, ``carry``
    at most; waiting at the stop itself would save nothing.  So a window's state is the
    number that wait, and the best way to every state follows from the window before.
    Returns the units out of the first stop and those that wait after each window.
    """
    windows, n = load.shape
    most = max(0, min(carry, windows - 1))
    dear = 2 * windows * (most + 1) * max(100, carry_cost)
    kind = np.float32 if dear < 1 << 24 else np.float64
    waits = (np.arange(most + 1, dtype=kind) * carry_cost)[:, None]
    best = np.full((most + 1, n), np.inf, kind)
    best[0] = 0
    taken = np.empty((windows, most + 1, n), np.min_scalar_type(most + 1))
    way, better = np.empty_like(best), np.empty(best.shape, bool)
    for t in range(windows):
        before, best = best, np.full_like(best, np.inf)
        # one unit first, so that equally cheap flows stay in their window
        for units in (1, 0, *range(2, most + 2)):
            room = load[t] >= units
            if units > 1 and not room.any():
                break
            # the units of a window less the one that is due wait on
            to, since = (np.s_[units - 1:], np.s_[:most + 2 - units]) if units else (np.s_[:most], np.s_[1:])
            paid = price[t] * kind(units)
            if units > 1:
                paid = np.where(room, paid, kind(np.inf))
            some, less = way[to], better[to]
            np.add(before[since], paid, out=some)
            np.less(some, best[to], out=less)
            np.copyto(best[to], some, where=less)
            np.copyto(taken[t, to], units, where=less)
        best += waits
    out, waiting = np.empty((windows, n), np.int64), np.zeros((windows, n), np.int64)
    state, graphs = np.zeros(n, np.int64), np.arange(n)
    for t in range(windows - 1, -1, -1):
        waiting[t] = state
        out[t] = taken[t, state, graphs]
        state = state + 1 - out[t]
    return out, waiting


class _Cells(NamedTuple):
    """The cells of a batch of grids that are not empty: graph, window, stop, capacity, price, and whether boarded.

    An empty cell takes one unit for ``EMPTY_PRICE``."""

    at_g: np.ndarray
    at_t: np.ndarray
    at_i: np.ndarray
    load: np.ndarray
    price: np.ndarray
    boarded: np.ndarray

    def of(self, graphs: np.ndarray) -> _Cells:
        """The cells of some graphs, which are numbered anew.  Cells are in the order of their graphs."""
        first, behind = np.searchsorted(self.at_g, graphs), np.searchsorted(self.at_g, graphs, "right")
        sizes = behind - first
        at = np.repeat(behind - sizes.cumsum(), sizes) + np.arange(sizes.sum())
        return _Cells(np.repeat(np.arange(len(graphs)), sizes), *(values[at] for values in self[1:]))

    def grids(self, windows: int, low: int, high: int, n: int, opened: bool, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Capacity, price and whether a cell is open, as arrays (window, stop, graph) of the stops from ``low`` to before ``high``."""
        inside = (self.at_i >= low) & (self.at_i < high)
        at, shape = (self.at_t[inside], self.at_i[inside] - low, self.at_g[inside]), (windows, high - low, n)
        load, price, is_open = np.ones(shape, kind), np.full(shape, EMPTY_PRICE, kind), np.full(shape, opened)
        load[at], price[at] = self.load[inside], self.price[inside]
        is_open[at] |= self.boarded[inside]
        return load, price, is_open


def _parts(cells: _Cells, n: int, windows: int, stops: int, skip_empty: bool, carry: int,
           carry_cost: int) -> Iterator[tuple[np.ndarray, int, dict[str, np.ndarray], np.ndarray | None]]:
    """Flows of ``n`` grids where they may be other than one unit along every window: graphs, their first
    stop, flows by kind of arc, and the nodes the source still reaches if the part is the whole grid.

    With ``first`` and ``last``, the first and last stop where all cells take one unit, the maximum
    flow is one unit per window, and up to any window as much leaves ``first`` as enters ``last``:
    nothing waits in between.  Up to ``first`` and from ``last`` on the grid is a smaller one, whose
    sink or source takes one unit per window.  Behind ``last`` waiting pays only where a stop
    other than the last one has a cell with more room.
    """
    first, last = _single_stops(cells, n, stops)
    whole = first == stops
    if skip_empty or carry_cost <= 0:
        whole[:] = True

    def cut(chosen: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        graphs = np.flatnonzero(chosen)
        spans = low[graphs] * (stops + 1) + high[graphs]
        for span in np.unique(spans).tolist():
            some, (start, end) = graphs[spans == span], divmod(span, stops + 1)
            size = max(1, CELLS // (windows * (end - start)))
            for part in (some[begin:begin + size] for begin in range(0, len(some), size)):
                yield part, start, cells.of(part).grids(windows, start, end, len(part), not skip_empty)

    zero, all_stops = np.zeros(n, np.int64), np.full(n, stops)
    for graphs, start, (load, price, _) in cut(~whole & (first == 1), zero, first + 1):
        out, waiting = _first_stop(load[:, 0], price[:, 0], carry, carry_cost)
        waits = np.zeros((windows - 1, 2, len(graphs)), np.int64)
        waits[:, 1] = waiting[:-1]
        yield graphs, start, {"source": out, "segment": out[:, None], "carry": waits}, None
    for chosen, low, high in ((~whole & (first > 1), zero, first + 1), (~whole & (last < stops - 2), last, all_stops), (whole, zero, all_stops)):
        for graphs, start, described in cut(chosen, low, high):
            grids = Grids(*described, carry, carry_cost)
            reached, flow = solve(grids), grids.flows()
            if not whole[graphs[0]]:
                # the end that the rest of the grid goes on from
                flow.pop("sink" if low is zero else "source")
            yield graphs, start, flow, reached if whole[graphs[0]] else None


def _single_stops(cells: _Cells, n: int, stops: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last stop of each graph where all cells take one unit; ``stops`` and -1 where there is none."""
    wide = np.zeros((n, stops), bool)
    more = cells.load > 1
    wide[cells.at_g[more], cells.at_i[more]] = True
    none = wide.all(axis=1)
    return np.where(none, stops, wide.argmin(axis=1)), np.where(none, -1, stops - 1 - wide[:, ::-1].argmin(axis=1))


def _changes(flow: dict[str, np.ndarray], graphs: np.ndarray, start: int, windows: int, stops: int) -> tuple[np.ndarray, np.ndarray]:
    """Arcs with another flow than one unit along every window, numbered by graph, kind and cell, and their flows."""
    nodes, keys, units = windows * stops, [], []
    for kind, values in flow.items():
        t, *i, g = np.nonzero(values != (kind != "carry"))
        units.append(values[t, *i, g])
        stop = i[0] + start if i else 0 if kind == "source" else stops - 1
        keys.append((graphs[g] * len(KINDS) + KINDS.index(kind)) * nodes + t * stops + stop)
    return np.concatenate(keys), np.concatenate(units)


class _Solved(NamedTuple):
    """A batch of solved grids: its cells, totals, the segments told, and what a certificate needs."""

    cells: _Cells
    total_flow: np.ndarray
    total_cost: np.ndarray
    used: pa.ListArray
    # arcs with another flow than one unit along every window, numbered by graph, kind and cell
    arcs: np.ndarray
    units: np.ndarray
    # nodes on the source's side of a least cut: all stops up to one, or else those the source reaches
    up_to: np.ndarray
    reached: list[tuple[np.ndarray, np.ndarray]]


def _solved(cells: pa.ListArray, windows: int, stops: int, skip_empty: bool, carry: int, carry_cost: int, proof: bool) -> _Solved:
    """Graphs with equally many stops, from the cells where something happened."""
    n, places = len(cells), cells.flatten()
    fields = dict(zip((f.name for f in places.type), places.flatten()))
    at_t, at_i = fields["window_index"], fields["stop_index"]
    if cells.null_count or places.null_count or at_t.null_count or at_i.null_count:
        raise TypeError("a graph without cells, or a cell without its place")
    grid, nodes = np.arange(windows * stops).reshape(windows, stops), windows * stops
    at_g = np.repeat(np.arange(n), cells.value_lengths().to_numpy())
    listed, pieces = np.unique(at_g * nodes + grid[at_t.to_numpy(), at_i.to_numpy()], return_inverse=True)
    boardings, tickets = sums = np.zeros((2, len(listed)), np.int64)
    for total, name in zip(sums, ("boardings", "tickets")):
        np.add.at(total, pieces, fields[name].cast(pa.int64()).fill_null(0).to_numpy())
    load = np.maximum(1, boardings)
    missing = np.maximum(0, load - np.maximum(0, tickets))
    price = np.floor(missing / load * 100.0 + 0.5).astype(np.int64)
    known = _Cells(listed // nodes, listed % nodes // stops, listed % stops, load, price, boardings > 0)
    # what one unit along every window costs; then what other flows cost beyond that
    inner = known.at_i < stops - 1
    total_flow, total_cost = np.full(n, windows), np.full(n, EMPTY_PRICE * windows * (stops - 1))
    np.add.at(total_cost, known.at_g[inner], price[inner] - EMPTY_PRICE)
    arcs, units, reached = [], [], []
    for graphs, start, flow, seen in _parts(known, n, windows, stops, skip_empty, carry, carry_cost):
        if seen is not None:
            total_flow[graphs] = flow["source"].sum(axis=0)
            reached.append((graphs, seen))
        total_cost[graphs] += carry_cost * flow["carry"].sum(axis=(0, 1))
        changed = _changes(flow if proof else {"segment": flow["segment"]}, graphs, start, windows, stops)
        arcs.append(changed[0])
        units.append(changed[1])
    arcs, units = (np.concatenate([np.zeros(0, np.int64), *found]) for found in (arcs, units))
    order = arcs.argsort()
    arcs, units = arcs[order], units[order]
    # segments come first among the kinds
    of_segment = arcs // nodes % len(KINDS) == 0
    keys, flows = arcs[of_segment] // (nodes * len(KINDS)) * nodes + arcs[of_segment] % nodes, units[of_segment]
    np.add.at(total_cost, keys // nodes, _found(keys, listed, price, EMPTY_PRICE) * (flows - 1))
    used = _used(listed, keys, flows, price, total_cost, windows, stops)
    return _Solved(known, total_flow, total_cost, used, arcs, units, _single_stops(known, n, stops)[0], reached)


def _proofs(solved: _Solved, windows: int, stops: int, skip_empty: bool, carry: int, carry_cost: int) -> Iterator[tuple]:
    """Numbers of the first graph and behind the last one, and of those in between: capacities, prices, flows, potentials
    of nodes, source and sink, and the source's side of a least cut, as arrays whose last axis is the graph."""
    n, nodes = len(solved.total_flow), windows * stops
    size = max(1, CELLS // nodes)
    # no flow exceeds the largest capacity
    most = max(carry, EMPTY_PRICE, int(solved.cells.load.max(initial=1)))
    kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or most <= np.iinfo(k).max)
    whole = np.full(n, -1)
    for k, (graphs, _) in enumerate(solved.reached):
        whole[graphs] = k
    for low in range(0, n, size):
        high = min(n, low + size)
        load, price, opened = solved.cells.of(np.arange(low, high)).grids(windows, 0, stops, high - low, not skip_empty, kind)
        first, behind = np.searchsorted(solved.arcs, np.array([low, high]) * nodes * len(KINDS))
        flow = _dense(solved.arcs[first:behind] - low * nodes * len(KINDS), solved.units[first:behind], high - low, windows, stops, kind)
        side = np.broadcast_to(np.arange(stops)[:, None] <= solved.up_to[low:high], load.shape).copy()
        for k in np.unique(whole[low:high][whole[low:high] >= 0]).tolist():
            graphs, seen = solved.reached[k]
            here = (graphs >= low) & (graphs < high)
            side[:, :, graphs[here] - low] = seen[:, :, here]
        yield low, high, load, price, flow, _potentials(load, price, opened, flow, carry, carry_cost), side


def _columns(cells: pa.ListArray, windows: int, stops: int, skip_empty: bool, carry: int, carry_cost: int,
             proof: bool = True) -> list[pa.Array]:
    """Results of graphs with equally many stops, with every value of a proof in lists."""
    how = windows, stops, skip_empty, carry, carry_cost
    n, solved = len(cells), _solved(cells, *how, proof)
    short = [pa.array(solved.total_flow), pa.array(solved.total_cost), solved.used]
    if not proof:
        return [*short, *[pa.nulls(n, kind) for kind in RESULT_TYPES[3:]]]
    parts = [[*(_lists(v.astype(np.int64)) for v in (load, price, *(flow[k] for k in ("source", "sink", "segment", "carry")), pi)),
              *(pa.array(p.astype(np.int64)) for p in (source, sink)), _lists(side)]
             for _, _, load, price, flow, (pi, source, sink), side in _proofs(solved, *how)]
    if not parts:
        return [*short, *[pa.nulls(0, kind) for kind in RESULT_TYPES[3:]]]
    return [*short, *map(pa.concat_arrays, zip(*parts)), pa.nulls(n, pa.string())]


def _short_columns(cells: pa.ListArray, windows: int, stops: int, skip_empty: bool, carry: int, carry_cost: int,
                   proof: bool) -> list[pa.Array]:
    """Results of graphs with equally many stops; a proof leaves out empty cells and flows of one unit along a window,
    and has potentials and sides as bytes."""
    how = windows, stops, skip_empty, carry, carry_cost
    n, nodes, solved = len(cells), windows * stops, _solved(cells, *how, proof)
    columns = [pa.array(solved.total_flow), pa.array(solved.total_cost), solved.used]
    if proof:
        known = solved.cells
        for of_graph, *values in ((known.at_g, known.at_t * stops + known.at_i, known.load, known.price),
                                  (solved.arcs // (nodes * len(KINDS)), solved.arcs % (nodes * len(KINDS)), solved.units)):
            columns.append(_packed(np.stack(values, axis=1), np.searchsorted(of_graph, np.arange(n + 1))))
        parts = [(_bytes(pi), _bytes(np.packbits(side.reshape(nodes, -1), axis=0)), pa.array(source.astype(np.int64)), pa.array(sink.astype(np.int64)))
                 for *_, (pi, source, sink), side in _proofs(solved, *how)]
        columns += map(pa.concat_arrays, zip(*parts))
    return [*columns, pa.nulls(n, pa.string())]


def _bytes(values: np.ndarray) -> pa.BinaryArray:
    """The arrays of a batch, whose last axis is the graph, as the bytes of each graph."""
    per_graph = np.ascontiguousarray(values.reshape(-1, values.shape[-1]).T)
    return _packed(per_graph, np.arange(len(per_graph) + 1))


def _packed(rows: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """The bytes of the rows between each two bounds."""
    offsets = (bounds * rows.shape[1] * rows.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _found(keys: np.ndarray, known: np.ndarray, values: np.ndarray, otherwise: int) -> np.ndarray:
    """Values at some of the sorted keys ``known``, or else the usual one."""
    if not len(known):
        return np.full(len(keys), otherwise)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], otherwise)


def _used(listed: np.ndarray, keys: np.ndarray, flows: np.ndarray, price: np.ndarray, total_cost: np.ndarray, windows: int,
          stops: int) -> pa.ListArray:
    """Flow and cost of the segments that are told, from the listed cells and the segments ``keys`` where not one unit flows."""
    nodes, n = windows * stops, len(total_cost)
    at_i = listed % stops
    # a segment counts both of its ends
    ends = np.concatenate([listed[at_i < stops - 1], listed[at_i > 0] - 1])
    # where one unit may be a large share of the cost, any segment may be told
    cheap = np.flatnonzero(total_cost < EMPTY_PRICE * LARGE_SHARE)
    segments = np.arange(nodes).reshape(windows, stops)[:, :-1].reshape(-1)
    asked, origin = np.unique(np.concatenate([ends, keys, (cheap[:, None] * nodes + segments).reshape(-1)]), return_index=True)
    units = _found(asked, keys, flows, 1)
    cost = _found(asked, listed, price, EMPTY_PRICE) * units
    of_g = asked // nodes
    told = (units > 0) & ((origin < len(ends)) | (cost * LARGE_SHARE > total_cost[of_g]))
    of_g, place = of_g[told], asked[told] % nodes
    parts = (place // stops).astype(np.int32), (place % stops).astype(np.int32), units[told], cost[told]
    bounds = np.concatenate([[0], np.bincount(of_g, minlength=n).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(p) for p in parts], fields=[*USED]))


def _dense(arcs: np.ndarray, units: np.ndarray, n: int, windows: int, stops: int, kind: type = np.int64) -> dict[str, np.ndarray]:
    """Flows by kind of arc (window, stop, graph), from those that are not one unit along every window."""
    nodes, found = windows * stops, {}
    kinds, place, graph = arcs // nodes % len(KINDS), arcs % nodes, arcs // (nodes * len(KINDS))
    for code, (name, usual, (rows, stop)) in enumerate(zip(KINDS, (1, 0, 1, 1), (
            (windows, stops - 1), (windows - 1, stops), (windows, 1), (windows, 1)))):
        values, some = np.full((rows, stop, n), usual, kind), kinds == code
        t, i = place[some] // stops, place[some] % stops
        values[t, i if stop > 1 or code < 2 else 0, graph[some]] = units[some]
        found[name] = values if code < 2 else values[:, 0]
    return found


def _rows(cells: list[list[dict]], *how) -> list[tuple]:
    """The same from and to Python values."""
    return list(zip(*(c.to_pylist() for c in _columns(pa.array(cells, pa.list_(CELL)), *how))))


def _answer(columns: Callable, kinds: list[pa.DataType], cells: pa.ListArray, stops: int, how: tuple) -> list[pa.Array]:
    """Results of a batch of graphs; one that fails has its error."""
    def alone(cell: pa.ListArray) -> list[pa.Array]:
        try:
            return columns(cell, *how[:1], stops, *how[1:])
        except Exception as failure:
            return [*[pa.nulls(1, kind) for kind in kinds[:-1]], pa.array([f"{type(failure).__name__}: {failure}"])]

    try:
        return columns(cells, *how[:1], stops, *how[1:])
    except Exception:  # one bad graph must not fail the others
        return [pa.concat_arrays(parts) for parts in zip(*(alone(cells.slice(r, 1)) for r in range(len(cells))))]


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[str(n) for n in range(len(columns))])


def _solver(windows: int, skip_empty: bool, carry: int, carry_cost: int, proof: bool):
    how = windows, skip_empty, carry, carry_cost, proof

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            for stops, part in _by_shape(batch, batch.num_columns - 2, windows, CELLS if proof else SPARSE_CELLS):
                *keys, counts, cells = part.columns
                yield _batch([*keys, counts, *_answer(_columns, RESULT_TYPES, cells, stops, how)])

    return run


def _row_solver(keys: int, windows: int, skip_empty: bool, carry: int, carry_cost: int, sums: list[str], proof: bool):
    how = windows, skip_empty, carry, carry_cost, proof
    kinds = [pa.int64(), pa.int64(), pa.list_(USED), *(SHORT_PROOF_TYPES if proof else []), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_graphs(_joined(batches), keys):
            for stops, part in _by_shape(_graphs(rows, starts, keys, sums), keys, windows, SPARSE_CELLS):
                *found, error = _answer(_short_columns, kinds, part.column(keys + 1), stops, how)
                totals = [_segments(part.column(keys + 2), found[2], windows, stops, sums)] if sums else []
                solved = _batch([*part.columns[:keys + 1], *found, *totals, error])
                for first in range(0, len(solved), ROWS_OUT):
                    yield solved.slice(first, ROWS_OUT)

    return run


def _whole_graphs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first columns, cut where these change, and where each graph starts."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if not len(rows):
            continue
        other = np.zeros(len(rows) - 1, bool)
        for key in rows.columns[:keys]:
            one, next_one = key.slice(0, len(key) - 1), key.slice(1)
            other |= pc.fill_null(pc.not_equal(one, next_one), False).to_numpy(zero_copy_only=False)
            if key.null_count:
                other |= one.is_null().to_numpy(zero_copy_only=False) != next_one.is_null().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(other) + 1])
        # the last graph may go on
        held = rows.slice(starts[-1])
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1]
    if held is not None and len(held):
        yield held, np.zeros(1, np.int64)


def _graphs(rows: pa.RecordBatch, starts: np.ndarray, keys: int, sums: list[str]) -> pa.RecordBatch:
    """One row per graph: keys, number of stops, cells, and places with the segments they count in."""
    fixed = [c.take(pa.array(starts)) for c in rows.columns[:keys + 1]]
    window, stop, boardings, tickets, *totals = rows.columns[keys + 1:]
    inside = pc.fill_null(pc.greater_equal(window, 0), False)

    def lists(kept: pa.Array, kinds: pa.StructType, *columns: pa.Array) -> pa.ListArray:
        chosen = kept.to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], chosen.cumsum()])[np.append(starts, len(chosen))]
        values = [c.filter(kept).cast(f.type) for c, f in zip(columns, kinds)]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(values, fields=[*kinds]))

    columns = [*fixed, lists(pc.and_(inside, stop.is_valid()), CELL, window, stop, boardings, tickets)]
    if sums:
        kinds = pa.struct([("window_index", pa.int32()), *((name, pa.int64()) for name in sums), ("segments", pa.list_(pa.int32()))])
        columns.append(lists(pc.and_(inside, totals[-1].is_valid()), kinds, window, *totals))
    return _batch(columns)


def _segments(places: pa.ListArray, used: pa.ListArray, windows: int, stops: int, sums: list[str]) -> pa.ListArray:
    """Totals and flow of the segments that have either.  Nulls are left out of a total; one of nulls only is null
    where no flow is told."""
    nodes, n = windows * stops, len(places)
    rows = places.flatten()
    window, *totals, segments = rows.flatten()
    of_row = np.repeat(np.arange(len(rows)), segments.value_lengths().to_numpy())
    of_graph = np.repeat(np.arange(n), places.value_lengths().to_numpy())
    at = ((of_graph * windows + window.to_numpy())[of_row] * stops) + segments.flatten().to_numpy()
    told = used.flatten()
    at_t, at_i, units, cost = (told.field(k).to_numpy() for k in range(4))
    told_g = np.repeat(np.arange(n), pc.fill_null(used.value_lengths(), 0).to_numpy())
    told_at = (told_g * windows + at_t) * stops + at_i
    keys, back = np.unique(np.concatenate([at, told_at]), return_inverse=True)
    back, place = back[:len(at)], back[len(at):]
    with_flow = np.zeros(len(keys), bool)
    with_flow[place] = True
    found = [pa.array((keys % nodes // stops).astype(np.int32)), pa.array((keys % stops).astype(np.int32))]
    for values in totals:
        total, known = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        np.add.at(total, back, values.fill_null(0).to_numpy()[of_row])
        if values.null_count:
            known = with_flow.copy()
            known[back[values.is_valid().to_numpy(zero_copy_only=False)[of_row]]] = True
        found.append(pa.array(total, mask=~known))
    for values in (units, cost):
        flow = np.zeros(len(keys), np.int64)
        flow[place] = values
        found.append(pa.array(flow))
    bounds = np.searchsorted(keys, np.arange(n + 1) * nodes).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(found, fields=[*_segment_type(sums)]))


def _segment_type(sums: list[str]) -> pa.StructType:
    return pa.struct([("window_index", pa.int32()), ("segment_index", pa.int32()),
                      *((name, pa.int64()) for name in (*sums, "flow_units", "flow_cost"))])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``BATCH_BYTES``, since few of many graphs need the solver's steps."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.nbytes for b in waiting) >= BATCH_BYTES:
            yield pa.concat_batches(waiting)
            waiting = []
    if waiting:
        yield pa.concat_batches(waiting)


def _by_shape(batch: pa.RecordBatch, at: int, windows: int, cells: int = CELLS) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Graphs with equally many stops, which column ``at`` has, as many as are handled together."""
    counts = batch.column(at).to_numpy(zero_copy_only=False)
    shapes = np.unique(counts).tolist()
    for s in shapes:
        same = batch if len(shapes) == 1 else batch.take(pa.array(np.flatnonzero(counts == s)))
        size = max(1, cells // (windows * s))
        for first in range(0, len(same), size):
            yield s, same.slice(first, size)


def solve_grids(graphs: DataFrame, keys: list[str], windows: int, skip_empty: bool = False, carry: int = 5,
                carry_cost: int = 1, proof: bool = True) -> DataFrame:
    """One row per graph (keys, num_stops, cells): totals, used segments, and with ``proof`` what a certificate needs.

    ``cells`` lists (window_index, stop_index, boardings, tickets) where anything
    happened, in any number of pieces; null counts are 0.  ``used`` has the flows of
    segments at listed cells, and of any other that bears a ``LARGE_SHARE``-th of the
    cost.  A graph is bounded by the network it describes.  One that fails has its
    error and no result.
    """
    rows = graphs.select(*keys, F.col("num_stops").cast("int").alias("num_stops"), "cells")
    names = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(_solver(windows, skip_empty, carry, carry_cost, proof), f"{names}, num_stops int, {RESULT}")


def solve_rows(rows: DataFrame, keys: list[str], windows: int, skip_empty: bool = False, carry: int = 5,
               carry_cost: int = 1, sums: list[str] | None = None, proof: bool = False) -> DataFrame:
    """One row per graph (keys, num_stops): totals, used segments and error, from rows of the hours where anything happened.
    With ``proof`` also what a certificate needs, without what is the same in every grid (``SHORT_PROOF``).

    Rows have keys, num_stops, window_index, stop_index, boardings, tickets, and with ``sums`` these columns and
    ``segments``, the segments they count in, whose totals and flow come out as ``segments``.  A row outside all
    windows or stops is no cell.  Rows travel one by one and sorted, so that a graph's are next to each other;
    putting them into one row per graph before would cost more than solving it.
    """
    sums = sums or []
    taken = [*keys, F.col("num_stops").cast("int").alias("num_stops"), "window_index", F.col("stop_index").cast("int").alias("stop_index"),
             "boardings", "tickets", *([*sums, "segments"] if sums else [])]
    # by a hash first, as long integers are compared faster
    ordered = spread(rows.select(*taken), keys).sortWithinPartitions(F.xxhash64(*keys), *keys)
    names = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    totals = f"segments array<struct<window_index:int,segment_index:int,{''.join(f'{c}:bigint,' for c in sums)}flow_units:bigint,flow_cost:bigint>>, "
    run = _row_solver(len(keys), windows, skip_empty, carry, carry_cost, sums, proof)
    return ordered.mapInArrow(run, f"{names}, num_stops int, {RESULT[:RESULT.index('loads')]}{SHORT_PROOF if proof else ''}"
                                   f"{totals if sums else ''}error string")


PROOF = ["total_flow", "total_cost", "loads", "prices", "source_flow", "sink_flow", "segment_flow", "carry_flow",
         "potentials", "source_potential", "sink_potential", "reached"]
SHORT = ["total_flow", "total_cost", "cells", "arcs", "potentials", "side", "source_potential", "sink_potential"]
CHECKS = ["over_capacity", "unbalanced", "total_gap", "cost_gap", "cut_gap", "cheaper_ways"]


def _long_proof(proof: dict[str, pa.Array], windows: int, stops: int) -> tuple:
    """Capacities, prices, flows, potentials and sides as arrays whose last axis is the graph, from lists of all values."""
    n = len(proof["total_flow"])

    def grid(name: str, *shape: int) -> np.ndarray:
        values = proof[name].flatten().to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(np.moveaxis(values.reshape(n, *shape), 0, -1))

    flow = {"source": grid("source_flow", windows), "sink": grid("sink_flow", windows),
            "segment": grid("segment_flow", windows, stops - 1), "carry": grid("carry_flow", windows - 1, stops)}
    load, price, pi, reached = (grid(k, windows, stops) for k in ("loads", "prices", "potentials", "reached"))
    return load, price, flow, pi, reached


def _short_proof(proof: dict[str, pa.Array], windows: int, stops: int) -> tuple:
    """The same from a proof that leaves out empty cells and flows of one unit along a window."""
    n, nodes = len(proof["total_flow"]), windows * stops
    (cells, cell_bytes), (changed, changed_bytes), (pi, pi_bytes), (bits, _) = (_contents(proof[k]) for k in ("cells", "arcs", "potentials", "side"))
    places, loads, prices = cells.view(np.int64).reshape(-1, 3).T
    arcs, flows = changed.view(np.int64).reshape(-1, 2).T
    of_cell, of_arc = np.repeat(np.arange(n), cell_bytes // 24), np.repeat(np.arange(n), changed_bytes // 16)
    widths = pi_bytes // nodes
    if (widths == widths[0]).all():
        pi = pi.view(f"i{widths[0]}").reshape(n, nodes)
    else:
        pi = np.stack([one.view(f"i{width}").astype(np.int64) for one, width in zip(np.split(pi, pi_bytes.cumsum()[:-1]), widths)])
    reached = np.unpackbits(np.ascontiguousarray(bits.reshape(n, -1).T), axis=0, count=nodes).view(bool)
    # the narrowest whole numbers that hold a cost, or a sum of flows or potentials
    most = max(1, *(int(abs(v).max(initial=0)) for v in (loads, flows)))
    highest = max(EMPTY_PRICE, int(abs(prices).max(initial=0)))
    top = max(most * highest, 8 * most, 4 * (max(-int(pi.min()), int(pi.max()), 0) + highest))
    kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or top <= np.iinfo(k).max)
    load, price = np.ones((nodes, n), kind), np.full((nodes, n), EMPTY_PRICE, kind)
    load[places, of_cell], price[places, of_cell] = loads, prices
    flow = _dense(of_arc * nodes * len(KINDS) + arcs, flows, n, windows, stops, kind)
    grid = windows, stops, n
    return load.reshape(grid), price.reshape(grid), flow, np.ascontiguousarray(pi.T).astype(kind).reshape(grid), reached.reshape(grid)


def _contents(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values together, and how many each has."""
    values = values.cast(pa.binary())
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(b"" if data is None else data, np.uint8)[bounds[0]:bounds[-1]], np.diff(bounds)


def _faults(proof: dict[str, pa.Array], windows: int, stops: int, carry: int, carry_cost: int) -> list[np.ndarray]:
    """The checks of graphs with equally many stops."""
    load, price, flow, pi, reached = (_short_proof if "arcs" in proof else _long_proof)(proof, windows, stops)
    n = load.shape[-1]
    total_flow, total_cost, source_pi, sink_pi = (
        proof[k].to_numpy() for k in ("total_flow", "total_cost", "source_potential", "sink_potential"))
    yes, no = np.True_, np.False_
    # flow, capacity, cost, potentials and sides of the cut of both ends
    arcs = [(flow["source"], load[:, 0], 0, source_pi, pi[:, 0], yes, reached[:, 0]),
            (flow["sink"], load[:, -1], 0, pi[:, -1], sink_pi, reached[:, -1], no),
            (flow["segment"], load[:, :-1], price[:, :-1], pi[:, :-1], pi[:, 1:], reached[:, :-1], reached[:, 1:]),
            (flow["carry"], carry, carry_cost, pi[:-1], pi[1:], reached[:-1], reached[1:])]
    over, cheaper, cut, cost = (np.zeros(n, np.int64) for _ in range(4))

    def total(values: np.ndarray) -> np.ndarray | int:
        if values.dtype == bool and not values.any():
            return 0
        return values.reshape(-1, n).sum(axis=0, dtype=np.int64)

    for units, cap, price_of, start, end, inside, beyond in arcs:
        gain = price_of + start - end
        over += total((units < 0) | (units > cap))
        cheaper += total((units < cap) & (gain < 0)) + total((units > 0) & (gain > 0))
        cut += total(np.where(inside & ~beyond, cap, 0))
        cost += total(units * price_of)
    net = np.zeros_like(load)
    net[:, 0] += flow["source"]
    net[:, -1] -= flow["sink"]
    net[:, 1:] += flow["segment"]
    net[:, :-1] -= flow["segment"]
    net[1:] += flow["carry"]
    net[:-1] -= flow["carry"]
    sent = flow["source"].sum(axis=0, dtype=np.int64)
    return [over, np.zeros(n, np.int64) + total(net != 0), total_flow - sent, total_cost - cost, cut - total_flow, cheaper]


def certificate(solved: DataFrame, keys: list[str], windows: int, carry: int = 5, carry_cost: int = 1) -> DataFrame:
    """What a cheapest maximum flow must not have, counted per graph from flows and potentials.

    Arcs beyond their capacity, inner nodes that gain or lose flow, totals other than
    the flows', a cut of another size than the flow (no flow exceeds a cut, so equal
    sizes mean that both are best), and arcs with room along which the potentials say
    that flow could be led more cheaply.  For graphs where every cell has its arcs; all of
    a graph's arcs are checked, whether its proof lists them or not.
    """
    proof = SHORT if "arcs" in solved.columns else PROOF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stops, part in _by_shape(batch, len(keys), windows):
                found = _faults(dict(zip(proof, part.columns[len(keys) + 1:])), windows, stops, carry, carry_cost)
                yield _batch([*part.columns[:len(keys)], *(pa.array(c, pa.int64()) for c in found)])

    good = solved.filter(F.col("error").isNull()).select(*keys, "num_stops", *proof)
    names = ", ".join(f"`{k}` {good.schema[k].dataType.simpleString()}" for k in keys)
    return good.mapInArrow(run, ", ".join([names, *(f"{c} bigint" for c in CHECKS)]))
