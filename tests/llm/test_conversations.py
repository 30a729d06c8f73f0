"""Prefix trie and structure repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leakscope.llm import repair, trie, turns

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """Every prefix with its members, children first."""
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conversations[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(v)] for c, v in conversations.items()}
    members, children, totals, out = defaultdict(list), defaultdict(list), {}, []
    rebuilt = {}
    for c, said in own.items():
        taken = zlib.crc32(str(c).encode()) % 6
        root = c - abs(c) % 100 * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(root, [])[:taken] + said[taken:]
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        below = [totals[q] for q in children[path]]
        totals[path] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
        ends = sorted(c for c in members[path] if len(rebuilt[c]) == len(path))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]),
                    len(children[path]), *totals[path], digest(",".join(map(str, ends)))))
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute_edit(rows):
    """Uniform-cost search over (row, state) for the cheapest, then least, edit of (initial, fault) rows."""
    queue, seen = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        moves = [(5, "I", i, (None, x), x) for x in "ua"]
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                late = 5 if fault else 0
                moves += [(late, "K", i + 1, (i, None), role), *[(late + 1, "R", i + 1, (i, x), x) for x in "ua"]]
        for add, letter, at, made, role in moves:
            if (state, role) in STEPS:
                heapq.heappush(queue, (cost + add, audit + letter, at, STEPS[state, role], (*out, made)))


def brute_repair(rows):
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        said = conversations[c]
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        if code:
            said += [(t is not None, t or 0, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out, names = [], {"u": "user", "a": "assistant"}
    for c, said in conversations.items():
        said.sort()
        seen, faults = set(), []
        for _, _, role, text in said:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else
                          None if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        at = [t for known, t, _, _ in said if known]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        first = [role[:1] for _, _, role, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit, made = brute_edit(list(zip(first, faults)))
        lines = [f"{names[x]}:" if i is None else f"{names.get(x, said[i][2])}:{said[i][3]}" for i, x in made]
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    digest("\n".join(lines))))
    return out


def awkward_rows():
    rng = random.Random(5)
    rows = [(None, 1, "user", "lost"), (None, None, None, None), (7, None, None, None), (7, 3, "user", ""), (7, 3, "user", ""),
            (7, 3, "assistant", "tie."), (-5, 0, "user", "below zero."), (-105, 0, "user", "far below."), (0, 1, "user", "base."),
            (0, 2, "assistant", "Ünïcode ☃"), (1, 9, "User", "x" * 70000 + "!"), (2, 5, "tool", "no letter\x00 of ours?"),
            (300, -3, "", "  \n"), (301, 2**40, "system", "big turn.")]
    for c in range(400, 460):
        texts = [f"say {rng.randrange(3)}{rng.choice('.!? x')}" for _ in range(rng.randrange(1, 9))]
        rows += [(c, t, rng.choice(("system", "user", "user", "assistant", "assistant", "x")), text)
                 for t, text in enumerate(texts)]
    rows += [(500 + c, t, "user" if t % 2 == 0 else "assistant", f"the same {t}.") for c in range(30) for t in range(6)]
    # each conversation goes one turn further than the one before, as logs of a growing one do
    rows += [(700 + c, t, "user", f"step {t}") for c in range(40) for t in range(c)]
    return rows + [(900, t, "user" if t % 3 else "assistant", f"long {t % 90}.") for t in range(260)]


def results(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).selectExpr(
        "*", "1 AS depth", "2 AS _pos", "'z' AS _c", "3 AS size", "'q' AS _digest", "4 AS _k", "'l' AS lines")


def test_trie_of_awkward_conversations(conversations):
    assert results(trie.report(conversations)) == Counter(brute_trie(awkward_rows()))


def test_repair_of_awkward_conversations(conversations):
    assert results(repair.report(conversations)) == Counter(brute_repair(awkward_rows()))


def test_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert trie.report(nothing).count() == 0 and repair.report(nothing).count() == 0


def test_contraction_of_random_trees(spark):
    """Shapes that only raking or only splicing would be slow on: a path, a star, a comb, a random tree."""
    rng = random.Random(3)
    parents = {"path": [i - 1 for i in range(1, 300)], "star": [0] * 200, "comb": [max(0, i - 1 - i % 2) for i in range(1, 300)],
               "random": [rng.randrange(max(0, i - 4), i) for i in range(1, 300)]}
    for shape, up in parents.items():
        depth, kids, total = [0], Counter(up), [i * i + 1 for i in range(len(up) + 1)]
        for p in up:
            depth.append(depth[p] + 1)
        for i in range(len(up), 0, -1):
            total[up[i - 1]] += total[i]
        rows = [(i, depth[i], up[i - 1] if i else None, kids[i], i * i + 1) for i in range(len(up) + 1)]
        nodes = spark.createDataFrame(rows, "conv_id long, depth long, parent_conv_id long, n_children long, w long")
        got = {r["conv_id"]: r["total"] for r in trie.subtree_totals(nodes, {"total": F.col("w")}).collect()}
        assert got == dict(enumerate(total)), shape


def test_prefixes_of_a_long_conversation(spark, monkeypatch):
    """Sums carried over stretches are those of one window."""
    rows = [(c, d, f"h{d % 7}", 1, 50) for c in (1, 2) for d in range(1, 51)]
    said = spark.createDataFrame(rows, "conv_id long, depth long, _digest string, chars long, size long")
    whole = results(trie.prefixes(said))
    monkeypatch.setattr(trie, "STRETCH", 7)
    assert results(trie.prefixes(said)) == whole


def test_digest_chains_pieces_in_order(spark):
    pieces = [("a", i, None if i % 5 == 2 else f"p{i}") for i in range(500)] + [("b", 1, None), ("c", 1, "")]
    df = spark.createDataFrame(pieces, "k string, n long, piece string").orderBy(F.rand(2))
    want = {k: digest("-".join(p for x, _, p in pieces if x == k and p is not None)) for k in "abc"}
    assert dict(map(tuple, turns.chained_sha256(df, ["k"], ["n"], "piece", "sha", "-").collect())) == want


def kinds(text):
    faults = {"fine": None, "dead": "blank", "truncated": "truncated"}
    codes = [ord(c) - 97 for c in text]
    return [(repair.CLASSES[c // 3], faults[repair.FAULTS[c % 3]]) for c in codes]


def test_grammar_gives_back_the_strings():
    rng = random.Random(1)
    strings = [[rng.randrange(3) for _ in range(rng.randrange(1, 60))] for _ in range(40)] + [[1] * 9, [1] * 64, [2]]
    rules, rest = repair.re_pair(strings, 3)

    def spelled(x):
        return [x] if x < 3 else spelled(rules[x - 3][0]) + spelled(rules[x - 3][1])

    assert [[y for x in s for y in spelled(x)] for s in rest] == strings
    pairs = Counter(p for s in rest for p in zip(s, s[1:]))
    assert rules and all(n < 2 or p[0] == p[1] for p, n in pairs.items())


def test_edits_of_random_strings(spark):
    """Also cut into many short blocks, which takes two rounds of products."""
    rng = random.Random(2)
    strings = ["".join(chr(97 + rng.randrange(12)) for _ in range(n)) for n in [*range(1, 30), 300, 300]]
    want = Counter()
    for i, s in enumerate(strings):
        cost, audit, _ = brute_edit(kinds(s))
        want[str(i), s, cost, audit] += 1
    for size in (1000, 1):
        cut = [(str(i), at // size, s[at:at + size]) for i, s in enumerate(strings) for at in range(0, len(s), size)]
        got = repair.shortest_edits(spark.createDataFrame(cut, "_c string, _b long, _symbols string"))
        assert results(got) == want
