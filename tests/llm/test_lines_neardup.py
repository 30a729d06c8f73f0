import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from llm_cases import LOWER, PROSE, awkward, nothing, words  # noqa: F401

from leakscope.llm import lines, neardup
from leakscope.llm.queries import QUERIES


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def altered(rng, text, most):
    out = bytearray(text)
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        if kind == 0:
            out.insert(at, rng.choice(b"abc"))
        elif at < len(out):
            if kind == 1:
                del out[at]
            else:
                out[at] = rng.choice(b"abc")
    return bytes(out)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_banded_distance(distance):
    rng = random.Random(distance)
    left = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    right = [altered(rng, a, distance + 2) for a in left]
    got = lines.within_distance(left, right, distance)
    assert got.tolist() == [edits(a, b) <= distance for a, b in zip(left, right)]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_near_lines_share_a_code_and_few_parities(distance):
    rng = random.Random(10 + distance)
    for _ in range(300):
        a = bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(30, 60)))
        b = altered(rng, a, distance)
        data = np.frombuffer(a + b, np.uint8)
        starts, stops = np.array([0, len(a)]), np.array([len(a), len(a) + len(b)])
        of, codes = lines.segment_codes(lines.ta.BYTE_CODES[data], starts, stops, distance)
        assert set(codes[of == 0]) & set(codes[of == 1])
        odd = lines.parities(data, starts, stops).reshape(2, -1)
        assert sum(bin(int(x ^ y)).count("1") for x, y in zip(*odd)) <= 4 * distance


def brute_lines(rows, distance, per_edit):
    """removed lines of every (doc_id, text)."""
    first, seen = {}, []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for number, line in enumerate((text or "").split("\n")):
            line = line.encode().strip(b" \t\n\x0b\x0c\r").translate(bytes(LOWER.get(i, i) for i in range(256)))
            if line:
                first.setdefault(line, (doc, number))
                seen.append(((doc, text), number, line))
    groups, own = Groups(range(len(first))), list(first)
    place = {x: i for i, x in enumerate(own)}
    count = [Counter(x) for x in own]
    for i, a in enumerate(own):
        for j in range(i):
            most = min(distance, min(len(a), len(own[j])) // per_edit)
            if abs(len(a) - len(own[j])) <= most and sum(((count[i] - count[j]) | (count[j] - count[i])).values()) \
                    <= 2 * most and edits(a, own[j]) <= most:
                groups.join(i, j)
    out = {}
    for key, number, line in seen:
        keep = first[own[groups.find(place[line])]]
        if keep != (key[0], number):
            out.setdefault(key, []).append((number, keep != first[line], *keep))
    return out


def check_lines(docs, distance=2, per_edit=10):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    gone = brute_lines(rows, distance, per_edit)
    want = Counter()
    for key in rows:
        own = gone.get(key, [])
        want[key[0], 0 if key[1] is None else key[1].count("\n") + 1, len(own), sum(x[1] for x in own),
             ",".join(str(x[0]) for x in own), ",".join(f"{'' if x[2] is None else x[2]}:{x[3]}" for x in own)] += 1
    got = Counter(tuple(r) for r in lines.report(docs, distance, per_edit).collect())
    assert got == want


def test_lines(spark):
    rng = random.Random(7)
    pool = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(8)) for _ in range(25)]
    rows = []
    for doc in range(120):
        text = "\n".join(altered(rng, rng.choice(pool).encode(), 2).decode() for _ in range(rng.randint(0, 4)))
        rows.append((doc, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_lines(docs)
    check_lines(docs, 1)


def test_lines_of_every_length(spark):
    """Lines of 1 to 40 bytes with 0 to 3 edits, for several numbers of bytes an edit takes."""
    rng = random.Random(11)
    pool = [bytes(rng.choice(b"abcd") for _ in range(1 + i % 40)) for i in range(80)]
    rows = [(doc, "\n".join(altered(rng, rng.choice(pool), 3).decode() for _ in range(rng.randint(0, 8)))) for doc in range(110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_lines(docs)
    check_lines(docs, 2, 3)
    check_lines(docs, 3, 5)


def test_lines_of_awkward_documents(awkward, nothing):
    check_lines(awkward.filter("doc_id is not null and doc_id <> 2"))
    rows = lines.report(awkward).collect()
    assert len(rows) == awkward.count()
    by = [(r["doc_id"], r["n_removed"], r["kept_in"]) for r in rows]
    assert by.count((2, 1, "1:0")) == 2 and (1, 0, "") in by and (None, 1, "1:0") in by
    assert lines.report(nothing).count() == 0
    out = lines.dedup_lines(awkward)
    assert out.columns == awkward.columns
    # the rows that lose their only line go: both repeats of 2 and the copy without an id
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({1: 1, None: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 8: 1, 9: 1, 10: 1})
    assert lines.dedup_lines(nothing).count() == 0


def test_dedup_takes_the_lines_out(spark):
    long = "a line that is long enough to take part in the comparison"
    docs = spark.createDataFrame([(1, f"x\n{long}\ny", 0), (2, f"x\n  {long.upper()}!\ny", 0), (3, long, 0)],
                                 "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.dedup_lines(docs).collect()}
    assert got == {1: (f"x\n{long}\ny", len(long) + 4)}


def test_a_document_goes_with_most_of_its_words(spark):
    first = "please share this article\none two three four"
    docs = spark.createDataFrame([(1, first), (2, first + "s\nfive"), (3, "please share this articles\nown words of it, more than six"),
                                  (4, None), (5, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs, least_left=0.3).collect()} == {
        1: first, 3: "own words of it, more than six", 4: None, 5: ""}
    assert {r["doc_id"] for r in lines.dedup_lines(docs).collect()} == {1, 2, 3, 4, 5}


def shingles(text, width):
    found = words((text or "").translate(LOWER))
    return {tuple(found[i:i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    groups = Groups(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a) * 100 >= percent * len(b) and len(b) * 100 >= percent * len(a):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    groups.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            g = groups.find(i)
            least[g] = min(least.get(g, doc), doc)
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        component = least.get(groups.find(i)) if sets[i] else doc
        out[doc, len(sets[i]), component, component is None or doc == component] += 1
    return out


def check_components(docs, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = neardup.near_duplicates(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")
    assert Counter(map(tuple, found.collect())) == brute_components(rows, width, percent)


def test_components(spark, awkward, nothing):
    check_components(spark.read.parquet(f"{SMALL}/documents.parquet"), 3, 85)
    check_components(awkward, 3, 85)
    assert neardup.near_duplicates(nothing).count() == 0


def test_chains_and_crowds_of_near_copies(spark):
    """A group without a common centre: neighbours are linked, the ends are not."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    rows, text = [], [rng.choice(vocabulary) for _ in range(150)]
    for doc in range(60):
        rows.append((1000 - doc, " ".join(text)))
        text = list(text)
        text[rng.randrange(150)] = rng.choice(vocabulary)
    base = [rng.choice(vocabulary) for _ in range(120)]
    for doc in range(80):
        other = list(base)
        for _ in range(rng.randint(1, 5)):
            other[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((2000 + doc, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_components(docs, 3, 85)
    check_components(docs, 5, 80)


def test_sketch_bits_follow_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.85, 0.95):
        worst = 0
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            only = rng.integers(0, 1 << 63, int(2000 * (1 - share) / share), dtype=np.uint64)
            half = len(only) // 2
            sketches = [neardup.odd_sketches(neardup.min_hashes(np.concatenate([both, x]), np.array([0])))[0]
                        for x in (only[:half], only[half:])]
            worst = max(worst, sum(bin(int(a ^ b)).count("1") for a, b in zip(*sketches)))
        assert worst <= neardup.farthest(int(share * 100))


def test_keep_one(awkward, nothing):
    out = neardup.keep_one(awkward)
    assert out.columns == awkward.columns
    kept = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert kept[1] == 1 and 2 not in kept and {3, 4, 5, 7, 9, 10} <= set(kept)
    assert 8 not in kept          # document 1 twice over: the same shingles but for a few
    assert neardup.keep_one(nothing).count() == 0


def test_one_row_of_every_group_stays(spark):
    """Repeats of the kept row, and copies and near copies that have no id."""
    other = " ".join(f"word{i}" for i in range(60))
    rows = [(1, PROSE), (1, PROSE), (1, PROSE), (2, PROSE), (None, PROSE), (None, other), (None, other),
            (None, other + " more"), (None, "alone here"), (3, " "), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, neardup.keep_one(docs).collect()))
    without = [t for (d, t), n in got.items() for _ in range(n) if d is None]
    assert got[1, PROSE] == 1 and got[3, " "] == 1 and sum(got.values()) == 5
    assert len(without) == 3 and {"alone here", ""} < set(without) and without.count(other) + without.count(other + " more") == 1


def test_registered_line_dedup_finds_equal_short_lines(spark, tmp_path):
    long = "a line that is long enough to take part in the comparison"
    rows = [(1, f"all rights reserved.\n{long}\nx\n\nab"), (2, f"  ALL rights reserved.\n{long}!\ny\n\nac"), (3, "x\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_near"], r["removed"], r["kept_in"])
           for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (5, 0, 0, "", ""), 2: (5, 2, 1, "0,1", "1:0,1:1"), 3: (2, 2, 0, "0,1", "1:2,1:2")}
