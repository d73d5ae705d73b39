"""Prefix trie, list ranking and running states against plain Python."""

import hashlib
import random
import zlib

import pytest

from serupa.llm import prefix_trie as T
from serupa.llm.scans import running

SCHEMA = "conv_id long, turn long, role string, text string, depth string, v string, n_convs string, id string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c > 0 else -1)
        built = own.get(first, [])[:h] + turns[h:]
        ends.setdefault(tuple(built), []).append(c)
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_saved + sum(saved[x] for x in children.get(node, ()))
        leaves[node] = sum(leaves[x] for x in children[node]) if node in children else 1
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children.get(node, ())), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def check(spark, rows):
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    found = T.trie(table)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def made(seed, convs, turns=10, words=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), f"é{r.randint(1, words)}") for c in convs for t in range(r.randint(0, turns))]


@pytest.fixture
def small(monkeypatch):
    """Many parts, several rounds of mates and pieces of lists."""
    monkeypatch.setattr(T, "PART_ARCS", 7)
    monkeypatch.setattr(T, "FINISH", 4)
    monkeypatch.setattr(T, "PIECE", 3)


def test_trie_equals_brute_force(spark):
    check(spark, made(1, range(60)))


def test_trie_in_many_parts(spark, small):
    check(spark, made(2, range(-12, 40), 6, 2))


def test_odd_rows(spark, small):
    rows = made(3, [5, 6, 7, 8, 20, 23]) + [(None, 0, "user", "lost"), (5, None, None, None), (5, None, "user", "first"), (6, 3, "user", "tie"), (6, 3, "user", "tie"), (6, 3, "a", "tie")]
    rows += [(9, 0, None, "x" * 100_000), (31, 1, "", ""), (32, 1, None, None), (2, 0, "u", "no first conversation"), ((1 << 62) + 1, 0, "u", "far")]
    check(spark, rows)


def test_hot_conversation_and_hot_sequence(spark):
    """One conversation holds most rows; many others are copies of each other or share their first turn."""
    rows = [(4, i, "u", f"t{i}") for i in range(700)]
    rows += [(c, t, "u", f"same {t}") for c in range(10, 130) for t in range(3)]
    rows += [(c, t, "u", "hello" if t == 0 else f"{c}") for c in range(130, 230) for t in range(2)]
    check(spark, rows)


def test_turnless_and_empty(spark):
    turnless = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    check(spark, [(turnless, 0, "u", "gone")])
    assert T.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.trie(spark.createDataFrame([(None, 1, "u", "x", *"abcd")], SCHEMA)).collect() == []


def test_list_rank(spark, monkeypatch):
    """A list in random order, so that parts contract almost nothing and mates do the work."""
    monkeypatch.setattr(T, "FINISH", 8)
    monkeypatch.setattr(T, "PART_ARCS", 20)
    order = list(range(300))
    random.Random(4).shuffle(order)
    rows = [(x, order[i + 1] if i + 1 < len(order) else None) for i, x in enumerate(order)]
    arcs = spark.createDataFrame(rows, "id long, next long")
    got = {r.id: r.place for r in T.list_rank(arcs, ["id"], len(rows)).collect()}
    assert got == {x: i for i, x in enumerate(order)}


def test_running_states_join_parts(spark):
    """Segments within a part, over two parts and over many, of a state whose order matters."""
    rows = [(s, i, random.Random(i).randint(1, 5)) for s, n in enumerate([1, 500, 2, 1, 900, 3]) for i in range(n)]
    table = spark.createDataFrame(rows, "s long, i long, x long")
    step = lambda state, row: (state[0] + 1, (state[1] * 3 + row[2]) % 1009)
    after = lambda a, b: (a[0] + b[0], (a[1] * pow(3, b[0], 1009) + b[1]) % 1009)
    got = {(r.s, r.i): (r.n, r.f) for r in running(table, ["s", "i"], ["s"], "n long, f long", (0, 0), step, after, "states", ["s", "i"]).collect()}
    want, state = {}, (0, 0)
    for s, i, x in rows:
        state = step((0, 0) if i == 0 else state, (s, i, x))
        want[s, i] = state
    assert got == want
