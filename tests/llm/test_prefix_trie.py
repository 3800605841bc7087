"""The prefix trie against a brute-force version: deep and hot conversations, ties, nulls and turnless ones."""

import collections
import hashlib
import random
import zlib

import pytest

from hourgrid.llm import prefix_trie


def brute_force(rows):
    """{(conv_id, depth): the other columns} of op11."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + (-c) % 100  # remainders have the sign of c
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
            if d:
                children[tuple(whole[c][:d - 1])].add(tuple(whole[c][:d]))
    leaves, saved = collections.Counter(), collections.Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += node not in children
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return {(m[0], len(node)): (members[node[:-1]][0] if node else None, len(m), len(children[node]) if node in children else 0, leaves[node], saved[node],
                                hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(node)).encode()).hexdigest())
            for node, m in members.items()}


def op11(rows, frame, tmp_path, spark):
    frame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): tuple(r[2:]) for r in got}


@pytest.mark.parametrize("band", [2, 8])
def test_brute_force(frame, tmp_path, spark, monkeypatch, band):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "ENDS_LOG", 3)
    rng = random.Random(41)
    rows = []
    for c in [*range(0, 330), *range(-150, -90), 10_000, 10_007, 2**40 + 1]:
        if c == 200:
            continue  # conversations of an absent base, some of them without turns
        kind = c % 10
        n = rng.choice([1, 2, 3, 7, 9]) if kind else 4
        rows += [(c, t, "user" if t % 2 == 0 else "bot", rng.choice(["a", "é漢", "long text", "b" * 50])) for t in range(n)]
    rows += [(5, None, None, None), (5, None, "user", None), (5, None, None, None), (6, 0, "user", "x"), (6, 0, "bot", "x"), (6, 0, "user", "a"),
             (None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    assert op11(rows, frame, tmp_path, spark) == brute_force(rows)


def test_deep_conversations(frame, tmp_path, spark):
    """Three levels of bands: conversations that part at depth 70, and one that ends inside the others."""
    rng = random.Random(42)
    common = [f"turn {i}" for i in range(140)]
    rows = []
    for c in range(1000, 1012):
        texts = common[:70] + [f"{c} {i}" if i > 90 else rng.choice("ab") for i in range(70)] if c != 1003 else common[:66]
        rows += [(c, i, "user", t) for i, t in enumerate(texts)]
    rows += [(c, i, "bot", common[i]) for c in range(2000, 2300) for i in range(2)]  # one large group of copies
    assert op11(rows, frame, tmp_path, spark) == brute_force(rows)


def test_cases(frame, tmp_path, spark):
    assert op11([], frame, tmp_path / "empty", spark) == {}
    one = [(7, 3, "user", "hi")]
    got = op11(one, frame, tmp_path / "one", spark)
    assert got == brute_force(one) and (7, 0) in got
    clashing = frame([(1, 1, None, "x", 5, 6)], "conv_id int, turn int, role string, text string, depth int, k1 string")
    turns = prefix_trie.digested(clashing)
    assert [tuple(r) for r in turns.select("conv_id", "at", "chars").collect()] == [(1, 1, 1)]
