"""The prefix trie against one that is built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from siftwell.llm import prefix_trie
from siftwell.llm.common import importable

SCHEMA = "conv_id long, turn long, role string, text string, key long, words long, head string, h int"


def ordered(rows):
    """conv_id → its turns in order, as (role, text)."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    return {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in turns.items()}


def upon_heads(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        out[c] = head[:h] + own[h:]
    return out


def brute(sequences):
    members, ends = {}, {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves[key] = sum(leaves[k] for k in below) if below else 1
        saved[key] = sum(saved[k] for k in below) + (len(members[key]) - 1) * words
    sha = lambda key: hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()
    rows = [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], sha(k)) for k, m in members.items()]
    return sorted(rows, key=str)


def found(spark, rows, rebuild=True):
    importable(spark)
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    convs = prefix_trie.conversations(frame)
    result = prefix_trie.trie(prefix_trie.keyed(prefix_trie.rebuilt(convs) if rebuild else convs))
    assert result.columns == prefix_trie.RESULT
    return sorted((tuple(r) for r in result.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_many_ranges(spark, parts):
    """Short turns from few, so that prefixes and copies cross the ends of ranges; a third of all are copies of one."""
    draw = random.Random(parts)
    rows = []
    for c in range(500):
        text = ["a a", "b", "a a", "c c c"] if c % 3 == 0 else [draw.choice(["a a", "b", "c c c"]) for _ in range(draw.randint(1, 6))]
        rows += [(c, i, draw.choice(["u", "v"]) if c % 3 else "u", t) for i, t in enumerate(text)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(spark, rows, rebuild=False) == brute(ordered(rows))
        assert found(spark, rows) == brute(upon_heads(ordered(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, 2, "user", "b"), (1, None, "user", "a"), (1, 2, "user", "b"), (1, 2, None, None), (None, 1, "user", "lost"), (2, 1, None, ""), (3, 0, "u", long), (4, 0, "u", long), (4, 1, "u", "x")]
    rows += [(40, 0, "user", "a"), (41, 0, "user", "b"), (60, 0, "s", "t"), (60, 1, "s", "t"), (-3, 0, "s", "t"), (0, 0, "é", "ñ \n\t"), (23, 5, "u", "only")]
    rows += [(77, i, "u", f"turn {i}") for i in range(300)] + [(78, i, "u", f"turn {i}") for i in range(250)]
    rows += [(c, 0, "u", "alone") for c in range(101, 111)]
    assert found(spark, rows) == brute(upon_heads(ordered(rows)))
    assert any(not s for s in upon_heads(ordered(rows)).values())  # some have no turn left
    assert found(spark, rows, rebuild=False) == brute(ordered(rows))


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "t")]) == []


def test_one_conversation(spark):
    assert found(spark, [(5, 0, "u", "x y")], rebuild=False) == brute({5: [("u", "x y")]})
