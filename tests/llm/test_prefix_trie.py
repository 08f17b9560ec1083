"""The trie against one built turn by turn in plain Python."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablemill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(items):
    own = defaultdict(list)
    for conv, turn, role, text in items:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows)] for c, rows in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + (-c) % 5
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == n).encode()).hexdigest())
                   for n, m in members.items()), key=str)


def conversations(seed, longest):
    rng = random.Random(seed)
    out = [(None, 1, "user", "nobody"), (3, None, None, None), (3, None, "user", ""), (3, 2, "a", "b"), (3, 2, "a", "b"),
           (-7, 0, "user", "minus"), (-5, 0, "user", "five"), (2**40, 5, "é", "日本 " * 400)]
    for c in rng.sample(range(10, 400), 150):
        common = rng.choice([0, 0, 1])
        for t in range(rng.choice([1, 2, 5, 8, 12, longest])):
            text = f"turn {t}" if common or rng.random() < 0.7 else f"own {c} {t}"
            out.append((c, t, rng.choice(["user", "user", "assistant"]) if t % 3 == 2 else "user", text))
    out += [(c, t, "user", f"copy {t}") for c in range(1000, 1060) for t in range(20)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("band,stretch,longest", [(8, 1024, 40), (2, 3, 70), (3, 7, 30), (64, 1024, 40)])
def test_trie(spark, monkeypatch, band, stretch, longest):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    items = conversations(band, longest)
    got = prefix_trie.trie(spark.createDataFrame(items, SCHEMA), band).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(items)


def test_a_long_conversation_spreads(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    items = [(10, i // 3, "user", f"t{i % 7}") for i in range(900)] + [(11, 0, "user", "x")]
    rows = spark.createDataFrame(items, SCHEMA).withColumn("depth", F.lit(1)).withColumn("a.b", F.lit(1))
    turns = prefix_trie.numbered_turns(rows)
    assert sorted(r.place for r in turns.where("conv_id = 10").collect()) == list(range(1, 901))
    assert sorted((tuple(r) for r in prefix_trie.trie(rows).collect()), key=str) == plain(items)


def test_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_digests_run_over_batches():
    import pyarrow as pa
    rows = [(1, 0, c) for c in range(10)] + [(1, 1, 5)] + [(2, 1, c) for c in range(3)]
    for size in (1, 3, 100):
        batches = [pa.RecordBatch.from_pydict(dict(zip(("node", "depth", "conv_id"), map(list, zip(*rows[i:i + size])))))
                   for i in range(0, len(rows), size)]
        got = {(r["conv_id"], r["depth"]): r["ends_sha256"]
               for b in prefix_trie._digests(iter(batches)) for r in b.to_pylist()}
        assert got == {k: hashlib.sha256(",".join(str(r[2]) for r in rows if r[:2] == k).encode()).hexdigest()
                       for k in {r[:2] for r in rows}}
