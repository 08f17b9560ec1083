"""Packing in order against the library's ids and against every way to cut."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import byte_ids, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["Ünïcödé ẞtraße İstanbul ΑΣ. ΑΣ", "tab\tfeed\x0bform\x0c\x1cfs ls nb", "<|endoftext|> <|startoftext|>x", "a<|endoftext|>b c",
       "é ́a ﬁ ½ ² Ⅷ", "it's we'll I'M don'T 'sx 's", "日本語 한국 😀👍🏽 a_b __ 12345", "a" * 3000 + " " + "é" * 500,
       "\n\n . , .. a.", "a  b   c    d\n\n\ne \n f\n g  ", " lead", "trail ", "end \n", "x \n\n y\t z \t", " ", "  ", "   ", "\n", "",
       "“Quoted,” he said. ‘So?’ Yes—no… «oui» ¿qué?", "one.\nTwo! Three? \"Four.\" Five", "\0nul\0 and \0"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(byte_ids.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [windows.END]


def test_ids_are_the_library_s(library):
    rng = random.Random(9)
    encode = byte_ids.Encoder(byte_ids.default_path())
    bits = [" ", " ", " ", "\n", "\t", "a", "Hello", "it's", "12", "é", "ß", "…", "“", "²", "\r", " ", "don't", "--", ".", "...", "!)", "日", "<|endoftext|>", "<|"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def every_way(places, costs, room, each):
    """Least cost for each end, by trying every window."""
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= room:
                cost = best[i] + (0 if n & (n - 1) == 0 else room - n) + costs[j] + each
                best[j] = cost if best[j] is None else min(best[j], cost)
    return best


@pytest.mark.parametrize("room", [1, 3, 8, 16, 20])
def test_cuts_cost_least(room):
    rng = random.Random(room)
    for _ in range(60):
        places, costs = [0], [0]
        for _ in range(rng.randint(1, 40)):
            places.append(places[-1] + rng.randint(1, room))
            costs.append(rng.choice([0, 2, 5, 12]))
        cost, before = windows.best_cuts(places, costs, room, 1)
        assert cost == every_way(places, costs, room, 1)
        for j in range(1, len(places)):
            n = places[j] - places[before[j]]
            assert 0 < n <= room
            assert cost[j] == cost[before[j]] + (0 if n & (n - 1) == 0 else room - n) + costs[j] + 1


def check(library, items, rows, length):
    want = defaultdict(list)
    for doc, text, *_ in items:
        want[doc].append(ids_of(library, text))
    sequences, places = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        places[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= length
    assert set(places) == set(want)
    for doc, lists in want.items():
        for ids in lists[:1]:
            pieces = sorted(set(places[doc])) if len(lists) == 1 else None
            if pieces is None:               # repeated rows may be cut at different places
                assert sum(n for _, n, _, _ in places[doc]) == len(lists) * len(ids)
                continue
            at = 0
            for start, n, crc, total in pieces:
                assert (start, total) == (at, len(ids))
                assert crc == zlib.crc32(np.asarray(ids[at:at + n], "<u4").tobytes())
                at += n
            assert at == len(ids)
    sizes = [sum(n for _, n in parts) for parts in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else length - n for n in sizes) / sum(sizes)


def texts():
    rng = random.Random(12)
    words = "the of and Haus naïve été running tokens boundaries x1 don't".split()
    out = [(None, "no id here. Really.", None, None, 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0)]
    out += [(i + 10, text, "en", "s", 0) for i, text in enumerate(ODD)]
    for i in range(100, 400):
        sentences = [" ".join(rng.choices(words, k=rng.randint(1, 18))) + rng.choice([".", "!", "?", ""])
                     for _ in range(rng.randint(1, 60))]
        out.append((i, rng.choice([" ", "\n"]).join(sentences), "en", "s", 0))
    return out + [(900, "word " * 9000, "en", "s", 0), (901, "same. Again.", "en", "s", 0), (901, "same. Again.", "en", "s", 0)]


@pytest.mark.parametrize("length,together", [(2048, 1 << 18), (2048, 5000), (64, 100), (50, 1 << 18), (1, 4)])
def test_pieces(spark, library, monkeypatch, length, together):
    items = texts()
    monkeypatch.setattr(windows, "TOGETHER", together)
    price = windows.Price(apart=min(32, length))
    s = windows._Stream(byte_ids.encoder(byte_ids.default_path()), length, price)
    for doc, text, *_ in items:
        s.add(doc, s.encode(text or "") + np.asarray([windows.END], "<u4").tobytes())
    s.cut(last=True)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    rows = [type("Row", (), dict(zip(columns, r))) for r in s.rows]
    padding = check(library, items, rows, length)
    if length == 2048:
        assert padding < 0.02


def test_operator(spark, library):
    items = texts()
    docs = spark.createDataFrame(items, SCHEMA).withColumn("offset", F.lit("old")).repartition(3)
    rows = windows.pack_in_order(docs).collect()
    assert check(library, items, rows, 2048) < 0.05
    assert windows.pack_in_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cuts_fall_on_ends_where_these_are_near():
    price = windows.Price()
    encode = byte_ids.encoder(byte_ids.default_path())
    text = "This is a short sentence of ten words or so. " * 400
    s = windows._Stream(encode, 2048, price)
    for i in range(5):
        s.add(i, encode(text) + np.asarray([windows.END], "<u4").tobytes())
    s.cut(last=True)
    ids = np.frombuffer(encode(text), "<u4")
    allowed = {0, len(ids) + 1, *encode.sentence_ends(ids).tolist()}
    assert all(start in allowed for _, start, *_ in s.rows)
