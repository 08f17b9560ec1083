"""Operators that look at one document at a time, or at sums over all, against plain Python."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablemill.llm import line_dedup, mixing, packing, personal, quality, token_counts, toxicity
from tablemill.llm.vocabulary import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def make(spark):
    def rows(items, schema=SCHEMA):
        return spark.createDataFrame(items, schema)
    return rows


def awkward():
    rng = random.Random(3)
    words = ["the", "of", "it", "Haus", "naïve", "été", "x1", "a,b", "don't", "«q»", "12", "Ωmega", "!!", "日本"]
    out = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c\na b c\n\nz", "en", "s", 9),
           (3, " \n\t ", "en", None, 4), (4, "same line\nown", None, "s", 1), (4, "same line\nown", None, "s", 1),
           (5, "same line\nother " * 3, "en", "s", 2), (6, "x" * 5000, "en", "t", 5000)]
    for i in range(7, 60):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
                         for _ in range(rng.randint(1, 30)))
        out.append((i, text + "\nsame line" * (i % 2), "en", rng.choice(["s", "t", "u", None]), 1))
    return out


def by_row(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


# -- lines ----------------------------------------------------------------------------------------

def plain_lines(items, ratio, least):
    pages, held = Counter(), Counter()
    for _, text, _, host, _ in items:
        pages[host] += 1
        for line in {x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")} - {""}:
            held[host, line] += 1
    drop = {k for k, n in held.items() if n >= least and n >= ratio * pages[k[0]]}
    out = []
    for doc, text, _, host, _ in items:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (host, x.strip(" \t\r\x0b\x0c")) not in drop]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ratio,least", [(0.1, 5), (0.5, 2), (0.0, 1)])
def test_lines(make, ratio, least):
    items = awkward()
    got = line_dedup.drop_lines(make(items), ratio=ratio, min_pages=least).collect()
    assert by_row(got, "doc_id", "text", "n_lines", "n_dropped") == plain_lines(items, ratio, least)


def test_lines_of_no_pages_and_clashing_columns(make):
    assert line_dedup.drop_lines(make([])).count() == 0
    got = line_dedup.drop_lines(make(awkward()).withColumn("n_lines", F.lit("old")).withColumn("host", F.lit(1)))
    assert sorted(got.columns) == sorted([*SCHEMA.replace(" long", "").replace(" string", "").split(", "),
                                          "host", "n_lines", "n_dropped"])


def test_a_line_of_every_page_goes_and_nothing_else(make):
    got = line_dedup.drop_lines(make([(i, f"own {i}\n  shared \nmore {i}", "en", "s", 1) for i in range(40)]))
    assert {r.text for r in got.collect()} == {f"own {i}\nmore {i}" for i in range(40)}


# -- tokens and sequences -------------------------------------------------------------------------

def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_path())


ODD = ["Ünïcödé ẞtraße İstanbul ΑΣ. ΑΣ", "tab\tfeed\x0bform\x0c\x1cfs ls nb", "<|endoftext|> <|startoftext|>x",
       "é ́a ﬁ ½ ² Ⅷ", "it's we'll I'M don'T", "日本語 한국 😀👍🏽 a_b __ 12345", "a" * 3000 + " " + "é" * 500, "\n\n . , .. a."]


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces_are_the_library_ids(make, length):
    items = awkward() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    tok, want = library(), []
    for doc, text, *_ in items:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at:at + length]
            want.append((doc, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    got = packing.pack_documents(make(items), length).collect()
    assert by_row(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    check_sequences(got, length)


def check_sequences(rows, length):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(held)


def test_sequences_are_few(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, min(2048, int(rng.lognormvariate(6, 1)) + 1), i) for i in range(3000)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = check_sequences(packing.pack(parts.withColumn("offset", F.lit("old"))).collect(), 2048)
    assert n <= 1.01 * sum(r[3] for r in rows) / 2048 + 1
    assert check_sequences(packing.pack(parts, group=500).collect(), 2048) <= 1.05 * n


def test_sum_of_squares_chooses_the_least_sum():
    rng = random.Random(5)
    for _ in range(30):
        room, sizes = 12, [rng.randint(1, 12) for _ in range(40)]
        gaps: list[int] = []
        for size in sizes:                                      # every choice, tried out
            options = []
            for place in [*range(len(gaps)), None]:
                new = list(gaps)
                if place is None:
                    new.append(room - size)
                elif gaps[place] >= size and gaps[place] > 0:
                    new[place] -= size
                else:
                    continue
                count = Counter(g for g in new if g)
                options.append((sum(n * n for n in count.values()), place is None,
                                new[place] if place is not None else room - size, new))
            gaps = min(options, key=lambda o: o[:3])[3]
        made = packing.sum_of_squares(sizes, room)
        assert sorted(sum(sizes[i] for i in one) for one in made) == sorted(room - g for g in gaps)


def test_no_documents_make_no_sequences(make):
    assert packing.pack_documents(make([])).count() == 0


def greedy(vocabulary, units):
    n = at = 0
    while at < len(units):
        end = max((e for e in range(at + 1, len(units) + 1) if tuple(units[at:e]) in vocabulary), default=None)
        if end is None:
            return None
        n, at = n + 1, end
    return n


def test_longest_match_counts():
    rng = random.Random(2)
    for _ in range(60):
        vocabulary = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = token_counts.LongestMatch(sorted(vocabulary))
        for _ in range(60):
            word = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
            assert automaton.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_piece_counts(make):
    import json
    counter = token_counts.counter(default_path())
    with open(default_path()) as file:
        vocabulary = {counter.units(p) for p in json.load(file)["model"]["vocab"]}
    items = awkward() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    want = []
    for doc, text, *_ in items:
        n = 0
        for run in re.findall(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+", " ".join(w.lower() for w in (text or "").split())):
            letters = "".join(token_counts.byte_letters()[b] for b in run.encode())
            n += 1 if len(letters) > 900 else greedy_fast(vocabulary, (*letters, "</w>"))
        want.append((doc, len((text or "").split()), n))
    got = token_counts.count_pieces(make([i for i in items]).withColumn("n_pieces", F.lit("old"))).collect()
    short = {d for d, t, *_ in items if not t or len(t) < 900}
    assert ([r for r in by_row(got, "doc_id", "n_blank_words", "n_pieces") if r[0] in short]
            == [r for r in sorted(want, key=str) if r[0] in short])
    assert token_counts.count_pieces(make([])).count() == 0


def greedy_fast(vocabulary, units):
    n = at = 0
    while at < len(units):
        end = next((e for e in range(min(len(units), at + 40), at, -1) if tuple(units[at:e]) in vocabulary), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


# -- mixing ---------------------------------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        aim = {s: most * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        new = {s for s in names if aim[s] > most * sizes[s]}
        if not new:
            return aim
        full |= new


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(make, seed):
    rng = random.Random(seed)
    items = [(i, " ".join("w" for _ in range(rng.choice([3, 17, 40, 40, 40, rng.randint(0, 300)]))), "en",
              rng.choice(["a", "b", "c", "Z", "é", None, "a"]), 1) for i in range(900)]
    items += [(900, None, "en", "only-null", 0), (901, "one two", "en", "tiny", 0), (902, "w " * 30, "en", "a", 1)] * 2
    got = mixing.mix(make(items).withColumn("copies", F.lit("old"))).collect()
    sizes = Counter()
    for _, text, _, source, _ in items:
        sizes[source] += len(re.findall(WORD, text or ""))
    aim = plain_targets(dict(sizes))
    taken = Counter()
    assert len(got) == len(items)
    for r in got:
        assert r.size == len(re.findall(WORD, r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(aim[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for source, target in aim.items():
        assert abs(taken[source] - target) <= max(3, 0.01 * target), (source, taken[source], target)
    again = mixing.mix(make(items[::-1]).repartition(7)).collect()
    assert by_row(again, "doc_id", "text", "copies") == by_row(got, "doc_id", "text", "copies")


def test_rates_are_tilted_exponentials(make):
    rng = random.Random(9)
    items = [(i, "w " * rng.randint(1, 100), "en", "a" if i % 3 else "b", 1) for i in range(400)]
    sized = make(items).select("source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size"))
    cells = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = {r.source: r.s for r in sized.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    wanted = {"a": 0.6 * totals["a"], "b": 1.9 * totals["b"]}
    target = F.when(F.col("source") == "a", wanted["a"]).otherwise(wanted["b"])
    known = cells.withColumn("target", target).withColumn(
        "source_size", F.when(F.col("source") == "a", totals["a"]).otherwise(totals["b"]))
    import math
    for r in mixing.balance(known).collect():
        mass = sum(c.n * c.size * min(3.0, math.exp(r.tilt * (1 + c.size / r.largest)))
                   for c in cells.where(F.col("source") == r.source).collect())
        assert mass == pytest.approx(wanted[r.source], rel=1e-5)


def test_mix_of_little(make):
    assert mixing.mix(make([])).count() == 0
    assert [r.copies * r.size for r in mixing.mix(make([(1, None, None, None, None)])).collect()] == [0]
    assert mixing.repeated(make([(1, "", None, "s", 0), (2, "a b", None, "s", 0)])).count() == 2


# -- quality --------------------------------------------------------------------------------------

def plain_rules(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_rules(make):
    items = awkward() + [(200, "a b c " * 60, "en", "s", 1), (201, "a a a a a", "en", "s", 1),
                         (202, "#x# * $\x0bw\x0cz " + " ".join(map(str, range(80))), "en", "s", 1)]
    got = quality.rules(make(items).withColumn("base_failed", F.lit("old"))).collect()
    names = [*quality.RULES, "base_failed"]
    assert by_row(got, "doc_id", *names) == sorted(((i[0], *plain_rules(i[1])) for i in items), key=str)


def test_quality_ratio_tells_trusted_from_junk(make, spark):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(good if i % 4 else bad, k=120)), "en", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 300)] + [(None, 1, 0)] + [(1, 1, 0)] * 3,
                                   "doc_id long, quality int, toxic int")
    got = quality.judged(make(items).withColumn("kept", F.lit(1)), labels).collect()
    assert all(r.kept == bool(r.doc_id % 4) for r in got)


def test_quality_threshold_is_set_from_both_sides():
    assert quality.cut_between([(0.1 * i, 10, 0) for i in range(10, 20)] + [(0.1 * i, 0, 5) for i in range(5)]) == pytest.approx(0.7)
    assert quality.cut_between([(0.5, 0, 9)]) is None and quality.cut_between([(0.5, 100, 0), (0.9, 1, 0)]) == 0.5


def test_quality_weights_are_smoothed_ratios(make, spark):
    import math
    items = [(1, "a b a", "en", "s", 1), (2, "b c", "en", "s", 1), (3, None, "en", "s", 1)]
    got = quality.weights(make(items), spark.createDataFrame([(1,)], "doc_id long"))
    n = quality.BUCKETS
    code = make([(0, "a", "", "", 0)]).select(F.xxhash64(F.lit("a")).bitwiseAND(F.lit(n - 1)).alias("h")).first().h
    assert got[code] == pytest.approx(math.log((2 + 1) / (n + 5)) - math.log((2 + 1) / (n + 8)), abs=1e-4)


def test_quality_without_labels_or_documents(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(make([]), none).count() == 0
    got = quality.judged(make(awkward()), none).collect()
    assert all(r.kept == (not r.base_failed) for r in got)


# -- personal data --------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return sorted(found)


def test_base_spans(make):
    rng = random.Random(6)
    bits = list("0123456789") * 2 + list(" -.@+()_%,\n") * 2 + ["ab", "Z", "é", "😀", "4111 1111 1111 1111", "a@b.co",
                                                                "10.0.0.255", "+49 (30) 123-456", "256.1.1.1", "c_d@e.f-g.h"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "000.0255.00001.9", "x" * 50_000 + "@", "1 " * 20_000,
              "a.b" * 9000 + "@c" + ".d" * 9000, "+1" + " 2" * 9000, "4" * 20_000, "1." * 9000]
    rows = make([(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    got = {r.doc_id: [tuple(x) for x in r.b] for r in rows.select(
        "doc_id", personal.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t


def test_spans_keep_the_base_and_add_what_trees_choose(make):
    rng = random.Random(8)
    def number():
        return "+49 " + " ".join(str(rng.randint(100, 999)) for _ in range(3))
    items = []
    for i in range(900):
        kind = i % 3
        text = (f"call me: phone {number()} soon" if kind == 0 else
                f"version {rng.randint(1, 9)}.{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)} of it"
                if kind == 1 else "call me: phone 0049 " + " ".join(str(rng.randint(100, 999)) for _ in range(3)))
        items.append((i, text, "en", "s", 1))
    items += [(None, None, None, None, None), (1, "", "en", "s", 0)] + [(5, "a@b.co", "en", "s", 1)] * 2
    rows = personal.found(make(items).withColumn("spans", F.lit("old")))
    got = rows.collect()
    assert len(got) == len(items)
    for r in got:
        assert [tuple(x) for x in r.base] == plain_spans(r.text)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    out = {r.doc_id: r for r in personal.digests(rows).collect()}
    want = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in plain_spans(items[0][1]))
    assert out[0].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and out[0].n_phone == 1
    clean = {r.doc_id: r.text for r in personal.redacted(rows.where("doc_id = 0")).collect()}
    assert clean[0] == "call me: phone [PHONE] soon"


def test_other_forms_of_personal_data_come_back(make):
    rng = random.Random(9)
    def name():
        return "".join(rng.choices("abcdefgh", k=6)) + f".{rng.randint(10, 99)}"
    def digits(n):
        return "".join(rng.choices("123456789", k=n))
    items = []
    for i in range(600):
        text = (f"please write to {name()}@mail{i % 9}.example.com soon" if i % 2 else
                f"you may call +49 {digits(3)} {digits(3)} {digits(3)} soon")
        items.append((i, text + ". We met at noon. Then it rained", "en", "s", 1))
    wanted = {1000: ("email", "kate.51 at mail3 dot example dot com"), 1001: ("email", "hugo.17[at]mail2[dot]example[dot]com"),
              1002: ("phone", "0049 301 234 567"), 1003: ("phone", "0049.301.234.567")}
    items += [(k, f"you reach me under {m} soon", "en", "s", 1) for k, (_, m) in wanted.items()]
    unwanted = ["we met at noon. Then it rained", "version 312.458.299.301 is out", "of 2024-05-17 10-30 it says"]
    items += [(2000 + i, t, "en", "s", 1) for i, t in enumerate(unwanted)]
    got = {r.doc_id: r for r in personal.found(make(items)).collect()}
    for k, (kind, m) in wanted.items():
        s = got[k].text.index(m)
        assert [tuple(x) for x in got[k].base] == [] and [tuple(x) for x in got[k].spans] == [
            (s, personal.KINDS.index(kind), s + len(m))], (m, got[k].spans)
    assert all(got[2000 + i].spans == [] for i in range(len(unwanted))), [got[2000 + i].spans for i in range(3)]


def test_trees_read_in_a_column_agree_with_the_library(make, spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    rng = random.Random(11)
    rows = spark.createDataFrame([[rng.random() for _ in personal.FEATURES] for _ in range(300)], personal.FEATURES)
    rows = VectorAssembler(inputCols=personal.FEATURES, outputCol="features").transform(
        rows.withColumn("is_personal", (F.col("length") + F.col("plus") > 1).cast("double")))
    model = personal.GBTClassifier(labelCol="is_personal", maxIter=3, maxDepth=3).fit(rows)
    own = personal.Proposer(model, [0.0] * 4)
    got = model.transform(rows).select(vector_to_array("rawPrediction")[1].alias("a"),
                                       own.score(F.array(*personal.FEATURES)).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b) for r in got)


def test_personal_data_of_no_documents(make):
    assert personal.found(make([])).count() == 0


# -- toxicity -------------------------------------------------------------------------------------

def test_toxic_documents_are_rejected(make, spark):
    rng = random.Random(12)
    def text(i):
        words = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        return " ".join(words + ["Vile!", "rotten"] * 2 if i % 5 == 0 else words)
    items = [(i, text(i), "en", "s", 1) for i in range(600)] + [(None, None, None, None, None), (700, "", "en", "s", 0)]
    labels = spark.createDataFrame(
        [(i, int(i % 7 > 0), int(i % 5 == 0)) for i in range(400)] + [(401, 1, None), (None, 0, 1)],
        "doc_id long, quality int, toxic int")
    got = toxicity.judged(make(items).withColumn("rejected", F.lit("old")), labels).collect()
    assert len(got) == len(items)
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert sum(r.rejected == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert not any(r.rejected for r in got if not r.text)


def test_toxicity_without_labels_or_documents(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in toxicity.judged(make(awkward()), none).collect())
    assert toxicity.judged(make([]), none).count() == 0


def test_threshold_sits_in_the_gap():
    assert toxicity.threshold([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0]) == pytest.approx(0.5)
    assert toxicity.threshold([0.4, 0.1], [0, 0]) > 1


def test_personal_data_is_fitted_to_all_documents(spark):
    """More documents than a sample once took: each one's match teaches, copies of a row once."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat('write to user', id, '@example.org soon') AS text")
    rows = personal.labelled(docs.unionByName(docs.limit(100)))
    assert rows.where("kind = 0 AND is_personal = 1 AND NOT fresh").count() == 25_000
