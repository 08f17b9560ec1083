"""The stages one after another over a small corpus, each against what it promises."""
import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tablemill.llm import near_dup
from tablemill.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(20)
    words = [f"w{i}" for i in range(1500)]
    rows, toxic = [], set()
    for i in range(400):
        if i % 10 == 9:
            text = rows[-1][1] + " tail"                     # a near copy of the one before
        else:
            text = "\n".join(" ".join(rng.choices(words, k=25)) for _ in range(6))
        if i % 7 == 0 and i % 10 != 9:
            toxic.add(i)
            text += " vile rotten scum"
        rows.append((i, text + "\nAll rights reserved", "en", f"s{i % 3}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, rows[2][1], "en", "s0", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic or (i % 10 == 9 and i - 1 in toxic))) for i in range(0, 300)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, toxic


def test_stages(spark, corpus):
    path, rows, toxic = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), "stage")
        assert docs.columns == COLUMNS and docs.schema["n_chars"].dataType.simpleString() == "bigint"
        kept[name] = docs.collect()
    after_toxic = {r.doc_id for r in kept["toxicity"]}
    bad = {i for i in range(400) if i in toxic or (i % 10 == 9 and i - 1 in toxic)}
    assert len(bad & after_toxic) <= 0.03 * len(bad) and len(set(range(400)) - bad - after_toxic) <= 4
    lines = kept["line dedup"]
    assert {r.doc_id for r in lines} == after_toxic
    assert not any("All rights reserved" in (r.text or "").split("\n") for r in lines if r.source)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines)
    near = kept["near duplicates"]
    left = near_dup.group(spark.createDataFrame(near, SCHEMA)).where("n_shingles > 0 AND NOT kept")
    assert left.count() == 0 and {r.doc_id for r in near} < after_toxic
    mixed = Counter(r.doc_id for r in kept["source mixing"])
    assert set(mixed) <= {r.doc_id for r in near} and max(mixed.values()) <= 3
    packed = pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
