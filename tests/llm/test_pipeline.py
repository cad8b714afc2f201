"""The stages of the corpus pipeline, each on what the one before it kept."""

import random

import corpus_pipeline
from kinlink.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and 0 < kept[-1] < kept[0]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.where("quality = 1").count()
    assert docs.join(labels.where("quality = 1"), "doc_id").count() > 0.75 * good
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def prose(seed, n):
    """Text that the rules accept: words of a fixed list, sentence by sentence."""
    rng = random.Random(seed)
    words = "the and of to in that it is was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(n))


def test_chain_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names go through all stages."""
    good = [prose(i, 30) for i in range(12)]
    near = good[0].replace("water", "stone", 1) if "water" in good[0] else good[0] + " Indeed."
    texts = [*good, near, good[1], None, "", "   ", "one", prose(99, 6000), good[2], good[2]]
    ids = [*range(12), 12, 13, 14, 15, 16, 17, 18, 2, None]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kinlink_key string, bucket long, score double, nid long"
    docs = spark.createDataFrame([(i, t, None if i in (3, None) else "en", None, None, "k", 1, None, 7) for i, t in zip(ids, texts)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), schema)
        assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [t for _, t in left]
    assert len(kept) == len(set(kept)) and set(kept) <= {*good, near, texts[18]} and texts[18] in kept
    assert set(good[3:]) <= set(kept) and sum(t in kept for t in (good[0], near)) == 1
    assert dict((t, d) for d, t in left)[good[1]] == 1 and dict((t, d) for d, t in left)[good[2]] == 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in pieces} == {d for d, _ in left}


def test_registered():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
