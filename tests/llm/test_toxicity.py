import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, toxicity
from millrace.session import table

SYLLABLES = "an ber cor del est fin gar hol im jun kel lor men nor ost pel quin ras sol tur ul ven wes yor zan bri cla dru".split()
BAD = ["horridling", "stenchwort", "vilemonger"]


def corpus(count, seed, bad=BAD):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(count):
        words = [word() for _ in range(rng.randint(20, 300))]
        toxic = i % 5 == 0
        for _ in range(max(1, len(words) // 40) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    texts, labels = corpus(1500, 1)
    windows = [(i, " ".join(w)) for i, t in enumerate(texts) for w in np.split(np.array(t.split()), toxicity._cut(len(t.split()))[1:])]
    docs = np.array([i for i, _ in windows])
    return toxicity.fit([w for _, w in windows], docs, labels[docs], 0.2)


def wrong(model, texts, labels):
    found = np.array(toxicity._Scorer(model).scores(texts)) >= 0.5
    return float((found != labels).mean())


def test_held_out_accuracy(model):
    assert wrong(model, *corpus(500, 2)) < 0.03


def test_unseen_misspellings_are_found(model):
    assert wrong(model, *corpus(300, 3, ["horridlingg", "horidling", "stenchworts", "sstenchwort", "vilemongger", "vile-monger"])) < 0.15


def test_grams_of_words_alone_and_together():
    words = ["a", "", "über", "horridling", "x" * 50]
    buckets, starts = toxicity.grams(words)
    for i, w in enumerate(words):
        own = buckets[starts[i] : starts[i + 1] if i + 1 < len(words) else None]
        alone, _ = toxicity.grams([w])
        assert sorted(own.tolist()) == sorted(alone.tolist()) and len(own) == max(0, sum(max(0, len(w.encode()) + 3 - n) for n in toxicity.GRAMS)) or w == ""


def test_without_labels_nothing_is_toxic(odd_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scored(odd_docs.withColumn("score", F.lit("clash")), none).collect()
    assert len(rows) == odd_docs.count() and all(r.predicted == 0 and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd_docs, spark, model):
    rows = odd_docs.select(toxicity.scores(F.col("text"), model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows)
    assert odd_docs.limit(0).select(toxicity.scores(F.col("text"), model)).count() == 0


def test_query_contract(spark, sf):
    rows = queries.op4_toxicity(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_held_out_rows_teach_nothing(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.values == b.values).all() and (a.bias, a.scale) == (b.bias, b.scale)


def test_query_finds_held_out_toxic_documents(spark):
    """About 350 toxic labels to learn from; the documents counted here were held out."""
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter("toxic is not null")
    n = {(r.toxic, r.predicted): r["count"] for r in queries.op4_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.65 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.015


def test_the_sample_is_a_parameter(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    few = toxicity.train(docs, labels, train_docs={1: 3, 0: 5})
    assert (few.values != toxicity.train(docs, labels).values).any()
    assert toxicity.scored(docs, labels, train_docs={1: 3, 0: 5}).count() == docs.count()
