import random
import zlib

from marketloom.llm import quality


def corpus():
    rnd = random.Random(1)
    good = ["the", "river", "of", "stones", "and", "evening", "light", "walked", "softly", "toward", "houses", "people", "began", "to", "speak"]
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        words = [rnd.choice(good) + rnd.choice(["", "s", "ing", "ed"]) for _ in range(rnd.randint(20, 400))]
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + ".", int(not bad)))
    return rows


def test_held_out_accuracy_and_whole_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id bigint, text string, score double").repartition(4)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and len(out) == 900
    assert sum((out[i] >= 0.3) == q for i, q in held) / len(held) > 0.97
    assert quality.fit(docs, labels) == model
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in out if out[i] >= 0.3}
    # the end of a long text counts as much as its beginning
    good, bad = rows[1][1] * 50, rows[0][1] * 50
    both = model.scores([(good + bad).encode(), (bad + good).encode(), good.encode(), bad.encode()])
    assert both[3] < both[0] < both[2] and both[3] < both[1] < both[2]


def test_held_out_labels_are_not_read(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q
    a, b = (spark.createDataFrame([(i, f(i, q)) for i, _, q in rows], "doc_id bigint, quality int") for f in (lambda i, q: q, flip))
    assert quality.fit(docs, a) == quality.fit(docs, b)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "é" * 100_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1)], "doc_id bigint, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert [r.score for r in out] == [0.5] * 4
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
    assert quality.accepted(docs, quality.fit(docs, labels)).count() == 4
