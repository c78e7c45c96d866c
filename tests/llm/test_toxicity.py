import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import toxicity as toxicity_module
from tidewater.llm.toxicity import Field, fit, marginals, sample, scored, toxicity, trained, words_of

SF = "/root/testdata/sf0.01"


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 6, 1, 5])
    e, moves = rng.normal(size=counts.sum()) * 2, np.array([0.3, -1.2, 0.9])
    p, steps = marginals(e, counts, moves, pairs=True)
    at, want_steps = 0, np.zeros(3)
    for n in counts:
        total, ones, moved = 0.0, np.zeros(n), np.zeros(3)
        for path in itertools.product([0, 1], repeat=int(n)):
            pair = np.array([sum(a == x and b == y for a, b in zip(path, path[1:])) for x, y in ((0, 1), (1, 0), (1, 1))])
            w = np.exp((np.array(path) * e[at : at + n]).sum() + (pair * moves).sum())
            total, ones, moved = total + w, ones + w * np.array(path), moved + w * pair
        assert np.allclose(p[at : at + n], ones / total)
        want_steps += moved / total
        at += n
    assert np.allclose(steps, want_steps)


def test_words_and_places():
    w = words_of(["Ab, cdé9fghij", "", "AB"])
    assert w.text.tolist() == [0, 0, 0, 2] and w.at.tolist() == [0, 4, 8, 0] and w.length.tolist() == [2, 3, 5, 2]
    assert (w.features[0] == w.features[3]).all() and w.counts.tolist() == [3, 0, 1]


def made(n, seed):
    rng = np.random.default_rng(seed)
    texts, toxic = [], []
    for i in range(n):
        words = [f"{''.join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 7)))}" for _ in range(rng.integers(5, 60))]
        y = int(rng.random() < 0.2)
        for _ in range(y * rng.integers(1, 4)):
            words[rng.integers(len(words))] = rng.choice(["badword", "vilest", "vileness", "vilely", "vilemost"])
        texts.append(" ".join(words))
        toxic.append(y)
    return texts, toxic


def test_held_out_texts_are_told_and_spans_are_the_words():
    model = fit(*made(400, 1))
    texts, toxic = made(300, 2)
    score, spans = scored([*texts, "", "an unseen vileoid"], model)
    assert ((score[:300] >= 0.7) == np.array(toxic)).mean() > 0.99
    for t, y, s in zip(texts, toxic, spans):
        found = " ".join(t[x["begin"] : x["end"]] for x in s).split()
        want = [w for w in t.split() if w == "badword" or w.startswith("vile")]
        assert not y or found == want
    assert score[300] < 0.1 and score[301] > 0.5 and spans[301] == [{"begin": 10, "end": 17}]


@pytest.mark.parametrize("texts, toxic", [([], []), (["a"], [1]), (["a", "b"], [0, 1])])
def test_too_few_texts_give_a_constant(texts, toxic):
    model = fit(texts, toxic)
    score, spans = scored(["", "some text"], model)
    assert isinstance(model, Field) and score[0] == score[1] and spans == [[], []]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_nothing_is_learned_from_held_out_rows(spark, tables):
    docs, labels = tables
    rows = sample(docs, labels, "text", "doc_id", "toxic", (3000, 3000), 1 << 30).collect()
    texts, toxic = [r.text for r in rows], [r.label for r in rows]
    held = {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    want = [(r.text, r.toxic) for r in docs.join(labels, "doc_id").collect() if r.doc_id not in held]
    assert sorted(zip(texts, toxic)) == sorted(want)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity(docs, trained(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    rows = toxicity(docs, trained(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    print(len(rows), hit, sum(caught), len(caught), sum(clean), len(clean))
    assert hit > 0.95 and sum(caught) / len(caught) > 0.7 and sum(clean) / len(clean) < 0.02


def test_long_stems_and_counts_tell():
    """A stem of seven letters that clean texts have once and toxic ones often; its first six are no sign."""
    rng = np.random.default_rng(5)
    ending = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 4)))

    def texts(n):
        out, toxic = [], []
        for i in range(n):
            words = [f"{rng.choice(['la', 'bomenta', 'bomento', 'casa', 'rio'])}{ending()}" for _ in range(40)]
            y = int(i % 8 == 0)
            for _ in range(6 if y else int(rng.random() < 0.15)):
                words[rng.integers(len(words))] = "bomente" + ending()
            out.append(" ".join(words))
            toxic.append(y)
        return out, np.array(toxic)

    model = fit(*texts(400))
    held, toxic = texts(400)
    told = scored(held, model)[0] >= 0.7
    assert told[toxic == 1].mean() > 0.8 and told[toxic == 0].mean() < 0.02


def test_held_out_recall_by_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = trained(docs, labels)
    rows = toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in {r.lang for r in rows}:
        caught = [r.predicted for r in rows if r.toxic and r.lang == lang]
        assert len(caught) > 10 and sum(caught) / len(caught) >= 0.6, (lang, sum(caught), len(caught))
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(clean) / len(clean) < 0.02


def test_choices_come_from_folds_of_the_texts_to_learn_from(spark):
    """The choice of the least mean loss over the folds; the same whatever the order of rows."""
    texts, toxic = made(150, 7)
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, toxic))], "id long, text string, label int")
    got = toxicity_module.tried(rows.repartition(4))
    order = sorted(range(150), key=lambda i: (toxic[i], {r.id: r.n for r in numbered(rows)}[i]))
    texts, toxic = [texts[i] for i in order], [toxic[i] for i in order]
    grid = [(p, s) for p in toxicity_module.PENALTIES for s in toxicity_module.SLACKS]
    loss = {c: sum(toxicity_module.loss(texts, toxic, f, *c) for f in range(toxicity_module.FOLDS)) for c in grid}
    assert got == min(grid, key=lambda c: (round(loss[c], 9), -c[0], -c[1]))
    few = rows.where("label = 0").unionByName(rows.where("label = 1").limit(2))
    assert toxicity_module.tried(few) == (toxicity_module.PENALTIES[1], toxicity_module.SLACKS[0])


def numbered(rows):
    from pyspark.sql import Window

    return rows.select("id", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), "id")).alias("n")).collect()


def test_windows_cover_all_words(monkeypatch):
    monkeypatch.setattr(toxicity_module, "WINDOW", 4)
    n, text = toxicity_module.windows_of(np.array([0, 4, 9, 1]))
    assert n.tolist() == [0, 4, 4, 4, 1, 1] and text.tolist() == [0, 1, 2, 2, 2, 3]
    texts, toxic = made(200, 3)
    score, _ = scored(texts, fit(texts, toxic))
    assert ((score >= 0.7) == np.array(toxic)).mean() > 0.97


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumns({"score": F.lit(1), "spans": F.lit("x")})
    model = fit(*made(400, 1))
    rows = toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.spans == [] and r.predicted == 0 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert toxicity(docs.limit(0), model).collect() == []
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(docs, trained(docs, empty)).count() == docs.count()
