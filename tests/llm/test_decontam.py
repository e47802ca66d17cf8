"""op10: no copy at the threshold is lost, however many documents hold it and however it is edited."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from honorlens.llm import decontam
from tests.llm.fixtures import frame, prose
from tests.llm.test_models import plain_alignment, words

ITEM = " ".join(f"item{k}" for k in range(25))
REPLACED = " ".join(f"item{k}" if k % 5 else "other" for k in range(25))
SCHEMA = "item_id long, text string"


@pytest.mark.parametrize("copies", [2, 5, 1000])
@pytest.mark.parametrize("intact", [False, True])
def test_an_edited_copy_is_found_in_any_number_of_documents(spark, copies, intact):
    rnd = random.Random(copies)
    rows = [(i, f"{prose(rnd, 20)} {REPLACED} {prose(rnd, 20)}") for i in range(copies)]
    rows += [(5000 + i, prose(rnd, 40)) for i in range(20)] + [(6000, ITEM)] * intact
    found = {(r.doc_id, r.score) for r in decontam.leaks(frame(spark, rows), spark.createDataFrame([(1, ITEM)], SCHEMA)).collect()}
    assert found == {(i, 0.72) for i in range(copies)} | ({(6000, 1.0)} if intact else set())


def test_copies_without_an_intact_run_are_found(spark):
    w = [f"item{k}" for k in range(30)]
    third = " ".join(x if k % 3 else "other" for k, x in enumerate(w))
    grown = " ".join(f"{x} extra" for x in w)
    split = " ".join(w[:15] + ["extra"] * 29 + w[15:])
    rows = [(1, f"{prose(random.Random(1), 20)} {' '.join(w[:1])} {third}"), (2, grown), (3, split)]
    got = {r.doc_id: r.score for r in decontam.leaks(frame(spark, rows), spark.createDataFrame([(1, " ".join(w))], SCHEMA)).collect()}
    assert got == {i: plain_alignment(w, words(t)) / 30 for i, t in rows} and min(got.values()) >= 0.5


def test_scores_equal_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=n))) for i, n in enumerate((3, 4, 5, 6, 7, 9, 12, 20, 33))]
    rows = []
    for i in range(300):
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, len(w))):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randint(0, 1)] = rnd.choices(vocabulary, k=rnd.randint(0, 1))
            w = w or ["w0"]
        rows.append((i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)) + w + rnd.choices(vocabulary, k=rnd.randint(0, 30)))))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(frame(spark, rows), spark.createDataFrame(items, SCHEMA)).collect()}
    best = {(d, i): plain_alignment(words(x), words(t)) / len(words(x)) for d, t in rows for i, x in items}
    assert got == pytest.approx({k: v for k, v in best.items() if v >= decontam.THRESHOLD})


def test_short_items_and_items_without_an_id_are_found_in_longer_texts(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, f"{prose(rnd, 20)} {x} {prose(rnd, 20)}") for i, x in enumerate(("nothing", "Kilowatt!", "mega, volt", "mega big volt", "volt mega", ITEM, "kilowatts"))]
    rows.append((7, "kilowatt"))
    benchmark = spark.createDataFrame([(1, "kilowatt"), (2, "mega volt"), (None, ITEM), (None, ITEM + " more"), (None, None)], SCHEMA)
    got = sorted(((r.doc_id, r.item_id, r.score) for r in decontam.leaks(frame(spark, rows), benchmark).collect()), key=str)
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 0.75), (5, None, 25 / 26), (5, None, 1.0), (7, 1, 1.0)]
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminate(spark, frame(spark, rows), str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {0, 4, 6}


def test_a_long_text_with_many_hits_is_searched_in_parts(monkeypatch):
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(80)]
    items = [" ".join(rnd.choices(vocabulary, k=n)) for n in (4, 6, 9, 12)]
    texts = []
    for _ in range(12):
        w = rnd.choices(vocabulary, k=900)
        for x in items:
            at, y = rnd.randrange(900), x.split()
            y[rnd.randrange(len(y))] = "other"
            w[at:at] = y
        texts.append(" ".join(w))
    benchmark = pa.array(items, pa.large_string())
    hashes, at = decontam._words(benchmark)
    seed, begin = decontam._seeds(hashes, at, at[:0])
    item = np.searchsorted(at, begin, "right") - 1
    order = np.lexsort((begin - at[item], item, seed))
    sure = np.maximum(1, np.ceil(decontam.THRESHOLD * np.diff(at)).astype(np.int64) - 1)
    block = decontam.Items(list(range(len(items))), hashes, at, seed[order], item[order], (begin - at[item])[order], sure)
    maybe, column = decontam._maybe(block.seed), pa.array(texts, pa.large_string())
    whole = decontam._copies(block, maybe, column)
    monkeypatch.setattr(decontam, "MOST_HITS", 4)
    parts = decontam._copies(block, maybe, column)
    assert [[x[:2] for x in row] for row in parts] == [[x[:2] for x in row] for row in whole]
    for text, row in zip(texts, parts, strict=True):
        w = text.split()
        assert {i: s for i, s, *_ in row} == pytest.approx({
            i: best for i, x in enumerate(items) if (best := plain_alignment(x.split(), w) / len(x.split())) >= decontam.THRESHOLD})
        for i, score, first, n in row:  # the passage itself has the score
            assert plain_alignment(items[i].split(), w[first : first + n]) / len(items[i].split()) == pytest.approx(score)


def test_of_equal_passages_the_first_is_reported(spark):
    text = f"{ITEM} {prose(random.Random(2), 200)} {ITEM}"
    got = decontam.leaks(frame(spark, [(1, text)]), spark.createDataFrame([(1, ITEM)], SCHEMA)).collect()
    assert [(r.score, r.first_word, r.n_words) for r in got] == [(1.0, 0, 25)]


def test_seeds_are_counted_in_every_document(spark):
    rnd = random.Random(6)
    rows = [(i, f"{prose(rnd, 9)} {ITEM if i % 3 else REPLACED} {ITEM if i % 2 else ''}") for i in range(60)] + [(100, None), (101, "")]
    items = next(decontam.item_blocks(spark.createDataFrame([(1, ITEM)], SCHEMA), "item_id", "text"))
    known = np.unique(items.seed)
    counts = decontam.frequencies(frame(spark, rows), known)
    hashes, at = decontam._words(pa.array([text for _, text in rows]))
    found, begin = decontam._seeds(hashes, at, at[:0])
    row = np.searchsorted(at, begin, "right") - 1
    assert counts.tolist() == [len(set(row[found == seed].tolist())) for seed in known] and max(counts) == 60
