"""op3, op10 and the pipeline: held-out accuracy, planted copies, every stage against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from honorlens.llm import common, decontam, langid
from tests.conftest import SMALL
from tests.llm.fixtures import SCHEMA, awkward, classes, frame, lower, prose, shingle_set


def test_held_out_accuracy(spark):
    docs = common.documents(spark, SMALL)
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(out[r.doc_id].lang_pred, r.lang) for r in docs.collect() if out[r.doc_id].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_awkward_texts_and_labels(spark):
    rows = awkward()
    docs = frame(spark, rows, extra=True).withColumnRenamed("row", "score")
    model = langid.learn(docs)
    assert model.languages == ["en"]
    out = langid.predict(docs, model)
    assert out.count() == len(rows) and set(docs.columns) <= set(out.columns)
    for r in out.collect():
        has_letter = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if has_letter else "und") and (has_letter or r.score == 0)
    none = langid.learn(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).collect() == []


def test_predictions_use_the_text_only(spark):
    docs = common.documents(spark, SMALL)
    model = langid.learn(docs.filter(langid.in_training()))
    swapped = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'other' AS source")
    a = sorted((r.text, r.lang_pred, r.score) for r in langid.predict(docs, model).collect())
    assert a == sorted((r.text, r.lang_pred, r.score) for r in langid.predict(swapped, model).collect())


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_alignment(a, b):
    best, above = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        now = [0.0]
        for j, y in enumerate(b):
            now.append(max(0.0, above[j] + (1.0 if x == y else -0.5), above[j + 1] - 0.5, now[j] - 0.5))
        best, above = max(best, *now), now
    return best


def test_alignment_is_smith_waterman():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 4, (30, 12)).astype(np.uint64), rnd.integers(0, 4, (30, 25)).astype(np.uint64)
    m, n = rnd.integers(1, 13, 30), rnd.integers(1, 26, 30)
    score, _, _ = decontam.align(a, m, b, n)
    assert score.tolist() == [plain_alignment(a[i, : m[i]].tolist(), b[i, : n[i]].tolist()) for i in range(30)]


def leaky(rnd, items):
    """(doc_id, text, ids of the items it holds copies of)."""
    rows = [(i, prose(rnd, rnd.randint(5, 150)), set()) for i in range(30)]
    for i, (item, text) in enumerate(items):
        w = text.split(" ")
        replaced = [x if k % 5 else "other" for k, x in enumerate(w)]
        gone = [x for k, x in enumerate(w) if k % 6]
        grown = [y for k, x in enumerate(w) for y in ([x, "extra"] if k % 6 == 0 else [x])]
        for j, copy in enumerate((w, replaced, gone, grown, [x.upper() + "," for x in w])):
            rows.append((100 + 10 * i + j, f"{prose(rnd, 40)} {' '.join(copy)} {prose(rnd, 40)}", {item}))
    return rows


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "kilo mega tera peta deci centi".split() for b in "watt metre gram lux tone byte volt ohm".split()]
    return [(i, prose(rnd, n, vocabulary)) for i, n in enumerate((14, 25, 40, 60))]


def test_exact_and_edited_copies_are_found_and_clean_documents_left(spark, items):
    rows = leaky(random.Random(9), items)
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "!!"), (None, "kilowatt metre")], "item_id long, text string")
    docs = frame(spark, [r[:2] for r in rows] + [(500, None), (501, ""), (None, items[2][1]), (502, prose(random.Random(1), 4000))], extra=True)
    found = {}
    for r in decontam.leaks(docs, benchmark).collect():
        found.setdefault(r.doc_id, set()).add(r.item_id)
        assert 0.5 <= r.score <= 1
    assert found == {i: ids for i, _, ids in rows if ids} | {None: {2}}
    out = decontam.with_copies(docs, benchmark)
    assert out.count() == docs.count() and set(out.columns) == set(docs.columns)
    assert decontam.leaks(docs, benchmark.limit(0)).collect() == [] and decontam.leaks(docs.limit(0), benchmark).collect() == []


def test_an_item_that_every_document_copies_is_found(spark, items):
    rnd = random.Random(2)
    rows = [(i, f"{prose(rnd, 20)} {items[2][1]} {prose(rnd, 20)}") for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, rows), benchmark).collect()} == {(i, 2) for i in range(60)}


def test_passages_are_where_they_are_said_to_be(spark, items):
    text = f"one two three {items[1][1]} four five"
    r = decontam.leaks(frame(spark, [(1, text)]), spark.createDataFrame(items, "item_id long, text string")).first()
    assert (r.first_word, r.n_words, r.score) == (3, 25, 1.0)


def test_blocks_of_items_give_the_same(spark, items, monkeypatch):
    rows = frame(spark, [r[:2] for r in leaky(random.Random(9), items)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.leaks(rows, benchmark).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, decontam.leaks(rows, benchmark).collect())) == whole


def test_pipeline_stages_against_brute_force(spark):
    rnd = random.Random(4)
    docs = common.documents(spark, SMALL)
    rows = [tuple(r) for r in docs.collect()]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()
    word = rows[0][1].split(" ")
    planted = [(900, rows[0][1].upper(), "en", "s", 1), (901, " ".join(word[:-1] + ["changed"]), "en", "s", 1), (902, f"{prose(rnd, 30)} {item.text} {prose(rnd, 30)}", None, None, None)]
    planted += [(903, "#### 1234 $$$", "en", "s", 1), (904, None, None, None, None), (None, prose(rnd, 50), "en", "s", 1), (905, "Ωμέγα άλφα βήτα γάμμα δέλτα", "en", "s", 1)]
    now = spark.createDataFrame(rows + planted, SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.staged(stage(spark, now, SMALL), name)
        assert now.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        kept[name] = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
    first = kept["language_id"]
    assert {903, 904, 905}.isdisjoint(i for i, _ in first) and len(first) == len(rows) + len(planted) - 3
    best = {}
    for i, t in first:
        best[lower(t)] = max(best.get(lower(t), -1), -1 if i is None else i)
    assert kept["exact_dedup"] == sorted(((None if i < 0 else i, t) for i, t in {(best[lower(t)], t) for i, t in first if (-1 if i is None else i) == best[lower(t)]}), key=str)
    second = sorted(kept["exact_dedup"], key=lambda x: (x[0] is None, x[0]))
    member = classes([shingle_set(t) for _, t in second], lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    assert kept["near_dedup"] == sorted((x for k, x in enumerate(second) if member[k] == k), key=str)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert kept["decontaminate"] == sorted((x for x in kept["near_dedup"] if not any(t in x[1] for t in items)), key=str)
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL).collect()
    assert {r.doc_id for r in last} == {i for i, _ in kept["decontaminate"]}
    assert max(r.offset + r.length for r in last) <= 2048
