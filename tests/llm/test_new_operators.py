"""op11, op12, op13: fill-in-middle, scaled sketches and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from honorlens.llm import fim, importance, sketch, text_units
from tests.llm.fixtures import awkward, frame, lower, prose

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKS = ("<P>", "<S>", "<M>")


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def cut(doc_id, text, plan):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in MARKS) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    if h4 % 100 < plan.spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm_rate", [(50, 80), (100, 50), (0, 80)])
def test_fill_in_middle_and_back(spark, rate, spm_rate):
    rows = awkward() + [(400 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M", "<", "<<S", "> <P", " lead", "tail ", " \n", "é ü 日本  x", "one"])]
    plan = fim.Plan(rate=rate, spm_rate=spm_rate)
    docs = frame(spark, rows, extra=True).withColumnsRenamed({"source": "form", "lang": "found"})
    out = fim.fill_in_middle(docs, plan)
    assert set(docs.columns) <= set(out.columns)
    out = out.withColumn("back", fim.restore(F.col("output"), F.col("form"), plan))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()]
    want = [(i, *cut(i, t, plan), t or "") for i, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert rate == 0 or {"spm", "psm", "plain"} == {r[2] for r in got}
    assert fim.fill_in_middle(docs.limit(0), plan).collect() == []


def test_rotation_in_place_is_exact_at_any_chunk(monkeypatch):
    rnd = random.Random(5)
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(fim, "CHUNK", chunk)
        for _ in range(60):
            raw = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 40)))
            lo, c, hi = sorted(rnd.randint(0, len(raw)) for _ in range(3))
            buffer = bytearray(raw)
            fim.exchange(buffer, lo, c, hi)
            assert bytes(buffer) == raw[:lo] + raw[c:hi] + raw[lo:c] + raw[hi:]
            fim.exchange(buffer, lo, lo + hi - c, hi)  # the other amount turns it back
            assert bytes(buffer) == raw


def test_sentinels_that_can_be_confused_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("<<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.Plan(*marks)


def plain_sketch(text, scale=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    hashes = [hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(words) - 4))] if words else []
    below = sorted({h for h in hashes if int(h, 16) * scale < 1 << 64})
    return below or ([min(hashes)] if hashes else [])


def plain_likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def plain_edits(rows):
    """By row: n_chars, edited text, the two sketches, two likenesses; only for rows without equal ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (doc_id, text) in enumerate(order):
        text, behind = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + behind[: len(text) // 2]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(behind)
        yield doc_id, len(text), edited, "".join(a), "".join(b), plain_likeness(a, b), plain_likeness(a, c)


@pytest.mark.parametrize("rows", [awkward(3, 60)[:60] + awkward()[40:43] + awkward()[44:51], [(3, "only one text")], [(None, None)], [(7, "a b"), (-(2**63), "c d e f g h i")]])
def test_fingerprints_of_edited_texts(spark, rows):
    columns = ("doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    out = sketch.edited_fingerprints(frame(spark, rows, extra=True).withColumnRenamed("source", "range"))
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    assert sorted(got, key=key) == sorted(plain_edits(rows), key=key)


def test_fingerprints_with_equal_ids_and_no_rows(spark):
    rows = [(5, f"text {i} " + prose(random.Random(i), 30)) for i in range(40)] + [(5, "same words in this row")] * 30 + [(None, "none of them")] * 5 + [(1, None)]
    out = sketch.edited_fingerprints(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in out), key=key) == sorted(((i, len(t or "")) for i, t in rows), key=key)
    alike = [r for r in out if r.doc_id == 5 and r.n_chars == len("same words in this row") and r.near_next == 1.0]
    assert len(alike) == 29  # equal rows follow each other
    assert sketch.edited_fingerprints(frame(spark, rows).limit(0)).collect() == []
    kept = sketch.fingerprints(frame(spark, rows).withColumnRenamed("source", "fingerprint"))
    assert {r.fingerprint for r in kept.filter("text = 'same words in this row'").collect()} == {"".join(plain_sketch("same words in this row"))}


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_each_document_meets_the_next_one_in_any_number_of_ranges(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ids = random.Random(1).sample(range(-1000, 1000), 200)
        docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
        got = {r.doc_id: r.next_text for r in sketch.with_next(docs, {}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_sketches_merge_and_tell_containment(spark):
    rnd = random.Random(8)
    long = prose(rnd, 4000)
    parts = [" ".join(long.split(" ")[i : i + 300]) for i in range(0, 3000, 300)]
    rows = spark.createDataFrame([(p, long, prose(rnd, 300)) for p in parts] + [("a b", "a b", "c d"), ("", "a b", "")], "a string, b string, c string")
    s = {x: sketch.sketch(F.col(x)) for x in "abc"}
    rows = rows.withColumns({f"s{x}": s[x] for x in "abc"}).select("*", sketch.containment(F.col("sa"), F.col("sb")).alias("part"), sketch.containment(F.col("sa"), F.col("sc")).alias("other"), sketch.merged(F.col("sa"), F.col("sc")).alias("union"), sketch.hashes_of(sketch.fingerprint(F.col("sb"))).alias("read"))
    for r in rows.collect():
        union = sorted({*plain_sketch(r.a), *plain_sketch(r.c)})
        below = [h for h in union if h < "4"]
        assert r.union == (below or union[:1]) and r.read == r.sb == plain_sketch(r.b)
        if len(r.a) > 10:
            assert r.part == 1.0 and r.other < 0.1
    assert plain_sketch("x y z") == plain_sketch("X  y\tz") != []


def test_long_texts_are_sketched_in_proportion(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = spark.createDataFrame([(" ".join(words),)], "text string").withColumn("s", sketch.sketch(F.col("text")))
    assert rows.first().s == plain_sketch(" ".join(words))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_grams(text, longest):
    words = WORD.findall(lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resampled(rows, target, plan):
    corpus, wanted = [0] * plan.buckets, [0] * plan.buckets
    bucket = lambda g: zlib.crc32(g.encode()) % plan.buckets
    for _, t in rows:
        for g in plain_grams(t, plan.longest)[1]:
            corpus[bucket(g)] += 1
    for t in target:
        for g in plain_grams(t, plan.longest)[1]:
            wanted[bucket(g)] += 1
    s, t, n = sum(corpus), sum(wanted), plan.buckets
    gain = [math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus, wanted, strict=True)]
    out = []
    for i, x in rows:
        words, grams = plain_grams(x, plan.longest)
        weight = sum(gain[bucket(g)] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((words, i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[0] >= plan.least_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = plan.percent * len(fit) // 100
    rank = {id(r): k + 1 for k, r in enumerate(fit[:drawn])}
    return [(*r[1:], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("longest,percent,least", [(1, 10, 20), (2, 35, 5), (3, 100, 0), (1, 0, 20)])
def test_resampling_is_the_plain_one(spark, longest, percent, least):
    rows = [r for r in awkward() if r[0] is not None or r[1]] + [(500 + i, "Übung macht 9 den-Meister x1 " * (i % 4)) for i in range(30)]
    rows = [*dict.fromkeys(rows)]  # equal rows may swap their ranks
    target = [rows[2][1], rows[7][1], None, "", "Übung x1"]
    plan = importance.Resampling(longest=longest, percent=percent, least_words=least, buckets=500)
    frame_of_target = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in importance.resampled(frame(spark, rows, extra=True), frame_of_target, plan).collect()]
    assert sorted(got, key=key) == sorted(plain_resampled(rows, target, plan), key=key)


def test_resampling_of_ties_repeats_and_nothing(spark):
    rows = [(1, "a b c")] * 40 + [(None, "a b c")] * 40 + [(2, None)]
    none = spark.createDataFrame([], "text string")
    plan = importance.Resampling(percent=50, least_words=1)
    got = importance.resampled(frame(spark, rows), none, plan).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41)) and len(got) == 81
    assert importance.resampled(frame(spark, rows).limit(0), none, plan).collect() == []


def test_xxhash64_is_the_librarys():
    rnd = random.Random(1)
    spans = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(70), 500]]
    data = np.frombuffer(b"".join(spans) + b"\0" * 8, dtype=np.uint8)
    size = np.array([len(x) for x in spans])
    assert importance.xxhash64(data, np.cumsum(size) - size, size).tolist() == [xxhash.xxh64_intdigest(x) for x in spans]


def test_interning_verifies_bytes_and_grows(monkeypatch):
    monkeypatch.setattr(importance, "FIRST_SLOTS", 4)
    monkeypatch.setattr(importance, "xxhash64", lambda data, starts, sizes: (sizes % 3).astype(np.uint64))  # next to no key tells two apart
    rnd = random.Random(2)
    texts = [prose(rnd, 40), "abcdefgh abcdefgi abcdefghi a b ab " + "x" * 40 + " " + "x" * 41, "", "é"]
    data, offsets = text_units.utf8(pa.array(texts))
    buffer, starts, sizes, at, _ = importance.features(data, offsets, 2)
    grams = importance.Interned(buffer, starts, sizes, 97)
    raw = buffer.tobytes()
    spans = [raw[a : a + n] for a, n in zip(starts, sizes, strict=True)]
    assert spans[: at[1]] + spans[at[1] :] == [g.encode() for t in texts for g in plain_grams(t, 2)[1]]
    assert len(grams.count) == len(set(spans)) and grams.count.tolist() == [spans.count(raw[a : a + n]) for a, n in zip(grams.start, grams.size, strict=True)]
    assert [raw[grams.start[s] : grams.start[s] + grams.size[s]] for s in grams.slot] == spans
    assert grams.bucket[grams.slot].tolist() == [zlib.crc32(g) % 97 for g in spans]
