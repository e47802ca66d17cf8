"""op1 and op5: packing plans, pieces and binary records against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from honorlens.llm import common, packing, records
from tests.llm.fixtures import awkward, frame

BYTE, WORD = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, None, None), (64, 3, None), (64, None, 1500)])
def test_plan_keeps_every_capacity(score, limits):
    rnd = random.Random(3)
    capacity = packing.Capacity(*limits, score=score)
    counts = {n: rnd.choice([0, 1, 2, 17, 200]) for n in range(1, capacity.longest() + 1)}
    counts = {n: c for n, c in counts.items() if c}
    runs, bins = packing.plan_bins(counts, capacity)
    content = {}
    for length, lo, hi, per, first, offset in runs.tolist():
        for rank in range(lo, hi):
            content.setdefault(first + (rank - lo) // per, []).append((offset + (rank - lo) % per * length, length, rank))
    placed = [(n, r) for items in content.values() for _, n, r in items]
    assert sorted(placed) == sorted((n, r) for n, c in counts.items() for r in range(c))  # each piece once
    assert sorted(content) == list(range(bins))
    tokens, docs, cost = capacity.vector().tolist()
    for items in content.values():
        at = 0
        for offset, length, _ in sorted(items):
            assert offset == at  # no gap
            at += length
        assert at <= tokens and len(items) <= docs and sum(n * n for _, n, _ in items) <= cost
    if limits == (64, None, None):
        assert bins <= plain_best_fit(counts, 64) + (score == "dot") * 20


def plain_best_fit(counts, room):
    """Best fit by tokens, a piece at a time."""
    left, bins = [0] * (room + 1), 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = next((r for r in range(n, room + 1) if left[r]), None)
            if fit is None:
                bins, fit = bins + 1, room
                left[room] += 1
            left[fit] -= 1
            left[fit - n] += 1
    return bins


def test_a_piece_longer_than_a_sequence_is_an_error():
    with pytest.raises(ValueError):
        packing.plan_bins({65: 1}, packing.Capacity(64))
    assert packing.plan_bins({}, packing.Capacity(64))[1] == 0


def test_packed_documents_are_the_librarys_ids(spark):
    rows = awkward()
    out = packing.pack_documents(frame(spark, rows, extra=True), BYTE, packing.Capacity(100)).collect()
    tokenizer = Tokenizer.from_file(BYTE)
    want = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 100 + 1
        cuts = [0, *range(first, len(ids) + 1, 100)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))] and sum(n for _, n in items) <= 100


def test_ranks_do_not_depend_on_the_number_of_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 2)
    pieces = spark.createDataFrame([(i, 0, 7 + i % 3) for i in range(90)], "doc_id long, piece int, length long")
    out = packing.pack(pieces, packing.Capacity(16)).collect()
    assert len(out) == 90 and len({(r.sequence_id, r.offset) for r in out}) == 90


def test_pieces_with_ids_and_empty_input(spark):
    docs = frame(spark, awkward())
    for r in packing.token_pieces(docs, BYTE, 50, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert packing.pack_documents(docs.limit(0), BYTE).collect() == []


def test_records_come_back_as_encoded(spark):
    rows = awkward()
    tokenizer = Tokenizer.from_file(WORD)
    out = records.encode_to_records(frame(spark, rows, extra=True), WORD).collect()
    ids = {}
    for doc_id, text in rows:
        ids.setdefault(doc_id, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    assert len(out) == len(rows)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        x = next(x for x in ids[r.doc_id] if zlib.crc32(np.array(x, dtype="<u4").tobytes()) == r.ids_crc32)
        ids[r.doc_id].remove(x)
        assert len(x) == r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_shuffled_reads_and_checksums(spark, tmp_path):
    docs = frame(spark, awkward())
    index = records.write_records(docs, WORD, str(tmp_path / "r"))
    some = spark.read.parquet(index).orderBy("n_tokens", "position").repartition(3)
    back = records.read_indexed(some, with_ids=True).collect()
    assert len(back) == docs.count() and all(len(r.ids) == r.n_tokens for r in back)
    whole = bytearray(records.framed(b"abcdef"))
    assert bytes(records.unframed(memoryview(bytes(whole)))) == b"abcdef"
    for i in (0, 9, 14, len(whole) - 1):
        broken = bytearray(whole)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            records.unframed(memoryview(bytes(broken)))
    assert records.encode_to_records(docs.limit(0), WORD).collect() == []
