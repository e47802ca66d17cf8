"""op6 and op9: near and exact duplicates against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from honorlens.llm import cuckoo, partenum, text_units
from tests.llm.fixtures import awkward, classes, frame, lower, prose, shingle_set


def edited(rnd, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[rnd.randrange(len(words))] = rnd.choice(["zeta", "eta", "theta"]) + str(rnd.randint(0, 99))
    return " ".join(words)


def near_rows():
    rnd = random.Random(11)
    rows = [(2 * i, t) for i, (_, t) in enumerate(awkward(4, 20))]
    passage = prose(rnd, 60)
    for n in (5, 6, 7, 9, 14, 30, 80, 300, 900):
        base = prose(rnd, n)
        for i in range(6):
            rows.append((1000 + 10 * n + i, edited(rnd, base, rnd.randint(0, 1 + n // 25))))
    for i in range(60):  # a chain: neighbours are similar, its ends aren't
        rows.append((5000 - i, " ".join(f"w{j}" for j in range(10 * i, 10 * i + 120))))
    rows += [(7000 + i, passage + " " + prose(rnd, 60)) for i in range(40)]  # a shared passage doesn't make copies
    return rows


def similar(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def test_components_are_brute_forces(spark):
    rows = near_rows()
    sets = [shingle_set(t) for _, t in rows]
    member = classes(sets, similar)
    ids = {}
    for (i, _), c in zip(rows, member, strict=True):
        ids.setdefault(c, []).append(i)
    want = sorted((i, len(s), min(ids[c])) for (i, _), s, c in zip(rows, sets, member, strict=True))
    got = sorted(map(tuple, partenum.near_duplicates(frame(spark, rows, extra=True)).collect()))
    assert got == want
    assert len({x[2] for x in want}) < len(want) - 60


def test_rounds_compare_what_the_first_pivot_misses(spark, monkeypatch):
    monkeypatch.setattr(partenum, "PIVOTS", (1, 2))
    chain = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 30))) for i in range(12)]
    sets = [shingle_set(t) for _, t in chain]
    want = classes(sets, similar)
    got = {r.doc_id: r.component_id for r in partenum.near_duplicates(frame(spark, chain)).collect()}
    assert got == dict(enumerate(want))


def meet(sets, levels):
    """Whether the first two sets are a pair by one of their signatures."""
    found, row, code = sets.signatures(partenum.SIMILARITY, np.array([0, 1]), levels)
    one, other = ({f: c for f, r, c in zip(found.tolist(), row.tolist(), code.tolist(), strict=True) if r == i} for i in (0, 1))
    both = int(sets.size.sum())
    within = lambda size, c: 7 * (size - (max(c, 2) - 2) // 2) >= 3 * both
    return any((one[f] % 2 or other[f] % 2 or not one[f]) and within(sets.size[0], one[f]) and within(sets.size[1], other[f]) for f in one.keys() & other.keys())


def test_frequent_shingles_are_counted_in_every_document(spark):
    rnd = random.Random(8)
    common, rarer = prose(rnd, 30), prose(rnd, 20)
    rows = [(i, f"{prose(rnd, 20)} {common} {rarer if i < 47 else ''} {prose(rnd, 5)}") for i in range(700)]
    docs = frame(spark, rows).filter(F.pmod(F.xxhash64("text"), F.lit(16)) != 0)  # none that one in sixteen by this hash would count
    texts = [r.text for r in docs.collect()]
    data, offsets = text_units.utf8(pa.array(texts))
    items, n = np.unique(partenum.Sets(data, offsets).items, return_counts=True)
    want = {int(i) % partenum.LEVEL_PLACES: 1 + int(np.log10(c / 48) + 1e-9) for i, c in zip(items, n, strict=True) if c >= 48}
    levels = partenum.frequency_levels(docs.repartition(5), partenum.WORDS)
    assert len(want) == 26 and set(want.values()) == {2} and {int(p): int(levels[p]) for p in np.flatnonzero(levels)} == want


def test_every_link_at_the_bound_has_a_shared_signature():
    rnd = random.Random(3)
    for n in (7, 8, 12, 20, 33, 60, 64, 65, 120, 400, 1500):
        for _ in range(4):
            words = [f"{rnd.random()}" for _ in range(n + 4)]
            drop = (n - -(-3 * n // 4)) if n >= 4 else 0
            a, b = " ".join(words), " ".join(words[: n + 4 - drop])  # the smaller set is all but drop shingles of the larger
            data, offsets = text_units.utf8(pa.array([a, b]))
            sets = partenum.Sets(data, offsets)
            x, y = sets.of(0), sets.of(1)
            common = len(set(x.tolist()) & set(y.tolist()))
            assert 4 * common >= 3 * (len(x) + len(y) - common)
            levels = np.zeros(1 << 12, dtype=np.uint8)
            for share in (0.0, 0.2, 0.45, 0.6, 0.95):  # of the places hold frequent shingles, of several levels
                place = rnd.sample(range(1 << 12), int(share * (1 << 12)))
                levels[place] = [rnd.choice([1, 1, 2, 3]) for _ in place]
                assert meet(sets, levels), (n, share)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b c d e f g h i j k l m n o p q r s u"), (3, None), (4, ""), (None, "x y z"), (5, "x y z"), (None, "solo"), (5, "X  Y Z"), (6, "?")]
    out = partenum.keep_one(frame(spark, rows, extra=True))
    assert out.columns == frame(spark, rows, extra=True).columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) in (
        sorted([(1, rows[0][1]), (3, None), (4, ""), (5, "x y z"), (None, "solo"), (6, "?")], key=str),
        sorted([(1, rows[0][1]), (3, None), (4, ""), (5, "X  Y Z"), (None, "solo"), (6, "?")], key=str),
    )
    assert partenum.keep_one(frame(spark, rows).limit(0)).collect() == []
    assert partenum.near_duplicates(frame(spark, rows).limit(0)).collect() == []
    assert [tuple(r) for r in partenum.near_duplicates(frame(spark, [(9, None)])).collect()] == [(9, 0, 9)]


def test_cuckoo_filter_holds_deletes_and_grows():
    rnd = random.Random(1)
    digests = [hashlib.sha256(str(rnd.random()).encode()).digest() for _ in range(5000)]
    bucket = cuckoo.Bucket()
    for i, d in enumerate(digests):
        bucket.add(d, i, 1)
        bucket.add(d, i - 1, 1)
    assert bucket.filter.log2 > 4 and all(d in bucket.filter for d in digests)
    assert all(v[1] == 2 for v in bucket.content.values()) and len(bucket.content) == 5000
    for d in digests[:2500]:
        bucket.remove(d, 1)
        bucket.remove(d, 1)
    assert len(bucket.content) == 2500 and all(d in bucket.filter for d in digests[2500:])
    assert sum(d in bucket.filter for d in digests[:2500]) < 100  # false positives only
    again = cuckoo.Bucket(bucket.state(0).iloc[0])
    assert again.content == bucket.content and again.filter.table == bucket.filter.table


def test_index_lives_across_batches(spark):
    rows = spark.createDataFrame([(i, hashlib.sha256(bytes([i % 7])).digest()) for i in range(50)], "doc_id long, digest binary")
    state = cuckoo.updated(None, cuckoo.changes(rows, 3))
    gone = rows.filter("doc_id % 7 = 2 OR doc_id = 49")
    state = cuckoo.updated(state, cuckoo.changes(gone, 3, sign=-1))
    sizes = {bytes(r.digest): r.group_size for r in cuckoo.live(state).collect()}
    assert hashlib.sha256(bytes([2])).digest() not in sizes and len(sizes) == 6
    assert sizes[hashlib.sha256(bytes([0])).digest()] == 7


def test_exact_dedup_is_brute_forces(spark):
    rows = awkward() + [(None, None), (300, "ÉTÉ"), (301, "été")]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, hashlib.sha256(lower(t).encode()).hexdigest(), keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)]) for i, t in rows]
    got = [(r.doc_id, bytes(r.digest).hex(), r.keep_id, r.group_size, r.kept) for r in cuckoo.exact_dedup(frame(spark, rows, extra=True)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    stay = cuckoo.keep_last(frame(spark, rows, extra=True))
    assert sorted(((r.doc_id, lower(r.text)) for r in stay.collect()), key=str) == sorted(((keep[t], t) for t in groups), key=str)
    assert stay.columns == frame(spark, rows, extra=True).columns
    assert cuckoo.exact_dedup(frame(spark, rows).limit(0)).collect() == []


def test_unlinked_texts_around_one_passage_are_not_all_compared(spark, monkeypatch):
    compared = []
    pairs_of = partenum.pairs_of

    def counted(*args):
        out = pairs_of(*args)
        compared.append(out.count())
        return out

    monkeypatch.setattr(partenum, "pairs_of", counted)
    for shared, members in ((90, (500, 1000, 2000)), (112, (1000,))):  # of 135 words: similarity 0.49 and 0.72
        found = {}
        for n in members:
            rnd = random.Random(n)
            passage = " ".join(f"p{i}" for i in range(shared))
            rows = [(i, passage + " " + " ".join(f"{rnd.random()}" for _ in range(135 - shared))) for i in range(n)]
            rows += [(n + i, f"{t} end") for i, t in rows[:20]]  # linked pairs among them
            compared.clear()
            got = {r.doc_id: r.component_id for r in partenum.near_duplicates(frame(spark, rows)).collect()}
            assert got == {i: i - n if i >= n else i for i, _ in rows}
            found[n] = sum(compared)
        assert all(20 <= c <= n for n, c in found.items()), found


def test_places_are_counted_in_a_byte_each():
    rnd = random.Random(5)
    texts = [f"{prose(rnd, 3)} a passage that every text of them has and more {prose(rnd, 20)} {i}" for i in range(700)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 100])}) for k in range(0, 700, 100)]
    tracemalloc.start()
    rows = [x for b in partenum.place_counts(iter(batches), partenum.WORDS) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 16 MB of bytes, and a block of texts; a number of 32 bits a place takes 64 MB
    found = {}
    for x in rows:
        held = np.frombuffer(pa.decompress(x["held"], 4 * partenum.PIECE, "zstd", asbytes=True), dtype=np.uint32)
        found.update({x["piece"] * partenum.PIECE + int(i): int(held[i]) for i in np.flatnonzero(held)})
    want = {}
    for b in batches:
        for _, _, sets in partenum._blocks(b.column("text"), partenum.WORDS):
            for place in (partenum._once(sets) % np.uint64(partenum.LEVEL_PLACES)).tolist():
                want[place] = want.get(place, 0) + 1
    assert found == want and max(found.values()) == 700
