"""op2, op7, op8: sharding, URL rules and line dedup against plain versions."""

import random
import re
import zlib

import pytest

from honorlens.llm import linededup, sharding, urlfilter
from tests.llm.fixtures import awkward, frame, lower


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)

    def holds(cap):
        used, at = 1, 0
        for s in sizes:
            if at + s > cap:
                used, at = used + 1, 0
            at += s
        return used <= shards

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed,shards,first", [(1, 4, 12), (2, 7, 2), (3, 24, 1), (4, 3, 4)])
def test_cuts_are_minimax(spark, monkeypatch, seed, shards, first):
    monkeypatch.setattr(sharding, "FIRST_BITS", first)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    rnd = random.Random(seed)
    groups = sorted((rnd.randrange(1 << 60), rnd.choice([8, 9, 50, 700, 5000 if seed == 4 else 90])) for _ in range(300))
    capacity, keys = sharding.minimax_cuts(spark.createDataFrame(groups, "key long, bytes long"), shards)
    assert capacity == least_capacity([b for _, b in groups], shards)
    total = [0] * shards
    for k, b in groups:
        total[sum(k >= c for c in keys)] += b
    assert max(total) == capacity


def test_shards_keep_equal_texts_together_and_slots_gapless(spark):
    rows = awkward() * 2
    out = sharding.shard_documents(frame(spark, rows, extra=True), 5).collect()
    assert len(out) == len(rows)
    where, slots = {}, {}
    for r in out:
        where.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(x) == 1 for x in where.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=key) == sorted(want, key=key)
    assert sharding.shard_documents(frame(spark, rows).limit(0), 5).collect() == []


RULES = [urlfilter.Rule("net", "/", "block"), urlfilter.Rule("example.net", "/en/", "allow"), urlfilter.Rule("example.com", "/de/", "block"), urlfilter.Rule("org", "/fr/", "allow")]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "no url", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en", "http://xnet/", "http://net/", "http://a.net", "http://a.net?x/", "s://b.org/fr/", "s://org/fr/?://", "x://example.com/de/#", "x://notexample.com/de/", "x://example.com/DE/", "//a.net/", "http://a.net:80/", "http://.net/", "a://b://c.net/"]
    urls += ["http://" + "a." * 3000 + "net/" + "p" * 5000] + urls[4:6]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = {r.page_id: r for r in urlfilter.judge_urls(pages, RULES).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == judged(u, RULES), u
    assert urlfilter.judge_urls(pages.limit(0), RULES).collect() == []
    assert {r.verdict for r in urlfilter.judge_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    listed = [f"h{i}.example/" for i in range(0, 3000, 7)]
    universe = spark.createDataFrame([(f"h{i}.example/",) for i in range(3000)], "key string")
    cascade = urlfilter.Cascade(spark.createDataFrame([(x,) for x in listed], "key string"), universe)
    assert len(cascade.levels) > 2
    found = {r.key for r in universe.filter(cascade.has(universe.key)).collect()}
    assert found == set(listed)


def without_frequent(rows, least):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    docs = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            docs[k] = docs.get(k, 0) + 1
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if docs.get(key(x), 0) < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_frequent_lines_go(spark):
    rnd = random.Random(2)
    pool = ["Shared LINE", "  shared line\t", "ÉTÉ", "été", "", " ", "\u00a0x", "\x0bv\x0c", "rare"] + [f"l{i}" for i in range(30)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(60)] + [(200, None), (201, ""), (None, "Shared LINE\nx"), (7, "shared line"), (7, "shared line"), (202, "\n".join(["rare"] * 5000))]
    docs = frame(spark, rows).withColumnsRenamed({"source": "n_lines", "lang": "a"})
    out = linededup.drop_frequent_lines(docs, 5)
    assert set(docs.columns) <= set(out.columns)
    key = lambda r: tuple((x is None, x or 0) for x in r[:3]) + r[3:]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=key) == sorted(without_frequent(rows, 5), key=key)
    assert linededup.drop_frequent_lines(docs.limit(0), 5).collect() == []


def test_runs_are_compacted_and_known_lines_stay_out(spark):
    index = linededup.LineRuns(spark, least_docs=2)
    for batch in ([(1, 1), (1, 1), (2, 2)], [(1, 1), (3, 3)], [(3, 3), (4, 4)]):
        index.add(spark.createDataFrame(batch, "a long, b long"))
    assert [len(level) for level in index.levels] == [1, 1]
    assert sorted(map(tuple, index.frequent().collect())) == [(1, 1), (3, 3)]
    assert {r.n for r in index._merged(index.runs()).filter("a = 1").collect()} == {2}  # the second batch's wasn't added
    plan = index.runs()[0].join(index.runs()[1], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    index.drop()


def test_only_ascii_letters_are_lowered(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from honorlens.llm.common import LOWER, UPPER, lower_ascii

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(pd.DataFrame({"c": [f"A{chr(c)}Zé" for c in points]}))
    assert rows.filter(lower_ascii(F.col("c")) != F.translate("c", UPPER, LOWER)).isEmpty()
