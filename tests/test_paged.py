"""Pages that link to each other, whole and broken."""

import json
import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from honorlens.plans import ingest
from honorlens.session import ensure_checkpoint_dir
from honorlens.sources.json_array import PACKED, Ranges
from honorlens.sources.paged import Paged, page_order, read_pages, records_of

RECORD = T.StructType([T.StructField("id", T.StringType())])


def write(folder, chain, records, broken=None):
    """Pages named a link after the other; ``broken`` maps a page to its whole text, None leaves it out."""
    folder.mkdir()
    for page, after in zip(chain, [*chain[1:], None], strict=True):
        text = json.dumps({"rows": [{"id": x} for x in records[page]], "links": {"next": after}}, indent=1)
        text = (broken or {}).get(page, text)
        if text is not None:
            (folder / page).write_text(text)
    return str(folder)


@pytest.fixture(scope="module")
def book():
    rnd = random.Random(4)
    chain = [f"p{i:02}.json" for i in rnd.sample(range(40), 21)]
    return chain, {p: [f"{p}-{i}" for i in range(rnd.randint(0, 4))] for p in chain}


def test_the_first_whole_source_is_read_in_order(spark, tmp_path, book):
    chain, records = book
    torn = {chain[9]: '{"rows": [{"id": "x"}], "li'}
    circle = {chain[12]: json.dumps({"rows": [], "links": {"next": chain[3]}})}
    short = {chain[5]: json.dumps({"rows": [{"id": "only"}] * 9, "links": {"next": chain[6]}})}
    sources = [Paged("nowhere", str(tmp_path / "nowhere"), chain[0])]
    for name, broken in (("gone", {chain[7]: None}), ("torn", torn), ("circle", circle), ("short", short), ("headless", {chain[0]: None}), ("whole", None), ("later", None)):
        sources.append(Paged(name, write(tmp_path / name, chain, records, broken), chain[0]))
    (tmp_path / "whole" / "stray.json").write_text('{"rows": [{"id": "stray"}], "links": {"next": "%s"}}' % chain[2])
    manifest = spark.createDataFrame([(p, len(r)) for p, r in records.items()], "page string, n_records long")
    read = read_pages(spark, sources, "rows", RECORD, manifest)
    assert [(r.source, r.page) for r in read.orderBy("position").collect()] == [("whole", p) for p in chain]
    assert [r.position for r in read.orderBy("position").collect()] == list(range(len(chain)))
    assert sorted(r.id for r in records_of(read, "page").collect()) == sorted(x for p in chain for x in records[p])
    with pytest.raises(FileNotFoundError) as error:
        read_pages(spark, sources[:6], "rows", RECORD, manifest)
    for said in (f"gone: page {chain[7]} is missing", f"torn: page {chain[9]} can't be parsed", "circle: the links run in a circle", f"short: page {chain[5]} isn't as the manifest has it", f"headless: no first page {chain[0]}"):
        assert said in str(error.value)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_positions_of_any_number_of_pages(spark, n):
    chain = [f"{i * 7 % 101}" for i in range(n)]
    links = spark.createDataFrame(list(zip(chain, [*chain[1:], None], strict=True)), "page string, next string")
    order, ends = page_order(links, chain[0])
    assert ends and {r.page: r.position for r in order.collect()} == {p: i for i, p in enumerate(chain)}
    circle = spark.createDataFrame(list(zip(chain, [*chain[1:], chain[n // 2]], strict=True)), "page string, next string")
    assert not page_order(circle, chain[0])[1]


def test_a_large_page_is_read_by_many_tasks(spark, tmp_path):
    chain = ["b.json", "a.json"]
    records = {"b.json": [f'{i} "],[{{é\\' for i in range(300)], "a.json": []}
    path = write(tmp_path / "large", chain, records)
    read = read_pages(spark, [Paged("large", path, chain[0])], "rows", RECORD, range_bytes=1000).persist()
    rows = read.selectExpr("page", "position", "size(records) AS n", "spark_partition_id() AS task").collect()
    large = [r for r in rows if r.page == "b.json"]
    assert sum(r.n for r in large) == 300 and max(r.n for r in large) < 60 and len({r.task for r in large}) > 3
    assert [(r.position, r.n) for r in rows if r.page == "a.json"] == [(1, 0)]
    assert sorted(r.id for r in records_of(read, "page").collect()) == sorted(records["b.json"])


def test_records_that_json_does_not_allow_are_found_by_range(spark, tmp_path):
    wrong = ['[{"id": "a"},, {"id": "b"}]', '[{"id": "a"} {"id": "b"}]', '[{"id": "a"}, ]', '[{"id": "a"}, 1}, "x": [2]', '[{"id": "a"}, {"id": "b"], "x": {}}]']
    sources = []
    for i, rows in enumerate(wrong):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "p").write_text(f'{{"links": {{}}, "rows": {rows}}}')
        sources.append(Paged(str(i), str(tmp_path / str(i)), "p"))
    with pytest.raises(FileNotFoundError) as error:
        read_pages(spark, sources, "rows", RECORD, range_bytes=14)
    assert str(error.value) == "no source holds: " + "; ".join(f"{i}: page p can't be parsed" for i in range(len(wrong)))


def test_packed_pages_are_read_by_range(spark, tmp_path):
    rnd = random.Random(6)
    ids = [f'{i} "],[{{é\\' * 9 for i in range(4000)] + ["".join(rnd.choices('abcdefgh"\\', k=600_000))] + ["last"]
    lines = ['{"links": {}, "rows": [null', *(f",{json.dumps({'id': x})}" for x in ids), "]}"]
    text = "\n".join(lines) + "\n"
    rows = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    rows.write.option("compression", "snappy").text(str(tmp_path / "whole"))
    [page] = (tmp_path / "whole").glob(f"part-*{PACKED}")
    source, data = Ranges(f"file://{page}"), text.encode()
    assert source.size == len(data) > 2 * page.stat().st_size
    for lo, hi in [(0, len(data)), (-5, 1), (len(data) - 1, len(data) + 9), (7, 7), *(sorted(rnd.choices(range(len(data)), k=2)) for _ in range(30))]:
        assert source.bytes(lo, hi) == data[max(0, lo) : hi]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / page.name).write_bytes(page.read_bytes()[:-100])
    sources = [Paged(x, [str(tmp_path / x)], page.name) for x in ("cut", "whole")]
    read = read_pages(spark, sources, "rows", RECORD, range_bytes=100_000).persist()
    assert {r.source for r in read.select("source").collect()} == {"whole"} and read.count() > 8
    assert sorted(str(r.id) for r in records_of(read, "page").collect()) == sorted([*ids, "None"])


def test_three_sources_take_less_disk_than_one_plain_copy(spark):
    folder, sf_dir = Path(urlparse(ensure_checkpoint_dir(spark)).path), "/root/testdata/sf0.01"
    held = lambda: sum(x.stat().st_size for x in folder.rglob("*") if x.is_file())
    before = held()
    assert ingest.q_paged(spark, sf_dir).agg(F.sum("n_records")).first()[0] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    text = ingest._records(spark, sf_dir).agg(F.sum(F.octet_length("value"))).first()[0]
    assert held() - before < text
