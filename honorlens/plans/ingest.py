"""Registered nested-ingest queries (S1-S4, P1-P10, F21s, U1)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import round_doubles
from ..sources import nested as N
from ..session import ensure_checkpoint_dir
from ..sources import paged
from ..sources.facts import holders, order_facts
from ..sources.json_array import read_array
from ..sources.sinks import write_reports
from ..sources.tables import read_first_available, read_table, table_path
from .registry import query


DOCUMENTS_A_TASK, DOCUMENTS_A_FILE = 50_000, 100_000


def _parts(rows, each):
    """How many parts of at most about ``each`` rows, eight at least."""
    return max(8, -(-rows.count() // each))


def _held_orders(spark, sf_dir):
    """The rows that documents are made of: an order with its recipient."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                                  "o_orderpriority", "o_totalprice"])
    who = holders(spark, sf_dir)
    return orders.join(who, orders.o_custkey == who.c_custkey).drop("c_custkey")


def _recipient():
    """The nested recipient of a row of ``_held_orders``: organisations carry ``orgName``/``founded``,
    persons ``givenName``/``familyName``/``birth`` and, for finished orders, ``death``; partial
    birth dates ('-00' day) exercise P5."""
    is_org = F.col("c_mktsegment") == "MACHINERY"
    byear = F.year("o_orderdate") - 20 - (F.col("o_orderkey") % 50)
    bstr = F.concat(byear.cast("string"), F.lit("-"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.lit("-00"))
    en = lambda c: F.struct(c.alias("en"))
    place = F.struct(en(F.col("birth_country")).alias("country"), en(F.col("birth_continent")).alias("continent"))
    dated = F.struct(bstr.alias("date"), place.alias("place"))
    status = F.col("o_orderstatus")
    affiliation = lambda name, country: F.struct(en(name).alias("name"), en(country).alias("country"))
    affiliations = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast(N.AWARD["affiliations"].dataType)).otherwise(F.array(
        affiliation(F.concat(F.lit("Institute "), (F.col("o_orderkey") % 7).cast("string")), F.col("birth_country")),
        affiliation(F.lit("Second"), F.col("birth_continent"))))
    award = lambda nth: F.struct(
        (F.year("o_orderdate") + nth).cast("string").alias("awardYear"),
        en(F.col("o_orderpriority")).alias("category"),
        F.when(status != "P", en(F.concat(F.lit("for order "), F.col("o_orderkey").cast("string")))).alias("motivation"),
        F.col("o_totalprice").cast("string").alias("prizeAmount"),
        F.when(nth > 0, F.concat(F.lit("1/"), (nth + 1).cast("string"))).alias("portion"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("dateAwarded"),
        affiliations.alias("affiliations"),
    )
    awards = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")), award)  # one to three
    return F.struct(
        F.col("o_custkey").cast("string").alias("id"),
        F.when(is_org, en(F.col("c_name"))).alias("orgName"),
        F.when(is_org, dated).alias("founded"),
        F.when(~is_org, en(F.split("c_name", "#")[0])).alias("givenName"),
        F.when(~is_org, en(F.split("c_name", "#")[1])).alias("familyName"),
        F.when(~is_org & (status == "F"), F.lit("female")).when(~is_org & (status == "O"), F.lit("male")).alias("gender"),
        F.when(~is_org, dated).alias("birth"),
        F.when(~is_org & (status == "F"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))).alias("death"),
        awards.alias(N.AWARDS_FIELD),
    )


def order_documents(spark, sf_dir):
    """One nested recipient document (JSON text) per order, see ``_recipient``."""
    # a document is some twenty times its row: the rows are dealt by number, not by their size, before it is built
    b = _held_orders(spark, sf_dir).repartition(_parts(read_table(spark, sf_dir, "orders"), DOCUMENTS_A_TASK), "o_orderkey")
    return b.select(F.to_json(F.struct(F.array(_recipient()).alias(N.RECORDS_FIELD))).alias("json"))


NESTED_SQL = """
WITH b AS (
  SELECT o.*, unnest(range(0, 1 + o.o_orderkey % 3)) AS nth, c.c_name, c.c_mktsegment = 'MACHINERY' AS is_org, n.n_name, r.r_name,
         year(o.o_orderdate) - 20 - (o.o_orderkey % 50) AS byear
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT CAST(o_custkey AS VARCHAR) AS id,
       CASE WHEN is_org THEN c_name ELSE trim(split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2)) END AS name,
       CASE WHEN is_org THEN 'organization' WHEN o_orderstatus = 'F' THEN 'female'
            WHEN o_orderstatus = 'O' THEN 'male' ELSE 'unknown' END AS gender,
       is_org,
       strftime(make_date(CAST(byear AS INTEGER), month(o_orderdate), 1), '%Y-%m-%d') AS birth_date,
       n_name AS birth_country, r_name AS birth_continent, o_orderpriority AS category,
       CAST(year(o_orderdate) + nth AS INTEGER) AS award_year,
       CAST(floor((year(o_orderdate) + nth) / 10) * 10 AS INTEGER) AS decade,
       CASE WHEN o_orderstatus <> 'P' THEN 'for order ' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS motivation,
       round(o_totalprice, 6) AS prize_amount,
       CASE WHEN nth = 0 THEN '1' ELSE '1/' || CAST(nth + 1 AS VARCHAR) END AS portion,
       CASE WHEN o_orderkey % 4 <> 0 THEN 'Institute ' || CAST(o_orderkey % 7 AS VARCHAR) END AS affiliation,
       CASE WHEN o_orderkey % 4 <> 0 THEN n_name END AS affiliation_country,
       CAST(year(o_orderdate) + nth - byear AS INTEGER) AS age_at_award,
       CASE WHEN NOT is_org AND o_orderstatus = 'F'
            THEN round(date_diff('day', make_date(CAST(byear AS INTEGER), month(o_orderdate), 1), CAST(o_orderdate AS DATE)) / 365.25, 1)
       END AS lifespan,
       NOT is_org AND o_orderstatus <> 'F' AS is_alive
FROM b
"""


def _flat(recipients):
    return round_doubles(N.flatten(recipients).select(
        "id", "name", "gender", "is_org", F.date_format("birth_date", "yyyy-MM-dd").alias("birth_date"),
        "birth_country", "birth_continent", "category", "award_year", "decade", "motivation", "prize_amount",
        "portion", "affiliation", "affiliation_country", "age_at_award", "lifespan", "is_alive",
    ))


@query("nested_records_flatten", NESTED_SQL)
def q_nested(spark, sf_dir):
    """P1-P10 / F21s: nested JSON round trip and flatten, one to three awards a record, none or two affiliations."""
    return _flat(N.parse_documents(order_documents(spark, sf_dir)))


@query("document_files_flatten", NESTED_SQL)
def q_files(spark, sf_dir):
    """The documents written as a directory of JSON files (a document a line) and read from there."""
    folder = f"{ensure_checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
    order_documents(spark, sf_dir).write.text(folder)
    return _flat(N.read_documents(spark, folder, lines=True))


def _in_files(records, *order):
    """``records`` (with shard) and nth, their place in their shard by ``order``, and n, its size; a shard is in one partition."""
    shard = Window.partitionBy("shard")
    return records.withColumns({"nth": F.row_number().over(shard.orderBy(*order)), "n": F.count(F.lit(1)).over(shard)})


def _write_placed(placed, folder, value, before, after, compression="none"):
    """``placed`` (see ``_in_files``): a file a shard, one document with one array of ``value`` (JSON) between the texts ``before`` and ``after``.

    The ends are part of the first and the last row of a shard, so that one shuffle brings a file's
    rows together; of a union Spark may coalesce each side for itself, which tears a shard apart.
    """
    text = F.concat(F.when(F.col("nth") > 1, F.lit(",")).otherwise(before), value, F.when(F.col("nth") == F.col("n"), after).otherwise(F.lit("")))
    placed.sortWithinPartitions("shard", "nth").select("shard", text.alias("value")).write.partitionBy("shard").option("compression", compression).text(folder)


def _write_array_files(records, folder, before, after):
    """``records`` (shard, value: JSON): a file a shard (see ``_write_placed``)."""
    _write_placed(_in_files(records, "value"), folder, F.col("value"), before, after)


def _records(spark, sf_dir):
    return order_documents(spark, sf_dir).select(F.get_json_object("json", f"$.{N.RECORDS_FIELD}[0]").alias("value"))


@query("document_array_flatten", NESTED_SQL)
def q_array_files(spark, sf_dir):
    """Large files, each one JSON document with one array of records, read by byte ranges."""
    folder = f"{ensure_checkpoint_dir(spark)}/arrays-{uuid.uuid4().hex}"
    n = _parts(read_table(spark, sf_dir, "orders"), DOCUMENTS_A_FILE)
    records = _records(spark, sf_dir).withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(n)))
    before = F.concat(F.lit('{"meta": {"count": '), F.col("n").cast("string"), F.lit(f', "note": "[}}\\\""}}, "{N.RECORDS_FIELD}": ['))
    _write_array_files(records, folder, before, F.lit('], "links": [{"next": null}]}'))
    return _flat(read_array(spark, folder, N.RECIPIENT, N.RECORDS_FIELD, range_bytes=1 << 20))


PAGES, STRIDE, GONE, TORN = 40, 7, 14, 5


@query("paged_source", f"""
SELECT 'mirror' AS source, CAST(p.position AS BIGINT) AS position, CAST(p.page AS VARCHAR) AS page, count(*) AS n_records, CAST(sum(o_custkey) AS BIGINT) AS sum_id
FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT range AS position, range * {STRIDE} % {PAGES} AS page FROM range({PAGES})) p ON p.page = o_custkey % {PAGES}
GROUP BY ALL
""")
def q_paged(spark, sf_dir):
    """Linked pages; of three sources the first lacks a page, the second has a torn one, and the third is read.

    Pages that are the same in several sources are the same files; each source reads all of its own.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    records = _held_orders(spark, sf_dir).withColumn("shard", F.pmod("o_custkey", F.lit(PAGES)).cast("int"))
    before, last = F.lit(f'{{"{N.RECORDS_FIELD}": ['), (PAGES - 1) * STRIDE % PAGES
    link = F.concat(F.lit('], "links": {"next": "'), ((F.col("shard") + STRIDE) % PAGES).cast("string"), F.lit('"}}'))
    whole = F.when(F.col("shard") == last, F.lit('], "links": {}}')).otherwise(link)
    for name, rows, after in (("whole", records, whole), ("torn", records.filter(F.col("shard") == TORN), F.lit('], "links": {"ne'))):
        # a document is some ten times its row, so the rows are dealt and sorted; its text is written once, in blocks that are read by themselves
        placed = _in_files(rows, "o_custkey", "o_orderkey")
        _write_placed(placed, f"{folder}/{name}", F.to_json(_recipient()), before, after, "snappy")
    held = {i: f"{folder}/whole/shard={i}" for i in range(PAGES)}
    lacks = [path for i, path in held.items() if i != GONE]
    tears = [*(held | {TORN: f"{folder}/torn/shard={TORN}"}).values()]
    sources = [paged.Paged(x, path, "0", "regexp_extract(_metadata.file_path, 'shard=([0-9]+)', 1)") for x, path in (("gone", lacks), ("torn", tears), ("mirror", [*held.values()]))]
    manifest = records.groupBy(F.col("shard").cast("string").alias("page")).agg(F.count("*").alias("n_records"))
    read = paged.read_pages(spark, sources, N.RECORDS_FIELD, N.RECIPIENT, manifest)
    rows = paged.records_of(read, "source", "position", "page")
    return rows.groupBy("source", "position", "page").agg(F.count("*").alias("n_records"), F.sum(F.col("id").cast("long")).alias("sum_id"))


@query("first_available_source", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def q_first_source(spark, sf_dir):
    """S3: the first of several sources that resolves is read."""
    paths = [table_path(sf_dir, "documents_latest"), table_path(sf_dir, "documents")]
    return read_first_available(spark, paths).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("report_sink_roundtrip", """
SELECT category, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderpriority AS category
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) GROUP BY category
""")
def q_sink(spark, sf_dir):
    """A report written to shared storage and read back."""
    report = order_facts(spark, sf_dir).groupBy("category").agg(F.sum("n_items").alias("n"))
    folder = f"{ensure_checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    return spark.read.parquet(write_reports({"by_category": report}, folder)[0])


@query("event_props", """
SELECT event_type, count(*) AS n,
       CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k,
       count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL) AS n_missing_k
FROM events GROUP BY event_type
""")
def q_event_props(spark, sf_dir):
    """P1 / F21s: JSON property extraction with defaults."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "props"])
    k = F.from_json(F.col("props"), "k STRING")["k"].try_cast("int")
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"), F.count(F.when(k.isNull(), F.lit(1))).alias("n_missing_k")
    )
