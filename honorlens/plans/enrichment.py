"""Registered enrichment and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_doubles
from ..operators import enrich as J
from ..operators import groups as G
from ..operators import search as Q
from ..operators.page_directory import PLACE, write_page_directory
from ..operators.text_index import write_text_index
from ..session import materialised
from ..sources.facts import award_facts, text_facts
from ..sources.tables import read_table
from .oracle_sql import with_fact
from .registry import query

# Fixed values of the derived label dimension: brands numbered above this have no label.
LABELLED_BRANDS_MAX = 20
# Fixed values of the registered gallery/search calls.
GALLERY_ARGS = {"search": "bl[a-z]e", "category": "2-HIGH", "nationality": "B-1", "page": 2}
DOC_SEARCH_ARGS = {"search": "qu[a-z]+e", "category": "fr", "page": 1}
# Terms looked up in the text index (a common word, two expressions, alternatives, one in no text).
INDEXED_TERMS = ["pation", "reth.*andon", "src1[0-4]", "vi[eè]le|whst the", "no text holds this"]


# ---------------------------------------------------------------- bound sources

def claims_table(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """(entity_id, pos, value): the brands each customer bought, in order of
    first purchase (brand name breaks ties). Bounded per entity by the brand count.
    ``ids`` (entity_id): only those customers."""
    items = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    if ids is not None:
        orders = orders.join(ids, orders.o_custkey == ids.entity_id, "left_semi")
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    pairs = (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(part, items.l_partkey == part.p_partkey)
        .groupBy(F.col("o_custkey").alias("entity_id"), F.col("p_brand").alias("value"))
        .agg(F.min("o_orderdate").alias("_first"))
    )
    w = Window.partitionBy("entity_id").orderBy("_first", "value")
    return pairs.select("entity_id", F.row_number().over(w).alias("pos"), "value")


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, label) for part brands, with gaps (unlabelled brands fall back to the id)."""
    part = read_table(spark, sf_dir, "part", ["p_brand"]).distinct()
    num = F.substring(F.col("p_brand"), 7, 10).try_cast("int")
    return part.filter(num <= LABELLED_BRANDS_MAX).select(
        F.col("p_brand").alias("qid"), F.concat(F.lit("B-"), num.cast("string")).alias("label")
    )


def nationalities(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """J1 + J8: one row per distinct recipient id (of ``ids``, if given) with its ordered label string."""
    if ids is None:
        orders = read_table(spark, sf_dir, "orders", ["o_custkey"])
        keys = J.distinct_keys(orders.withColumnRenamed("o_custkey", "entity_id"), "entity_id")
    else:
        keys = J.distinct_keys(ids, "entity_id")
    return J.ordered_labels(keys, claims_table(spark, sf_dir, None if ids is None else keys), label_table(spark, sf_dir))


NATIONALITY_SQL = f"""claims AS (
  SELECT o_custkey AS entity_id, p_brand AS value, min(o_orderdate) AS first_seen
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
pos AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY first_seen, value) AS pos FROM claims),
labels AS (SELECT DISTINCT p_brand AS qid, 'B-' || CAST(TRY_CAST(substr(p_brand, 7, 10) AS INTEGER) AS VARCHAR) AS label
           FROM part WHERE TRY_CAST(substr(p_brand, 7, 10) AS INTEGER) <= {LABELLED_BRANDS_MAX}),
nat AS (SELECT entity_id, string_agg(coalesce(label, value), ', ' ORDER BY pos) AS nationality
        FROM pos LEFT JOIN labels ON qid = value GROUP BY entity_id),
nationality AS (SELECT k.entity_id, nat.nationality FROM (SELECT DISTINCT o_custkey AS entity_id FROM orders) k
                LEFT JOIN nat USING (entity_id))"""


def alias_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Titles of conversation turns, ``from → to`` redirect edges from a turn
    to the next one, and a thumbnail for every assistant turn."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"])
    title = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    titled = conv.select("conv_id", "turn", "role", title.alias("title"))
    nxt = titled.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("title").alias("to"))
    edges = titled.join(nxt, ["conv_id", "turn"]).select(F.col("title").alias("from"), "to")
    starts = titled.select("title")
    thumbs = titled.filter(F.col("role") == "assistant").select(
        F.col("title").alias("page_title"),
        F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"),
                 F.lit(".png")).alias("thumb"),
    )
    return starts, edges, thumbs


# ---------------------------------------------------------------- registered queries

@query("nationality_labels", with_fact(f"""
, {NATIONALITY_SQL}
SELECT entity_id, nationality FROM nationality
""".replace("\n, claims AS", "WITH claims AS", 1)))
def q_nationality(spark, sf_dir):
    """Ordered nationality labels per recipient."""
    return nationalities(spark, sf_dir)


@query("nationality_tokens", with_fact(f"""
, {NATIONALITY_SQL}
SELECT DISTINCT token FROM (SELECT unnest(string_split(nationality, ', ')) AS token FROM nationality
                            WHERE nationality IS NOT NULL) WHERE token <> ''
""".replace("\n, claims AS", "WITH claims AS", 1)))
def q_tokens(spark, sf_dir):
    """Distinct nationality tokens."""
    return G.delimited_tokens(nationalities(spark, sf_dir), "nationality", ", ")


@query("alias_resolution", """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, 'c' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS title FROM conversations),
edges AS (SELECT a.title AS src, b.title AS dst FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
thumbs AS (SELECT title, 'img/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.png' AS thumb
           FROM t WHERE role = 'assistant'),
chain(start, cur, depth) AS (
  SELECT DISTINCT title, title, CAST(0 AS BIGINT) FROM t
  UNION ALL
  SELECT chain.start, edges.dst, chain.depth + 1 FROM chain JOIN edges ON chain.cur = edges.src),
fin AS (SELECT start, arg_max(cur, depth) AS final, max(depth) AS depth FROM chain GROUP BY start)
SELECT fin.start, fin.final, fin.depth, fin.final NOT IN (SELECT src FROM edges) AS resolved,
       coalesce(thumbs.thumb, '') AS img_url
FROM fin LEFT JOIN thumbs ON thumbs.title = fin.final
""")
def q_alias(spark, sf_dir):
    """Alias-chain resolution with thumbnails."""
    starts, edges, thumbs = alias_edges(spark, sf_dir)
    return J.resolved_images(starts, edges, thumbs)


def _gallery_sql() -> str:
    a = GALLERY_ARGS
    return with_fact(f"""
, {NATIONALITY_SQL},
f AS (SELECT fact.*, coalesce(p.p_name, '') AS motivation, nationality.nationality
      FROM fact LEFT JOIN part p ON p.p_partkey = fact.partkey
      LEFT JOIN nationality ON nationality.entity_id = fact.id),
m AS (SELECT award_year, id, category, name, motivation,
             coalesce(nationality, nullif(birth_country, ''), 'Unknown') AS display_country FROM f
      WHERE (regexp_matches(lower(name), '{a["search"]}') OR regexp_matches(lower(motivation), '{a["search"]}'))
        AND category = '{a["category"]}' AND coalesce(contains(nationality, '{a["nationality"]}'), false)),
info AS (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 40.0) AS INTEGER)) AS max_pages FROM m),
pg AS (SELECT least(greatest(1, {a["page"]}), max_pages) AS page, max_pages, total FROM info)
SELECT name, category, award_year, display_country, motivation, pg.page, pg.max_pages, CAST(pg.total AS BIGINT) AS total_results,
       printf('Page %d of %d · %d results', pg.page, pg.max_pages, pg.total) AS page_info,
       upper(category) AS category_label
FROM (SELECT * FROM m ORDER BY award_year, id, category, name, motivation, display_country
      LIMIT 40 OFFSET (SELECT (page - 1) * 40 FROM pg)) CROSS JOIN pg
""".replace("\n, claims AS", "WITH claims AS", 1))


@query("gallery_page", _gallery_sql())
def q_gallery(spark, sf_dir):
    """One gallery page with facets."""
    args = dict(GALLERY_ARGS)
    fact = award_facts(spark, sf_dir, with_text=True).filter(Q.text_match(["name", "motivation"], args.pop("search")))
    # the cheap filters leave few rows: they are kept, and labels are built for their ids only
    fact = materialised(Q.facet_filter(fact, {"category": args.pop("category")}))
    nat = nationalities(spark, sf_dir, fact.select(F.col("id").alias("entity_id"))).withColumnRenamed("entity_id", "id")
    return Q.gallery(fact.join(nat, "id", "left"), **args)


KEYSET_PAGES = 3


def _people_sql() -> str:
    return f"""
SELECT * FROM (SELECT birth_country, award_year, id, category, count(*) AS n FROM (
  SELECT CASE WHEN is_org THEN NULL ELSE birth_country END AS birth_country, award_year, id, category FROM fact)
  GROUP BY ALL) ORDER BY birth_country NULLS LAST, award_year, id, category LIMIT {40 * KEYSET_PAGES}"""


@query("keyset_pages_null_keys", with_fact(_people_sql()))
def q_keyset(spark, sf_dir):
    """The first pages of a listing whose leading key is null for organisations, a page after the other."""
    f = award_facts(spark, sf_dir).withColumn("birth_country", F.when(~F.col("is_org"), F.col("birth_country")))
    order = ["birth_country", "award_year", "id", "category"]
    listing = materialised(f.groupBy(*order).agg(F.count(F.lit(1)).alias("n")))
    pages, last = [], None
    for _ in range(KEYSET_PAGES):
        page = Q.page_after(listing, order, last, 40)
        rows = page.collect()  # 40 rows
        if not rows:
            break
        pages.append(page)
        last = [rows[-1][c] for c in order]
    out = pages[0] if pages else listing.limit(0)
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


LISTING_SQL = """, l AS (SELECT birth_country, award_year, id, category, count(*) AS n FROM (
  SELECT CASE WHEN is_org THEN NULL ELSE birth_country END AS birth_country, award_year, id, category FROM fact) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY birth_country NULLS LAST, award_year, id, category) AS place, count(*) OVER () AS total FROM l),
m AS (SELECT *, CAST(floor((place - 1) / 40) + 1 AS INTEGER) AS page, CAST(ceil(total / 40.0) AS INTEGER) AS max_pages FROM r)
SELECT birth_country, award_year, id, category, n, place, page, total, printf('Page %d of %d · %d results', page, max_pages, total) AS page_info
FROM m WHERE page IN (1, CAST(floor((max_pages + 1) / 2) AS INTEGER), max_pages)
""".replace(", l AS", "WITH l AS", 1)


@query("listing_pages", with_fact(LISTING_SQL))
def q_listing_pages(spark, sf_dir):
    """First, middle and last page of the whole listing, each read from the files that hold it."""
    f = award_facts(spark, sf_dir).withColumn("birth_country", F.when(~F.col("is_org"), F.col("birth_country")))
    order = ["birth_country", "award_year", "id", "category"]
    directory = write_page_directory(f.groupBy(*order).agg(F.count(F.lit(1)).alias("n")), order, 40)
    out = None
    for p in sorted({1, (directory.max_pages + 1) // 2, directory.max_pages}):
        rows, info = directory.page(p)
        rows = rows.select(*order, "n", F.col(PLACE).alias("place"), F.lit(info["page"]).alias("page"),
                           F.lit(info["total"]).cast("long").alias("total"), F.lit(info["page_info"]).alias("page_info"))
        out = rows if out is None else out.unionByName(rows)
    return out


IMAGES_SQL = """t AS (
  SELECT conv_id, turn, role, 'c' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS title FROM conversations),
edges AS (SELECT a.title AS src, b.title AS dst FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
thumbs AS (SELECT title, 'img/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.png' AS thumb
           FROM t WHERE role = 'assistant'),
chain(start, cur, depth) AS (
  SELECT DISTINCT title, title, CAST(0 AS BIGINT) FROM t
  UNION ALL
  SELECT chain.start, edges.dst, chain.depth + 1 FROM chain JOIN edges ON chain.cur = edges.src),
images AS (SELECT f.start, coalesce(thumbs.thumb, '') AS img_url
           FROM (SELECT start, arg_max(cur, depth) AS final FROM chain GROUP BY start) f
           LEFT JOIN thumbs ON thumbs.title = f.final)"""


def enriched_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with ``nationality`` (J1) and ``img_url`` (J2) attached; '' without an image.
    A recipient's page is the first turn of the conversation with its id."""
    fact = award_facts(spark, sf_dir)
    nat = nationalities(spark, sf_dir).withColumnRenamed("entity_id", "id")
    slug = F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("/0"))
    starts, edges, thumbs = alias_edges(spark, sf_dir)
    images = J.resolved_images(starts, edges, thumbs).select(F.col("start").alias("_slug"), "img_url")
    out = fact.withColumn("_slug", slug).join(nat, "id", "left").join(images, "_slug", "left").drop("_slug")
    return out.withColumn("img_url", F.coalesce("img_url", F.lit("")))


@query("enriched_fact_table", with_fact(f"""
, {NATIONALITY_SQL}, {IMAGES_SQL}
SELECT f.id, f.name, f.category, f.award_year, f.birth_country, f.age_at_award, round(f.prize_amount, 6) AS prize_amount,
       nationality.nationality, coalesce(images.img_url, '') AS img_url
FROM fact f LEFT JOIN nationality ON nationality.entity_id = f.id
LEFT JOIN images ON images.start = 'c' || CAST(f.id AS VARCHAR) || '/0'
""".replace("\n, claims AS", "WITH claims AS", 1)).replace("WITH fact AS", "WITH RECURSIVE fact AS", 1))
def q_enriched(spark, sf_dir):
    """One fact table with nationality and image."""
    return round_doubles(enriched_facts(spark, sf_dir).select(
        "id", "name", "category", "award_year", "birth_country", "age_at_award", "prize_amount", "nationality", "img_url"))


@query("document_search", f"""
WITH d AS (SELECT doc_id AS id, source AS name, lang AS category, coalesce(text, '') AS motivation FROM documents),
m AS (SELECT NULL::INTEGER AS award_year, id, category, name, motivation, 'Unknown' AS display_country FROM d
      WHERE (regexp_matches(lower(name), '{DOC_SEARCH_ARGS["search"]}')
             OR regexp_matches(lower(motivation), '{DOC_SEARCH_ARGS["search"]}'))
        AND category = '{DOC_SEARCH_ARGS["category"]}'),
info AS (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 40.0) AS INTEGER)) AS max_pages FROM m),
pg AS (SELECT least(greatest(1, {DOC_SEARCH_ARGS["page"]}), max_pages) AS page, max_pages, total FROM info)
SELECT name, category, award_year, display_country, motivation, pg.page, pg.max_pages, CAST(pg.total AS BIGINT) AS total_results,
       printf('Page %d of %d · %d results', pg.page, pg.max_pages, pg.total) AS page_info,
       upper(category) AS category_label
FROM (SELECT * FROM m ORDER BY award_year, id, category, name, motivation, display_country
      LIMIT 40 OFFSET (SELECT (page - 1) * 40 FROM pg)) CROSS JOIN pg
""")
def q_doc_search(spark, sf_dir):
    """Whole-text search over the document corpus."""
    docs = text_facts(spark, sf_dir).withColumn("award_year", F.lit(None).cast("int")).withColumn(
        "birth_country", F.lit(None).cast("string"))
    return Q.gallery(docs, **DOC_SEARCH_ARGS)


@query("indexed_search", """WITH d AS (SELECT doc_id AS id, lower(source) AS s, lower(coalesce(text, '')) AS t, source AS name, lang AS category FROM documents)
""" + " UNION ALL ".join(
    f"""SELECT '{t}' AS term, id, name, category FROM d WHERE regexp_matches(s, '{t}') OR regexp_matches(t, '{t}')""" for t in INDEXED_TERMS))
def q_indexed_search(spark, sf_dir):
    """Every match of five terms in whole texts, found through the trigram index."""
    index = write_text_index(text_facts(spark, sf_dir), ["name", "motivation"], ["category", "name"])
    out = None
    for term in INDEXED_TERMS:
        rows = index.search(term).select(F.lit(term).alias("term"), "id", "name", "category")
        out = rows if out is None else out.unionByName(rows)
    return out
