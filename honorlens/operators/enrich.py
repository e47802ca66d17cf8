"""Enrichment joins: ordered multi-valued labels, alias-chain resolution,
dimension lookups with defaults, semi-joins (J1-J8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """The distinct non-null lookup keys."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def ordered_labels(
    entity_keys: DataFrame, claims: DataFrame, labels: DataFrame, key: str = "entity_id",
    pos: str = "pos", value: str = "value", label_key: str = "qid", label: str = "label",
    out: str = "nationality", sep: str = ", ",
) -> DataFrame:
    """For each key, its claim values in claim order mapped to labels
    (missing label → the value itself), joined with ``sep``. A key without
    claims, or unknown, gets NULL.

    ``claims`` is an edge table (key, pos, value); null values (unreadable
    claims) are skipped. The per-key list is bounded by the claims of one entity."""
    edges = claims.filter(F.col(value).isNotNull()).select(key, pos, value)
    lab = labels.select(F.col(label_key).alias(value), F.col(label).alias("_label"))
    named = edges.join(lab, value, "left").select(
        key, pos, F.coalesce(F.col("_label"), F.col(value)).alias("_label")
    )
    per_key = named.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("_label")))), lambda x: x["_label"]),
            sep,
        ).alias(out)
    )
    return entity_keys.join(per_key, key, "left")


def resolve_aliases(
    starts: DataFrame, edges: DataFrame, start: str = "title", src: str = "from", dst: str = "to",
    order: str | None = None, underscores_to_spaces: bool = True,
) -> DataFrame:
    """Follow ``from → to`` edges until the title has no outgoing edge, however long the chain.

    Of several edges from one title the last by ``order`` counts (without it: the
    largest target). Pointer doubling over the edge table: each round replaces
    every hop a→b by a→(where b leads), so a chain of depth d needs log2(d) rounds
    of one distributed join, written once a round. A title that still leads
    somewhere after log2(number of sources) + 1 rounds is on or before a cycle
    (which never ends in the reference): its final title and depth are null and
    ``resolved`` is false. As in the reference, a slug is first turned into a title
    (``_`` → space, F2s); ``start`` keeps the slug. Output: start, final, depth, resolved."""
    used = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    last = F.max_by(dst, order) if order else F.max(dst)
    hop = used.groupBy(F.col(src).alias("_a")).agg(last.alias("_b"))
    hop = materialised(hop.select("_a", "_b", F.lit(1).cast("long").alias("_d"), F.lit(False).alias("_open")))
    for _ in range(hop.count().bit_length() + 1):
        ahead = hop.select(F.col("_a").alias("_m"), F.col("_b").alias("_e"), F.col("_d").alias("_f"))
        hop = materialised(
            hop.join(ahead, hop._b == ahead._m, "left").select(
                "_a", F.coalesce("_e", "_b").alias("_b"), (F.col("_d") + F.coalesce("_f", F.lit(0))).alias("_d"),
                F.col("_m").isNotNull().alias("_open"),
            )
        )
        if hop.filter("_open").isEmpty():
            break
    title = F.replace(F.col("start"), F.lit("_"), F.lit(" ")) if underscores_to_spaces else F.col("start")
    cur = starts.select(F.col(start).alias("start")).filter(F.col("start").isNotNull()).distinct().withColumn("_t", title)
    endless = F.coalesce(F.col("_open"), F.lit(False))
    return cur.join(hop, cur._t == hop._a, "left").select(
        "start",
        F.when(~endless, F.coalesce("_b", "_t")).alias("final"),
        F.when(~endless, F.coalesce("_d", F.lit(0))).alias("depth"),
        (~endless).alias("resolved"),
    )


def resolved_images(
    starts: DataFrame, edges: DataFrame, thumbs: DataFrame, start: str = "title", src: str = "from", dst: str = "to",
    page: str = "page_title", thumb: str = "thumb", out: str = "img_url", order: str | None = None,
) -> DataFrame:
    """The thumbnail of the page that each title finally leads to, '' without one."""
    found = resolve_aliases(starts, edges, start, src, dst, order)
    images = thumbs.groupBy(F.col(page).alias("_page")).agg(F.max(thumb).alias("_thumb"))
    return found.join(images, found.final == images._page, "left").select(
        "start", "final", "depth", "resolved", F.coalesce("_thumb", F.lit("")).alias(out))


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, how: str = "inner",
           broadcast_dim: bool = False) -> DataFrame:
    """J4 / J5 / F19s: dimension lookup by key. ``inner`` drops rows without a
    match (J4); ``left`` keeps them for a ``coalesce`` default (J5).
    ``broadcast_dim`` only for dimensions with a fixed size."""
    d = F.broadcast(dim) if broadcast_dim else dim
    if key == dim_key:
        return df.join(d, key, how)
    return df.join(d, df[key] == d[dim_key], how).drop(d[dim_key])


def keep_members(df: DataFrame, members: DataFrame, key: str | list[str]) -> DataFrame:
    """Semi-join — rows of ``df`` whose key (one or several columns) is in ``members``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(members.select(*keys), keys, "left_semi")
