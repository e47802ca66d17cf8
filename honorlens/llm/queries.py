"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import read_table
from . import common, cuckoo, decontam, fim, importance, langid, linededup, packing, partenum, records, sharding, sketch, tokencount, urlfilter

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_best_fit_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens; the other two capacities are what 2048 tokens imply."""
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return packing.pack_documents(docs, common.tokenizer_path(BYTE_BPE), packing.Capacity(2048))


def op2_minimax_sharding(spark, sf_dir):
    out = sharding.shard_documents(common.documents(spark, sf_dir, "doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark, sf_dir):
    return langid.identify(common.documents(spark, sf_dir, "doc_id", "text", "lang"))


def op4_token_counts(spark, sf_dir):
    return tokencount.count_tokens(common.documents(spark, sf_dir, "doc_id", "text"), common.tokenizer_path(BYTE_BPE), 1024)


def op5_token_records(spark, sf_dir):
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    out = records.encode_to_records(docs, common.tokenizer_path(WORD_BPE))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_near_duplicates(spark, sf_dir):
    return partenum.near_duplicates(common.documents(spark, sf_dir, "doc_id", "text"))


RULES = [
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
]


def op7_url_filter(spark, sf_dir):
    out = urlfilter.judge_urls(read_table(spark, sf_dir, "pages", ["page_id", "url"]), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark, sf_dir):
    out = linededup.drop_frequent_lines(common.documents(spark, sf_dir, "doc_id", "text"), 10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_exact_dedup(spark, sf_dir):
    out = cuckoo.exact_dedup(common.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_decontamination(spark, sf_dir):
    return decontam.leaks(common.documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op11_fill_in_middle(spark, sf_dir):
    out = fim.fill_in_middle(common.documents(spark, sf_dir, "doc_id", "text"))
    back = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_document_fingerprints(spark, sf_dir):
    out = sketch.edited_fingerprints(common.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op13_importance_resampling(spark, sf_dir):
    return importance.resampled(common.documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "benchmark", ["text"]))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

OP7_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
urls AS (SELECT page_id, row_number() OVER () AS i, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
                translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
         FROM rest),
fit AS (SELECT i, arg_max(rules.host || rules.path, length(rules.host) + length(rules.path)) AS rule,
               arg_max(verdict, length(rules.host) + length(rules.path)) AS verdict
        FROM urls JOIN rules ON (urls.host = rules.host OR ends_with(urls.host, '.' || rules.host))
                            AND starts_with(urls.path, rules.path) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fit USING (i)
"""

OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS i, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT i, unnest(ls) AS line, generate_subscripts(ls, 1) AS nth FROM docs),
keyed AS (SELECT i, nth, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT i) >= 10),
kept AS (SELECT i, coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (k NOT IN (SELECT k FROM often)), '') AS t,
                count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM often)) AS n_dropped FROM keyed GROUP BY i)
SELECT doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM kept JOIN docs USING (i)
"""

OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
                 list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS hs FROM docs),
cuts AS (SELECT doc_id, t, us, len(us) AS n, least(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS a, greatest(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain'
                     WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM parts
"""


def _sketch_sql(text: str) -> str:
    """The kept hashes of a text's shingles, as a sorted list."""
    tokens = f"string_split_regex(trim(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"
    hashes = f"(SELECT CASE WHEN ws[1] = '' THEN [] ELSE list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: md5(array_to_string(ws[i:i + 4], ' '))[1:16]) END FROM (SELECT {tokens} AS ws))"
    return f"(SELECT CASE WHEN len(low) > 0 OR len(hs) = 0 THEN list_sort(list_distinct(low)) ELSE [list_min(hs)] END FROM (SELECT hs, list_filter(hs, lambda h: h < '4') AS low FROM (SELECT {hashes} AS hs)))"


OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS i, doc_id, coalesce(text, '') AS t FROM documents),
sketched AS (SELECT i, doc_id, t, {_sketch_sql("t")} AS a FROM docs),
pairs AS (SELECT x.doc_id, x.t, x.a, y.t AS u, y.a AS c FROM sketched x JOIN sketched y ON y.i = x.i % (SELECT count(*) FROM docs) + 1),
edited AS (SELECT *, left(t, length(t) - length(t) // 2) || left(u, length(t) // 2) AS e FROM pairs),
marked AS (SELECT *, {_sketch_sql("e")} AS b FROM edited),
counts AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM marked)
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE CAST(ab AS DOUBLE) / (len(a) + len(b) - ab) END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE CAST(ac AS DOUBLE) / (len(a) + len(c) - ac) END AS near_next FROM counts
"""

OP13_SQL = r"""
WITH RECURSIVE steps(byte, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
                                     SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS turned FROM steps WHERE k = 8),
docs AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
counted AS (SELECT i, w, count(*) AS n FROM (SELECT i, unnest(ws) AS w FROM docs) GROUP BY i, w),
known AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM counted UNION SELECT w FROM items)),
bucketed AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda j: CAST('0x' || substr(x, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))),
                           lambda c, b: xor(c >> 8, turned[xor(c, b) % 256 + 1]))) % 10000 AS bucket FROM known, crc),
corpus AS (SELECT bucket, sum(n) AS s FROM counted JOIN bucketed USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM items JOIN bucketed USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM corpus) + 10000) AS DOUBLE)
                                         / CAST((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM target) + 10000) AS DOUBLE))) AS gain FROM corpus LEFT JOIN target USING (bucket)),
summed AS (SELECT i, floor(sum(n * gain) / sum(n)) AS weight FROM counted JOIN bucketed USING (w) JOIN gains USING (bucket) GROUP BY i),
scored AS (SELECT doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
           FROM docs LEFT JOIN summed USING (i)),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM placed
"""

_QUERIES = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_minimax_sharding": (op2_minimax_sharding, None),
    "op3_language_id": (op3_language_id, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_token_records": (op5_token_records, None),
    "op6_near_duplicates": (op6_near_duplicates, None),
    "op7_url_filter": (op7_url_filter, OP7_SQL),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_decontamination": (op10_decontamination, None),
    "op11_fill_in_middle": (op11_fill_in_middle, OP11_SQL),
    "op12_document_fingerprints": (op12_document_fingerprints, OP12_SQL),
    "op13_importance_resampling": (op13_importance_resampling, OP13_SQL),
}


def _shipped(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__doc__, run.__name__ = fn.__doc__, fn.__name__
    return run


def queries():
    return {name: _shipped(fn) for name, (fn, _) in _QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
