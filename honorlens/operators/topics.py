"""TF-IDF vocabulary and truncated-SVD topics over whole texts.

Tokenisation, stop words and bigrams are Spark ML transformers (JVM). The
vocabulary is chosen with DataFrame aggregates — df ≥ min_df, df ≤ max_df·n,
top ``max_features`` by corpus count, term order breaking ties — so it is
deterministic and checkable in SQL. Term frequencies come from a
``CountVectorizerModel`` built on that vocabulary, scaled by the smooth idf
ln((1+n)/(1+df)) + 1 (``ElementwiseProduct``) and L2-normalised. The truncated
SVD runs on an ``IndexedRowMatrix`` created directly from the DataFrame (the
document vectors never pass through Python): one JVM tree aggregate builds the
Gramian XᵀX, whose size is bounded by the vocabulary cap; its eigenvectors are
V; one more JVM pass gives the k scores per document, which return as rows.
"""

from __future__ import annotations

import math

import pandas as pd

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A token is a run of at least two word characters (letters,
# marks, decimal digits, connector punctuation), matched on lower-cased text.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}"


# Spark ML's built-in English stop words, so that both sides of the check use one list
# and importing this module reads no file and starts no JVM.
ENGLISH_STOP_WORDS = tuple("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll
    she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
    shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's
    who's why's would
""".split())


def english_stop_words() -> list[str]:
    return list(ENGLISH_STOP_WORDS)


def term_lists(docs: DataFrame, text: str = "motivation", ngram_range: tuple[int, int] = (1, 2),
               stop_words: list[str] | None = None) -> DataFrame:
    """Adds ``terms``: unigrams (stop words removed) followed by the bigrams of that sequence."""
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True,
                         minTokenLength=1)
    # tokens are already lower-cased, so a case-sensitive lookup gives the same result, faster
    sw = StopWordsRemover(inputCol="_tok", outputCol="_uni", caseSensitive=True,
                          stopWords=[w.lower() for w in (stop_words if stop_words is not None else english_stop_words())])
    out = sw.transform(tok.transform(docs))
    if ngram_range[1] >= 2:
        out = NGram(n=2, inputCol="_uni", outputCol="_bi").transform(out)
        terms = F.concat(F.col("_uni"), F.col("_bi")) if ngram_range[0] == 1 else F.col("_bi")
    else:
        terms = F.col("_uni")
    return out.withColumn("terms", terms).drop("_tok", "_uni", "_bi")


def vocabulary(termed: DataFrame, id_col: str = "id", max_features: int = 1000, min_df: int = 2,
               max_df: float = 0.95) -> DataFrame:
    """M8: (term, df, tf_total, idf, rank) of the selected vocabulary (rank 1 = most frequent)."""
    # one pass over the texts, nothing kept: sorted, the equal terms of a document stand together and the
    # first of them counts the document. The aggregate is partial on the map side, so no (document, term)
    # pairs are shuffled. A kept term list is some ten times its text, all of it read by a task a split.
    n_docs = termed.agg(F.count(F.lit(1)).alias("_n"))
    sort = termed.select(F.sort_array("terms").alias("_s"))
    lagged = F.slice(F.concat(F.array(F.lit(None).cast("string")), "_s"), 1, F.size("_s"))
    marked = F.zip_with("_s", lagged, lambda x, before: F.struct(x.alias("term"), (~x.eqNullSafe(before)).cast("long").alias("first")))
    # outer: for an inner explode Spark adds a filter on the array's size, which makes the lists twice
    counted = sort.select(F.explode_outer(marked).alias("_t")).filter(F.col("_t").isNotNull())
    stats = counted.groupBy("_t.term").agg(F.sum("_t.first").alias("df"), F.count(F.lit(1)).alias("tf_total"))
    from .groups import with_scalar

    cand = with_scalar(stats, n_docs).filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("_n")))
    from .windows import top_k

    top = top_k(cand, [F.desc("tf_total"), F.asc("term")], max_features, "rank")
    return top.select(
        "term", "df", "tf_total",
        (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"),
        "rank",
    )


def tfidf(termed: DataFrame, vocab_rows: list, out: str = "tfidf") -> DataFrame:
    """TF (vocabulary given) × smooth idf, L2-normalised rows."""
    vocab = [r["term"] for r in vocab_rows]
    idf = Vectors.dense([float(r["idf"]) for r in vocab_rows])
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol="terms", outputCol="_tf")
    scaled = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_w").transform(cv.transform(termed))
    return Normalizer(p=2.0, inputCol="_w", outputCol=out).transform(scaled).drop("_tf", "_w")


def truncated_svd(weighted: DataFrame, index_col: str, vec_col: str, k: int):
    """M9: top-k singular triplets of the (uncentered) document × term matrix X.

    One distributed pass builds the Gramian XᵀX (terms × terms, bounded by the
    vocabulary cap) with a tree aggregate in the JVM; its top-k eigenvectors
    are V and the square roots of its eigenvalues are the singular values.
    Scores X·V come from one more pass over the sparse vectors in Arrow batches.
    Signs are fixed so the largest-|v| entry of every component is positive.
    Returns (scores DataFrame(index, scores array), V as a list of k columns, s)."""
    import numpy as np

    rows = MLUtils.convertVectorColumnsFromML(weighted.select(F.col(index_col).cast("long").alias("index"),
                                                              F.col(vec_col).alias("vector")), "vector")
    mat = IndexedRowMatrix(rows)
    gram = mat.toRowMatrix().computeGramianMatrix().toArray()
    vals, vecs = np.linalg.eigh(gram)
    top = np.argsort(vals)[::-1][:k]
    vals = np.clip(vals[top], 0.0, None)
    v = vecs[:, top]
    for j in range(v.shape[1]):  # sign convention: largest |v| positive
        if v[np.argmax(np.abs(v[:, j])), j] < 0:
            v[:, j] = -v[:, j]
    s = [float(x) for x in np.sqrt(vals)]
    comps = [[float(x) for x in v[:, j]] for j in range(v.shape[1])]
    wide = weighted.sparkSession.sparkContext.broadcast(v)  # vocabulary × k, bounded by the vocabulary cap

    @F.pandas_udf("array<double>")
    def project(vec: pd.DataFrame) -> pd.Series:
        v, out = wide.value, []
        for indices, values in zip(vec["indices"], vec["values"], strict=True):  # one product per Arrow row, batched
            out.append((v[indices].T @ values if indices is not None else v.T @ values).tolist())
        return pd.Series(out)

    scores = weighted.select(F.col(index_col).cast("long").alias(index_col), project(F.unwrap_udt(vec_col)).alias("scores"))
    return scores, comps, s


def top_terms(spark, vocab: list[str], comps: list[list[float]], n_top: int = 10) -> DataFrame:
    """Top ``n_top`` terms by signed weight per topic ("Topic i", 1-based)."""
    rows = [(f"Topic {j + 1}", j, vocab[i], w) for j, comp in enumerate(comps) for i, w in enumerate(comp)]
    df = spark.createDataFrame(rows, "topic string, topic_index int, term string, weight double")
    from .windows import top_k_per_group

    return top_k_per_group(df, ["topic"], [F.desc("weight"), F.asc("term")], n_top, "rank")


def dominant_topic(scores: DataFrame) -> DataFrame:
    """0-based index of the largest signed score."""
    return scores.withColumn("dominant_topic", F.array_position("scores", F.array_max("scores")) - 1)


def explained_variance(scores: DataFrame, weighted: DataFrame, vec_col: str, k: int) -> DataFrame:
    """Σ var(scores) / Σ var(columns of X), in percent (population variances).

    Σ_j var(X_j) = mean‖x‖² − ‖mean x‖²; the mean vector comes from
    ``Summarizer`` (JVM), the squared norms from the dense array view."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    from .groups import with_scalar

    def sq_norm(arr):
        return F.aggregate(F.transform(arr, lambda x: x * x), F.lit(0.0), lambda a, b: a + b)

    var_s = scores.select(*[F.col("scores")[j].alias(f"s{j}") for j in range(k)]).agg(
        *[F.var_pop(f"s{j}").alias(f"v{j}") for j in range(k)])
    total_s = sum((F.col(f"v{j}") for j in range(1, k)), F.col("v0"))
    moments = weighted.select(Summarizer.mean(F.col(vec_col)).alias("m"),
                              F.avg(sq_norm(vector_to_array(F.col(vec_col)))).alias("sq"))
    moments = moments.select("sq", sq_norm(vector_to_array(F.col("m"))).alias("mm"))
    return with_scalar(var_s.select(total_s.alias("_vs")), moments).select(
        (F.try_divide(F.col("_vs"), F.col("sq") - F.col("mm")) * 100).alias("explained_variance_pct"))


def idf_value(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1
