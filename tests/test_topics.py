"""M8: the vocabulary from one pass over the texts."""

from collections import Counter

from __spark_entry__ import queries
from honorlens.operators import topics
from tests.conftest import SMALL


def test_the_vocabulary_counts_terms_and_documents(spark):
    texts = ["alpha beta alpha", "beta", "", "the of", "gamma beta gamma gamma beta", "alpha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, motivation string")
    got = {r.term: (r.df, r.tf_total) for r in topics.vocabulary(topics.term_lists(docs), min_df=1, max_df=1.0).collect()}
    tf, df = Counter(), Counter()
    for text in texts:
        uni = [w for w in text.split() if w not in topics.ENGLISH_STOP_WORDS]
        terms = uni + [f"{a} {b}" for a, b in zip(uni, uni[1:])]
        tf.update(terms)
        df.update(set(terms))
    assert got == {t: (df[t], n) for t, n in tf.items()}


def test_term_lists_are_not_kept(spark):
    spark.catalog.clearCache()
    found = queries()["tfidf_vocabulary"](spark, SMALL)
    assert "InMemory" not in found._jdf.queryExecution().withCachedData().toString()
    assert found.count() > 0
