"""op3: any number of languages, and languages with few labelled rows."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from honorlens.llm import langid
from tests.llm.fixtures import SCHEMA


def tongue(seed, n=40):
    """Words of an invented language."""
    rnd = random.Random(seed)
    letters = rnd.sample("abcdefghijklmnopqrstuvwxyzäöüñçøåßéè", 9)
    return ["".join(rnd.choices(letters, k=rnd.randint(3, 8))) for _ in range(n)]


def said(seed, vocabulary, n):
    return " ".join(random.Random(seed).choices(vocabulary, k=n))


def test_more_languages_than_a_mask_word_has_bits(spark):
    rows = [(i, said(i, tongue(i % 130), 60), f"l{i % 130:03}", "s", 1) for i in range(520)]
    model = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert len(model.languages) == 130
    asked = spark.createDataFrame([(1000 + k, said(1000 + k, tongue(k), 30), f"l{k:03}", "s", 1) for k in range(130)], SCHEMA)
    out = langid.predict(asked, model).collect()
    assert len(out) == 130 and all(r.lang_pred == r.lang and r.score > 0.5 for r in out)


def test_languages_with_one_and_five_labelled_rows_stay_in_the_stage(spark):
    learned = [r.id for r in spark.range(2000).filter(langid.in_training("id")).collect()]
    big, one, five = tongue(1, 400), tongue(2, 200), tongue(3, 200)
    rows = [(i, said(i, big, 300), "big", "s", 1) for i in learned[:200]]
    alone = learned[200]
    rows.append((alone, " ".join(one[:25]), "one", "s", 1))
    rows += [(i, " ".join(five[40 * k : 40 * k + 40]), "five", "s", 1) for k, i in enumerate(learned[201:206])]
    rows += [(5000 + i, said(i, five, 30), None, "s", 1) for i in range(10)] + [(6000, " ".join(reversed(one[:25])), None, "s", 1)]
    rows += [(7000, said(1, tongue(9), 50), None, "s", 1)]  # no learned language
    # a wrong label on one text doesn't take the language's n-grams away
    rows += [(learned[206], said(5, big, 30), "wrong", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {7000}
    model = langid.learn(docs.filter(langid.in_training()))
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert found[alone] == found[6000] == "one"
    assert all(found[i] == "five" for i in [*learned[201:206], *range(5000, 5010)])
    assert all(found[i] == "big" for i in learned[:200])


def test_winners_and_counts_equal_exact_sets(spark):
    """Plain sets of n-grams, learned and looked up without Spark and without filters."""
    from collections import Counter

    names = {f"l{k}": tongue(k, 120) + tongue(50, 30) for k in range(7)}  # 30 words are in every language
    rnd = random.Random(4)
    lang_of = [rnd.choice(sorted(names)) for _ in range(300)]
    rows = [(i, said(i, names[x], rnd.choice([1, 5, 60, 400])), x, "s", 1) for i, x in enumerate(lang_of)]
    rows += [(900, said(900, names["l1"], 80), None, "s", 1), (901, "", None, "s", 1), (902, None, None, "s", 1), (903, "12 34 !", None, "s", 1)]

    def grams_of(text):
        chars = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        four = [chars[i : i + langid.N] for i in range(len(chars) - langid.N + 1)]
        return [g for g in four if sum(c != " " for c in g) >= 2]

    counts = {x: Counter(g for r in rows if r[2] == x for g in grams_of(r[1])) for x in names}
    total = {x: sum(c.values()) for x, c in counts.items()}
    floor = min(langid.PRIOR, max(total.values()))
    most = Counter()
    for x, c in counts.items():
        for g, n in c.items():
            most[g] = max(most[g], n / max(total[x], floor))
    sets = {x: {g for g, n in c.items() if n / total[x] >= langid.SHARE * most[g]} for x, c in counts.items()}

    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    for doc_id, text, *_ in rows:
        asked = grams_of(text or "")
        if not asked:
            assert got[doc_id].lang_pred == langid.UNDETERMINED and got[doc_id].score == 0
            continue
        real = {x: sum(g in s for g in asked) for x, s in sets.items()}
        best = max(real.values())
        assert real[got[doc_id].lang_pred] == best  # of equal counts either is right here
        assert abs(got[doc_id].score - best / len(asked)) < 0.02


def test_a_text_within_a_row_is_predicted_without_a_second_copy(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, None), ("12", "en")] * 3)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    rows = docs.select(F.struct("*").alias("row"))
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    found = langid.predict(rows, model, "row.text")
    assert found.columns == ["row", "lang_pred", "score"]
    assert {r.row.doc_id: (r.lang_pred, r.score) for r in found.collect()} == want and want[2] == ("und", 0.0)
