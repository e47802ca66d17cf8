"""Searches through the trigram index equal full scans and read fewer rows."""

import random

import pytest
from pyspark.sql import functions as F

from honorlens.operators.search import text_match
from honorlens.operators.text_index import required_grams, required_runs, write_text_index

WORDS = ["energy", "peace", "Physik", "müller", "straße", "größe", "a.b", "c|d", "x(y)", "tail\\end", "日本語版", "😀😀😀", "line\nbreak", "A-1", "quantum"]
TERMS = ["energy", "ENERGY", "peace.*quantum", "phy[rs]ik", "qu[a-z]+tum", "(energy|peace) quantum", "energy|größe", "energies?", "energ(y|ies)",
         "a\\.b", "c\\|d", "x\\(y\\)", "日本語", "😀😀😀", "line.break", "line\nbreak", "qu.", "zz*peace", "peac{1,2}e", "(?i)straße", "\\bpeace\\b",
         "nothing like it", "", "[^a-z]peace", "[]a]bc", "peace$", "^müller", "\\x70eace", "ene?rgy", "p+eace", "(?:pe)?ace", "(?!x)peace", "tail\\\\end"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice("abc"), " ".join(rnd.choices(WORDS if i % 40 == 0 else [f"w{i % 40}word", "and", "the"], k=rnd.randint(0, 12)))) for i in range(2000)]
    rows += [(3000, "a", None), (3001, None, "peace"), (3002, None, None), (3003, "b", ""), (3004, "c", "x" * 4094 + "energy" + "y" * 9000 + "Quantum"),
             (3005, "a", "energy"), (3005, "a", "energy")]
    return spark.createDataFrame(rows, "id long, name string, motivation string")


@pytest.fixture(scope="module")
def index(texts):
    return write_text_index(texts.withColumn("part", F.col("id") % 40), ["name", "motivation"], ["part", "id"], file_rows=50)


@pytest.mark.parametrize("term", TERMS)
def test_a_search_equals_a_full_scan(texts, index, term):
    full = texts.filter(text_match(["name", "motivation"], term))
    assert sorted(r.id for r in index.search(term).collect()) == sorted(r.id for r in full.collect())


def test_literal_terms(texts, index):
    for term in ("a.b", "c|d", "x(y)", "(", "[a", "tail\\end", "\\"):
        full = texts.filter(text_match(["name", "motivation"], term, literal=True))
        assert sorted(r.id for r in index.search(term, literal=True).collect()) == sorted(r.id for r in full.collect())


def test_a_rare_term_reads_few_rows_and_a_missing_one_none(texts, index):
    total = index.files().agg(F.sum("n_rows")).first()[0]
    assert total == texts.count()

    def read(term):
        return index.candidates(term).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]

    assert read("w7word") <= total / 10
    assert read("nothing like it") == 0
    assert read("w7word|w8word") <= total / 5
    assert read("w[a-z]*") == total
    opened = index.search("w7word").inputFiles()
    assert len(opened) <= index.files().count() / 10


def test_runs_of_an_expression():
    assert required_runs("abc.*def|gh[i-k]lm") == [["abc", "def"], ["gh", "lm"]]
    assert required_runs("colou?r") == [["colo", "r"]]
    assert required_runs("ab+c") == [["ab", "c"]]
    assert required_runs("ab{0,2}c") == [["a", "c"]]
    assert required_runs("(abc|def)ghi") == [["ghi"]]
    assert required_runs("x[](|)]y") == [["x", "y"]]
    for unclear in ("(?x)a b", "\\x41bc", "\\p{l}bc", "\\qa.b\\e", "a)b", "(ab", "[ab", "ab\\"):
        assert required_runs(unclear) is None
    assert required_grams("abcd|xy") is None and required_grams("ABCD") == [{"abc", "bcd"}]


def test_an_empty_table_finds_nothing(spark):
    empty = spark.createDataFrame([], "id long, text string")
    index = write_text_index(empty, ["text"])
    assert index.search("abc").count() == 0 and index.search("a").count() == 0
