"""Columns of the input with the names that operators use, texts of many special strings, calls without a query."""

import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

from honorlens.llm import common, langid, linededup, text_units, tokencount
from tests.llm.fixtures import frame

NAMES = ["_drop", "_id", "_m", "_mark", "_kept", "_best", "row", "best", "id", "mark", "batch", "hashes", "goes", "own_id", "own_mark", "n", "kept", "h", "a", "b"]


@pytest.mark.parametrize("name", NAMES)
def test_no_column_name_clashes(spark, name):
    rows = [(i, f"common line\nown {i}") for i in range(6)] + [(9, None)]
    docs = frame(spark, rows).withColumnRenamed("n_chars", name).limit(7)
    if name in ("_drop", "_id", "_mark", "row", "n", "goes", "mark"):  # line dedup is many jobs: some of its names at a time
        out = linededup.drop_frequent_lines(docs, 3, batches=1)
        assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
        assert {(r.doc_id, r[name], r.kept_text) for r in out.collect()} == {(i, len(t), f"own {i}") if t else (i, None, "") for i, t in rows}
    model = langid.Model(["en"], np.zeros((1, 64), dtype=np.uint64))
    out = langid.predict(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score"] and {r[name] for r in out.collect()} == {len(t) if t else None for _, t in rows}


def test_many_special_strings_take_their_time_in_proportion():
    path = common.tokenizer_path("byte_bpe_50k.json")
    counter = tokencount.Counter(tokencount.compiled(path))
    took = {}
    for n in (2000, 40_000):
        data, offsets = text_units.utf8(pa.array(["<|endoftext|>" * n, "a <|endoftext|>b"]))
        start = time.perf_counter()
        assert counter.count(data, offsets).tolist()[0] == n
        took[n] = time.perf_counter() - start
    assert took[40_000] < 5  # each against all earlier ones took over twenty


def test_operators_can_be_called_from_any_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from honorlens.session import local_session\n"
        "from honorlens.llm import common, partenum, sketch, tokencount\n"
        "spark = local_session(2)\n"
        "docs = spark.createDataFrame([(1, 'a b c d e f g'), (2, 'A b c d e f g')], 'doc_id long, text string')\n"
        "assert {r.n_tokens for r in tokencount.count_tokens(docs, common.tokenizer_path('byte_bpe_50k.json')).collect()} == {7}\n"
        "assert {r.component_id for r in partenum.near_duplicates(docs).collect()} == {1}\n"
    )
    import honorlens

    root = honorlens.__path__[0].rsplit("/", 1)[0]
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
