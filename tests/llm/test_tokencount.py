"""op4: the compiled transducers against the library."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from honorlens.llm import common, text_units, tokencount
from tests.llm.fixtures import awkward, frame

BYTE = common.tokenizer_path("byte_bpe_50k.json")
ALPHABET = ["'", "s", "t", "r", "e", "l", "v", "m", "d", "R", " ", "  ", "\n", "\t", "1", "½", "é", "é", "x", "!", "\u00a0", "\u3000", "<|endoftext|>", "<|end", "中", "ß", "-", "\x1c", "😀", "İ"]


def texts():
    rnd = random.Random(5)
    odd = ["", " ", "\n\n", "a  b", "a \n b", "it's 'tis 'll 're 'r 'rex 'v'e 'l", "'r", "a'v", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "-" * 300, "a" * 2500, " " * 700 + "x", None]
    odd += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 1500))) for _ in range(150)]
    return odd + ["".join(chr(rnd.choice([rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF), rnd.randint(32, 127)])) for _ in range(300)) for _ in range(100)]


@pytest.fixture(scope="module")
def spec():
    return tokencount.compiled(BYTE)


@pytest.mark.parametrize("chunk,states", [(512, 100_000), (3, 100_000), (17, 50)])
def test_counts_are_the_librarys(spec, monkeypatch, chunk, states):
    starts = tokencount.pretoken_starts
    monkeypatch.setattr(tokencount, "pretoken_starts", lambda kinds, rows: starts(kinds, rows, chunk))
    counter, tokenizer = tokencount.Counter(spec, states), Tokenizer.from_file(BYTE)
    rows = texts()
    data, offsets = text_units.utf8(pa.array(rows))
    got = counter.count(data, offsets).tolist()
    assert got == [len(tokenizer.encode(x or "", add_special_tokens=False).ids) for x in rows]
    assert counter.count(data, offsets).tolist() == got


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_encode_like_whole_texts(name):
    path = common.tokenizer_path(name)
    encoder, tokenizer = text_units.UnitEncoder(path, max_units=500), Tokenizer.from_file(path)
    rows = texts()
    data, offsets = text_units.utf8(pa.array(rows))
    for lo, hi in text_units.blocks(offsets, 20_000):
        ids, at = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for i in range(lo, hi):
            assert ids[at[i - lo] : at[i - lo + 1]].tolist() == tokenizer.encode(rows[i] or "", add_special_tokens=False).ids


def test_query_counts_every_row(spark):
    rows = awkward()
    tokenizer = Tokenizer.from_file(BYTE)
    out = tokencount.count_tokens(frame(spark, rows, extra=True), BYTE, 20).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in rows]
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert tokencount.count_tokens(frame(spark, rows).limit(0), BYTE).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokencount.compiled(common.tokenizer_path("word_bpe_49k.json"))
