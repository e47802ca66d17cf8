"""Language ID with bit-sliced Bloom filters over character n-grams.

Every language has a Bloom filter of its n-grams; the filters are stored crosswise: slot s
holds a mask with a bit for each language, in as many 64-bit words as that takes. One
lookup ANDs the masks of an n-gram's slots and has all languages that contain it. A text's hits are counted by language
(popcounts over its n-grams) and corrected for false positives: a filter with the share f
of its bits set answers yes by chance with p = f^hashes, so of n n-grams
(hits - n p) / (1 - p) are expected to be really there. The largest corrected count
decides; its share of the n-grams is the score.

Learning counts n-grams in Spark over a bounded sample of labelled rows and gives an
n-gram to the languages in which it is not much rarer than where it is most frequent.
The model has ``SLOTS`` masks whatever the corpus (16 MiB for every 64 languages); every whole text is then predicted
where it is read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
N = 4
#: Labelled rows of each language that a model learns from, about (chosen by a hash of the id).
SAMPLE_ROWS = 3000
SLOTS, HASHES = 1 << 21, 3
#: An n-gram belongs to the languages where its frequency is at least this share of its highest.
SHARE = 0.2
#: Frequencies that others are measured by are taken as if a language had been learned from so many n-grams at least.
PRIOR = 1 << 16
WORD = 64
#: Bytes of text that are predicted at a time; a hundred times as many are held meanwhile.
PREDICT_BYTES = 1 << 18
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]  # most learned first
    masks: np.ndarray  # by word and slot, bit i % WORD of word i // WORD for languages[i]

    def chance(self) -> np.ndarray:
        """By language: how often its filter says yes to an n-gram it lacks."""
        fill = [float(np.mean((self.masks[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1))) for i in range(len(self.languages))]
        return np.array(fill) ** HASHES


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xF0000)]:
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all rows, the n + 1 offsets of the rows in them, and the letters by row.

    Letters are lower-cased, anything else counts as one space, as do both ends of a text;
    an n-gram has two letters at least.
    """
    from .text_units import mix

    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # in characters
    chars = np.insert(_letters()[points], np.repeat(begins, 2)[1:-1], 0).astype(np.uint64)  # one before and one behind every text
    at = begins + 2 * np.arange(n + 1)
    count = np.concatenate([[0], np.cumsum(chars > 0)])
    letters = count[at[1:]] - count[at[:-1]]
    if len(chars) < N:
        return np.empty(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64), letters
    width = len(chars) - N + 1
    key = np.zeros(width, dtype=np.uint64)
    for i in range(N):
        key = key * np.uint64(0x9E3779B97F4A7C15) + chars[i : i + width]
    use = (count[N:] - count[:-N]) >= 2
    for i in range(1, N):  # windows over the end of a text
        over = at[1:-1] - i
        use[over[(over >= 0) & (over < width)]] = False
    kept = np.concatenate([[0], np.cumsum(use)])
    return mix(key[use]), kept[np.minimum(at, width)], letters


def slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots of each n-gram."""
    a, b = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64) for i in range(HASHES)]


def in_training(doc_id: str = "doc_id"):
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1 (and the id isn't null)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, size: int = SLOTS) -> Model:
    """A model from ``rows`` (doc_id, text, lang); rows without text or language don't count.

    Of each language about ``sample_rows`` rows are used (all, if there are no more), with
    their whole texts. No usable row gives a model without languages. Every n-gram of the
    sample counts, however often it occurs and however much was learned of its language.
    """
    ship_package(rows.sparkSession)
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    n_words = max(1, -(-len(languages) // WORD))
    masks = np.zeros((n_words, size), dtype=np.uint64)
    if not languages:
        return Model([], masks)
    number = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, sample_rows / sizes[lang])])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < share[F.col("lang")]).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text_units import blocks, utf8

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for lo, hi in blocks(offsets):
                keys, at, _ = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                of = np.repeat(lang[lo:hi], np.diff(at))
                for i in np.unique(of).tolist():
                    found, n = np.unique(keys[of == i], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(found), i, dtype=np.int32)), "gram": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = sample.mapInArrow(counted, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    floor = min(PRIOR, max(total.values(), default=1))  # a small sample doesn't make its n-grams frequent
    by_lang = lambda f: F.create_map(*[F.lit(x) for i, n in total.items() for x in (i, f(n))] or [F.lit(0), F.lit(f(1))])[F.col("lang")]
    rated = counts.select("gram", "lang", (F.col("n") * by_lang(lambda n: 1.0 / n)).alias("f"), (F.col("n") * by_lang(lambda n: 1.0 / max(n, floor))).alias("sure"))
    most = rated.groupBy("gram").agg(F.collect_list(F.struct("lang", "f")).alias("x"), F.max("sure").alias("m"))  # a row a language
    none = F.lit(0).cast("long")

    def mask(word):
        mine = lambda x: (x.f >= F.col("m") * SHARE) & (F.floor(x.lang / WORD) == word)
        return F.aggregate("x", none, lambda s, x: s.bitwiseOR(F.when(mine(x), F.call_function("shiftleft", F.lit(1).cast("long"), x.lang % WORD)).otherwise(none)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, word, bits = batch.column("gram").to_numpy().view(np.uint64), batch.column("word"), batch.column("mask")
            for at in slots(keys, size):
                yield pa.RecordBatch.from_pydict({"word": word, "slot": pa.array(at), "mask": bits})

    held = most.select("gram", F.posexplode(F.array(*[mask(w) for w in range(n_words)])).alias("word", "mask")).filter("mask != 0")
    filled = held.mapInArrow(dealt, "word int, slot long, mask long")
    for r in filled.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toLocalIterator():  # at most SLOTS rows a word
        masks[r["word"], r["slot"]] = np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
    return Model(languages, masks)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the column ``text`` alone (columns of these names are replaced).

    ``und`` with score 0 for a null text, one without a letter, or a model without languages.
    A text whose n-grams no filter knows gets the language learned from most, score 0; of
    equal counts the language learned from more rows wins. Rows and other columns stay.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks.astype(_smallest(len(model.languages))), model.chance()))

    @F.arrow_udf("lang string, score double")
    def best(text: pa.Array) -> pa.Array:
        from .text_units import blocks, utf8

        languages, masks, chance = sent.value
        data, offsets = utf8(text)
        n = len(text)
        names, score = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
        for lo, hi in blocks(offsets, PREDICT_BYTES) if languages else ():
            keys, at, letters = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            places = slots(keys, masks.shape[1])
            total = np.diff(at)
            real = np.empty((len(languages), hi - lo))
            for i in range(len(languages)):
                if i % WORD == 0:
                    word = masks[i // WORD]
                    found = word[places[0]]
                    for where in places[1:]:
                        found &= word[where]
                hits = np.concatenate([[0], np.cumsum((found >> masks.dtype.type(i % WORD)) & masks.dtype.type(1), dtype=np.int64)])
                real[i] = np.maximum(0, (hits[at[1:]] - hits[at[:-1]] - total * chance[i]) / max(1e-9, 1 - chance[i]))
            win = real.argmax(axis=0)
            sure = letters > 0
            names[lo:hi][sure] = np.array(languages, dtype=object)[win[sure]]
            score[lo:hi][sure] = np.minimum(1, real.max(axis=0)[sure] / np.maximum(1, total[sure]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang", "score"])

    out = docs.select(F.struct("*").alias("row"), best(text).alias("best"))  # a struct: no column can clash
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return out.select(*own, F.col("best.lang").alias("lang_pred"), F.col("best.score").alias("score"))


def _smallest(languages: int) -> type:
    return next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(languages, WORD) <= bits)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learns from the labelled rows that aren't held out, predicts every row: doc_id, held_out, lang_pred, score."""
    model = learn(docs.filter(in_training()), sample_rows)
    out = predict(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
