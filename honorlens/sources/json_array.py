"""One huge JSON document, its record array read by many tasks.

A ``multiLine`` read gives a whole file to one task. Here a file is cut into byte ranges, and
each range learns from the ones before it where it begins: inside a string or not, and how deep.

1. Every range is scanned alone, for both answers to "does it begin inside a string?": the
   parity of its quotes, and by how much the nesting changes. A quote counts unless an odd
   number of backslashes stands before it, which the bytes in front of the range tell.
2. Running totals over the ranges of a file (a row each) turn that into the state at the
   beginning of each range.
3. Ranges that reach the top level name the place of the record array.
4. Each range hands out the array's elements that begin in it, reading on past its end to
   finish the last one. Elements are parsed by Spark's ``from_json``.

The bytes are read twice, both times in parallel; a file is never held by one task.

A file may be packed in blocks, as Spark writes it with the compression "snappy". Places and
ranges are those of its text, and a range unpacks only the blocks that it lies in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised, ship_package

RANGE_BYTES = 32 << 20
#: Bytes that a task holds at a time, and bytes before an array in which its name must end.
PIECE, NAME_REACH = 1 << 22, 1 << 16
#: Stands for a slice that isn't text or where an element is missing: no parser takes it for elements.
NO_ELEMENT = ","
#: How the name of a packed file ends: Hadoop's block format, of chunks that are packed each by itself.
PACKED = ".snappy"
_STEP = np.zeros(256, dtype=np.int8)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1  # [ { and ] }


@lru_cache(maxsize=256)
def _chunks(path: str, size: int, changed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a packed file: where in its text each chunk begins, and the text ends; where in the file each chunk begins, and ends.

    A block is the length of its text (4 bytes, the highest first) and chunks until that text is
    complete; a chunk is its packed length and as many bytes, which say first how long their text is.
    """
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    text, begin, end, at = [0], [], [], 0
    with store.open_input_stream(place, compression=None, buffer_size=PIECE) as stream:

        def take(n: int) -> bytes:
            nonlocal at
            data = stream.read(n)
            at += n
            if len(data) < n:
                raise ValueError(f"{path} ends within a block")
            return data

        while at < size:
            rest = int.from_bytes(take(4))
            while rest:
                packed = int.from_bytes(take(4))
                begin.append(at)
                data = take(packed)
                end.append(at)
                digits = next((i + 1 for i, x in enumerate(data[:5]) if x < 128), 0)
                n = sum((x & 127) << 7 * i for i, x in enumerate(data[:digits]))
                if not 0 < n <= rest:
                    raise ValueError(f"{path} isn't in blocks of snappy")
                text.append(text[-1] + n)
                rest -= n
    return np.array(text, dtype=np.int64), np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64)


class Ranges:
    """Reads parts of a file of any store that pyarrow knows; of a packed file, parts of its text."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        self.size = self.file.size()
        self.chunks = None
        if path.endswith(PACKED):
            self.chunks = _chunks(path, self.size, store.get_file_info(place).mtime_ns or 0)
            self.size = int(self.chunks[0][-1])

    def bytes(self, lo: int, hi: int) -> bytes:
        lo, hi = max(0, lo), min(hi, self.size)
        if hi <= lo:
            return b""
        if self.chunks is None:
            return self.file.read_at(hi - lo, lo)
        text, begin, end = self.chunks
        first, last = (int(np.searchsorted(text, x, "right")) - 1 for x in (lo, hi - 1))
        base, codec = int(begin[first]), pa.Codec("snappy")
        data = memoryview(self.file.read_at(int(end[last]) - base, base))
        parts = [codec.decompress(data[begin[k] - base : end[k] - base], int(text[k + 1] - text[k]), asbytes=True) for k in range(first, last + 1)]
        return b"".join(parts)[lo - int(text[first]) : hi - int(text[first])]

    def backslashes(self, at: int) -> int:
        """How many backslashes end at the byte ``at``."""
        run, step = 0, 64
        while at:
            piece = self.bytes(at - step, at)
            own = len(piece) - len(piece.rstrip(b"\\"))
            run += own
            if own < len(piece):
                break
            at, step = at - len(piece), 2 * step
        return run

    def quotes(self, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(position, bytes, which are quotes that open or close a string) of [lo, hi), piece by piece."""
        while lo < min(hi, self.size):
            data = np.frombuffer(self.bytes(lo, min(hi, lo + PIECE)), dtype=np.uint8)
            quote, back = data == 34, data == 92
            before = self.backslashes(lo)
            if before or back.any():
                place = np.arange(len(data), dtype=np.int64)
                plain = np.maximum.accumulate(np.where(back, -1 - before, place))  # the last byte that is no backslash
                quote &= np.concatenate([[before], place - plain])[:-1] % 2 == 0
            yield lo, data, quote
            lo += len(data)

    def nested(self, lo: int, hi: int, inside: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(position, bytes, which are outside of strings, nesting behind each) of [lo, hi), from the state at ``lo``."""
        for at, data, quote in self.quotes(lo, hi):
            within = (np.cumsum(quote) + inside) & 1
            outside = (within == 0) & ~quote
            nesting = depth + np.cumsum(_STEP[data] * outside, dtype=np.int64)
            inside, depth = int(within[-1]), int(nesting[-1])
            yield at, data, outside, nesting


def _scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By range: parity of its quotes, and for both states at its start change and lowest point of the nesting."""
    for frame in frames:
        out = []
        for r in frame.itertuples():
            odd, depth, least = 0, [0, 0], [0, 0]
            for _, data, quote in Ranges(r.file).quotes(r.lo, r.hi):
                within = (np.cumsum(quote) + odd) & 1
                odd = int(within[-1])
                for inside in (0, 1):
                    nesting = depth[inside] + np.cumsum(_STEP[data] * ((within == inside) & ~quote), dtype=np.int64)
                    depth[inside], least[inside] = int(nesting[-1]), min(least[inside], int(nesting.min()))
            out.append((r.file, r.lo, r.hi, odd, *depth, *least))
        yield pd.DataFrame(out, columns=["file", "lo", "hi", "odd", "up0", "up1", "least0", "least1"])


def _array_ends(field: str | None, top: int):
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                source = Ranges(r.file)
                for at, data, outside, nesting in source.nested(r.lo, r.hi, r.inside, r.depth):
                    for i in np.flatnonzero(outside & (data == 91) & (nesting == top)):
                        if field is None or _named(source.bytes(at + int(i) - NAME_REACH, at + int(i)), field):
                            out.append((r.file, at + int(i), True))
                    out += [(r.file, at + int(i), False) for i in np.flatnonzero(outside & (data == 93) & (nesting == top - 1))]
            yield pd.DataFrame(out, columns=["file", "at", "opens"])

    return found


def _named(before: bytes, field: str) -> bool:
    """Whether a key of this name ends the bytes."""
    key = re.search(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', before)
    return bool(key) and json.loads(key[1]) == field


def _elements(top: int):
    def rows(file: str, values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": pa.array([file] * len(values), pa.string()), "value": pa.array(values, pa.string())})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pandas().itertuples():
                source, out, size, open_part = Ranges(r.file), [], 0, None
                for at, data, outside, nesting in source.nested(r.lo, r.close + 1, r.inside, r.depth):
                    mark = outside & (((data == 44) & (nesting == top)) | ((data == 91) & (nesting == top)) | ((data == 93) & (nesting == top - 1)))
                    places = at + np.flatnonzero(mark)
                    start = at
                    for k in places[(places >= r.open) & (places <= r.close)].tolist():
                        if open_part is not None:
                            open_part.append(data[start - at : k - at].tobytes())
                            value = b"".join(open_part).decode("utf-8")
                            if value.strip():
                                out.append(value)
                                size += len(value)
                        start = k + 1
                        open_part = [] if r.lo <= k < r.hi and k < r.close else None
                        if size > PIECE:
                            yield rows(r.file, out)
                            out, size = [], 0
                    if open_part is not None:
                        open_part.append(data[start - at :].tobytes())
                    elif at + len(data) >= r.hi:
                        break
                yield rows(r.file, out)

    return found


def _text(data: bytes) -> str | None:
    """``data`` as text; None if it isn't UTF-8."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _outlines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By file: its text without what lies between the array's brackets (``open`` is -1 if it has no array)."""
    for frame in frames:
        out = []
        for r in frame.itertuples():
            source = Ranges(r.file)
            ends = [(0, source.size)] if r.open < 0 else [(0, r.open + 1), (r.close, source.size)]
            out.append((r.file, _text(b"".join(source.bytes(*x) for x in ends).removeprefix(b"\xef\xbb\xbf"))))
        yield pd.DataFrame(out, columns=["file", "outline"])


def _slices(top: int, keep: list[str]):
    """Runs of whole elements, one a piece that is read; the last of a range ends where its last element does."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kept = {k: pa.array([r[k]], batch.schema.field(k).type) for k in keep}
                source, lo, hi, opened, closed = Ranges(r["file"]), r["lo"], r["hi"], r["open"], r["close"]
                if opened < 0:
                    yield pa.RecordBatch.from_pydict(kept | {"slice": pa.array([None], pa.string())})
                    continue
                begun, parts = None, []
                for at, data, outside, nesting in source.nested(lo, closed + 1, r["inside"], r["depth"]):
                    mark = outside & (((data == 44) & (nesting == top)) | ((data == 91) & (nesting == top)) | ((data == 93) & (nesting == top - 1)))
                    places = at + np.flatnonzero(mark)
                    places = places[(places >= opened) & (places <= closed)]
                    own, later = places[places < hi], places[places >= hi]
                    start = at
                    for k in sorted({int(x) for x in (*own[:1], *own[-1:], *later[:1])}):
                        if begun is not None:
                            text = _text(b"".join([*parts, data[start - at : k - at].tobytes()]))
                            if text is None or (not text.strip() and (begun, k) != (opened, closed)):
                                text = NO_ELEMENT
                            yield pa.RecordBatch.from_pydict(kept | {"slice": pa.array([text], pa.string())})
                        start = k + 1
                        begun, parts = (k if k < min(hi, closed) else None), []
                    if begun is not None:
                        parts.append(data[start - at :].tobytes())
                    elif at + len(data) >= hi:
                        break

    return found


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, size of the files at ``path`` (a file, a folder or a pattern)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size"))


def _text_sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"file": frame["file"], "size": [Ranges(x).size for x in frame["file"]]})


def _unpacked(files: DataFrame) -> DataFrame:
    """``files`` (file, size), the size of the packed ones being that of their text."""
    packed = files.filter(F.col("file").endswith(PACKED)).select("file", "size")
    if packed.isEmpty():
        return files
    sizes = materialised(_spread(packed).mapInPandas(_text_sizes, "file string, size long"))
    return files.select("file", "size").filter(~F.col("file").endswith(PACKED)).unionByName(sizes)


def _states(files: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """The ranges of ``files`` (file, size) with the state at their beginning, and how many there are.

    ``low`` is the least nesting in a range; ``broken`` says of a file that its strings or nesting don't end.
    """
    ship_package(files.sparkSession)
    files = _unpacked(files)
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("file", "size", cuts.alias("lo")).withColumn("hi", F.least(F.col("lo") + range_bytes, "size"))
    n = max(1, ranges.count())  # a task a range: the rows are few, so Spark would merge them into one task by itself
    scanned = ranges.select("file", "lo", "hi").repartition(n).mapInPandas(_scanned, "file string, lo long, hi long, odd int, up0 long, up1 long, least0 long, least1 long")
    before = Window.partitionBy("file").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    known = materialised(scanned).withColumn("inside", inside.cast("int")).withColumn("up", F.when(F.col("inside") == 1, F.col("up1")).otherwise(F.col("up0")))
    known = known.withColumn("depth", F.coalesce(F.sum("up").over(before), F.lit(0)))
    least = F.col("depth") + F.when(F.col("inside") == 1, F.col("least1")).otherwise(F.col("least0"))
    whole = Window.partitionBy("file")
    broken = (F.sum("odd").over(whole) % 2 != 0) | (F.sum("up").over(whole) != 0) | (F.min(least).over(whole) < 0)
    return known.select("file", "lo", "hi", "inside", "depth", least.alias("low"), broken.alias("broken")), n


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to a task a row: they are few, so Spark would merge them into one task by itself."""
    return rows.repartition(max(1, rows.count()))


def _arrays(states: DataFrame, field: str | None, top: int) -> DataFrame:
    """file, open, close: where the array of a file begins and ends."""
    near = states.filter(F.col("low") < top).select("file", "lo", "hi", "inside", "depth")
    ends = _spread(near).mapInPandas(_array_ends(field, top), "file string, at long, opens boolean")
    ends = materialised(ends)
    opened = ends.filter("opens").groupBy("file").agg(F.min("at").alias("open"))
    return ends.filter("NOT opens").join(opened, "file").filter("at > open").groupBy("file", "open").agg(F.min("at").alias("close"))


def array_elements(spark: SparkSession, path: str, field: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, value (JSON text) of each element of the array under the top-level key ``field`` of each document.

    Without ``field`` the document itself is the array. A file holds one document of UTF-8
    JSON, of any layout; elements of any kind come out as they are written. Documents
    without the key or with an empty array give no rows; of a repeated key the first array
    counts. A file whose strings or nesting don't end fails the read.
    """
    top = 2 if field is not None else 1
    states, n = _states(_files(spark, path), range_bytes)
    checked = states.withColumn("depth", F.when(~F.col("broken"), F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("not one whole JSON document: "), F.col("file")))))
    states = materialised(checked)
    todo = states.join(_arrays(states, field, top), "file").filter((F.col("hi") > F.col("open")) & (F.col("lo") <= F.col("close")))
    todo = todo.select("file", "lo", "hi", "inside", "depth", "open", "close").repartition(n)
    return todo.mapInArrow(_elements(top), "file string, value string")


def split_documents(files: DataFrame, field: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The documents of ``files`` (file, size) as outlines (file, outline) and ranges for ``array_slices``.

    An outline is the text of a document whose array under the top-level key ``field`` is emptied; null if
    the document's strings or nesting don't end (such a file has no ranges) or it isn't UTF-8. Nothing is
    said yet of what is between the array's brackets.
    """
    states = materialised(_states(files, range_bytes)[0])
    whole = states.filter("NOT broken")
    placed = whole.join(_arrays(whole, field, 2), "file", "left").fillna(-1, ["open", "close"])
    todo = placed.filter("IF(open < 0, lo = 0, hi > open AND lo <= close)").select("file", "lo", "hi", "inside", "depth", "open", "close")
    todo = materialised(todo)
    ends = todo.groupBy("file").agg(F.min("open").alias("open"), F.min("close").alias("close"))
    found = _spread(ends).mapInPandas(_outlines, "file string, outline string")
    return files.select("file").join(found, "file", "left"), todo


def array_slices(ranges: DataFrame, keep: Sequence[str] = ("file",)) -> DataFrame:
    """The columns in ``keep`` and a slice: the text of some elements that follow each other, with their commas.

    ``ranges`` are those of ``split_documents``, with further columns or fewer files. A slice is about as long
    as ``PIECE``, or one element. In ``[`` and ``]`` each slice of a well-formed array is one, and of one
    that isn't at least one slice isn't. A document without the array has one row, whose slice is null.
    """
    fields = [f"{k} {ranges.schema[k].dataType.simpleString()}" for k in keep]
    return _spread(ranges).mapInArrow(_slices(2, list(keep)), ", ".join([*fields, "slice string"]))


def read_array(spark: SparkSession, path: str, schema: T.StructType, field: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements of ``array_elements`` parsed with ``schema``, a column a field."""
    return array_elements(spark, path, field, range_bytes).select(F.from_json("value", schema).alias("r")).select("r.*")
