"""Fill-in-the-middle: texts cut in three and put into prefix-suffix-middle order, and back.

A text is cut between units (a word with the white space before it; white space at the
end of a text is a unit of its own). The cuts are found by one scan over the bytes of a
block of texts. Each text is then a bytearray: the sentinels are inserted at the cuts, in
the order of the text, and the parts change places by a rotation in place, three
reversals (of the first block, of the second, and of both together) that go through
buffers of ``CHUNK`` bytes whatever the length of the text. The way back finds the
sentinels, rotates by the other amount and takes the sentinels out; it needs nothing but
the output and its form.

Forms: ``psm`` prefix, suffix, middle; ``spm`` suffix, prefix, middle; ``plain`` as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

CHUNK = 1 << 16
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Plan:
    """The three sentinels (none may begin with an end of one of them), shares of a hundred, and a seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 50
    spm_rate: int = 80
    seed: int = 42

    def __post_init__(self):
        marks = self.marks
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("three different sentinels are needed")
        for a in marks:
            for b in marks:
                if any(a.endswith(b[:k]) for k in range(1, len(b))) or (a != b and b in a):
                    raise ValueError("a sentinel must not begin with an end of one, or hold another")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Turns view[lo:hi] round in place."""
    while hi - lo > 1:
        n = min(CHUNK, (hi - lo) // 2)
        left = view[lo : lo + n].copy()
        view[lo : lo + n] = view[hi - n : hi][::-1]
        view[hi - n : hi] = left[::-1]
        lo, hi = lo + n, hi - n


def exchange(buffer: bytearray, lo: int, cut: int, hi: int) -> None:
    """The blocks [lo, cut) and [cut, hi) change places."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    reverse(view, lo, cut)
    reverse(view, cut, hi)
    reverse(view, lo, hi)


def transformed(text: bytes, first: int, second: int, form: str, plan: Plan) -> bytearray:
    """``text`` with its middle between the bytes ``first`` and ``second``, in the order of ``form``."""
    p, s, m = plan.marks
    out = bytearray(text)
    out[second:second] = s
    out[first:first] = m
    out[0:0] = p
    middle, suffix = len(p) + first, len(p) + len(m) + second
    exchange(out, middle if form == PSM else 0, suffix, len(out))
    return out


def restored(output: bytes, form: str, plan: Plan) -> bytearray:
    """The text that ``transformed`` had."""
    out = bytearray(output)
    if form == PLAIN:
        return out
    p, s, m = plan.marks
    if form == PSM:
        start, cut = out.index(s), out.index(m)
    else:
        start, cut = 0, out.index(p)
    exchange(out, start, cut, len(out))
    middle = out.index(m)
    suffix = out.index(s)
    del out[suffix : suffix + len(s)]
    del out[middle : middle + len(m)]
    del out[: len(p)]
    return out


class Cuts:
    """Units of a block of texts: their ends, from one scan over the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        from .text_words import NOT_SPACE

        inside = np.concatenate([NOT_SPACE[data], [False]])
        last = inside[:-1] & ~inside[1:]  # the last byte of a word
        full = offsets[1:] > offsets[:-1]
        last[offsets[1:][full] - 1] = True  # the end of a text ends a unit, words and white space alike
        self.ends = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.ends, offsets, side="right")
        self.count = np.diff(self.at)
        self.offsets = offsets

    def behind(self, row: int, units: int) -> int:
        """Bytes of the row's first ``units`` units."""
        return int(self.ends[self.at[row] + units - 1] - self.offsets[row]) if units else 0


def _characters(text: bytes, lo: int, hi: int) -> int:
    part = np.frombuffer(text, dtype=np.uint8, count=hi - lo, offset=lo) if hi > lo else np.empty(0, dtype=np.uint8)
    return int(((part & 0xC0) != 0x80).sum())


FOUND = "n long, form string, prefix_chars long, middle_chars long, output string"


def _apply(plan: Plan):
    @F.arrow_udf(FOUND)
    def apply(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        from .text_units import blocks, utf8

        draws = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (h1, h2, h3, h4)]
        data, offsets = utf8(text)
        n, form, before, within, out = [], [], [], [], []
        for lo, hi in blocks(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            block = data[offsets[lo] : offsets[hi]]
            cuts = Cuts(block, at)
            for i in range(hi - lo):
                own, units = block[at[i] : at[i + 1]].tobytes(), int(cuts.count[i])
                a, b, c, d = (int(x[lo + i]) for x in draws)
                n.append(units)
                if not own or c % 100 >= plan.rate or any(x in own for x in plan.marks):
                    kind, ends, result = PLAIN, (None, None), own
                else:
                    kind = SPM if d % 100 < plan.spm_rate else PSM
                    first, second = sorted(cuts.behind(i, x % (units + 1)) for x in (a, b))
                    ends = _characters(own, 0, first), _characters(own, first, second)
                    result = bytes(transformed(own, first, second, kind, plan))
                form.append(kind)
                before.append(ends[0])
                within.append(ends[1])
                out.append(result)
        columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(out, pa.large_binary()).cast(pa.large_string())]
        return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return apply


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of sha256("seed:doc_id") as numbers; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (code points; null if plain) and output.

    The cuts, the share of texts that is rearranged and the form follow from sha256 of
    "seed:doc_id" alone, so rows with one id are cut alike; a null doc_id counts as an
    empty one. A null or empty text, and a text that holds a sentinel, stays plain (a null
    one with an empty output). Texts of any length are worked on whole; repeated rows stay
    rows, no rows give no rows. Columns named like the new ones are replaced, others stay.
    """
    ship_package(docs.sparkSession)
    new = [x.split()[0] for x in FOUND.split(", ")]
    found = _apply(plan)(F.coalesce(F.col("text"), F.lit("")), *draws(F.col("doc_id"), plan.seed))
    both = docs.select(F.struct("*").alias("row"), found.alias("found"))
    return both.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[F.col("found")[c].alias(c) for c in new])


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text from output and form alone (null output: empty)."""
    ship_package(SparkSession.active())

    @F.arrow_udf("string")
    def back(output: pa.Array, form: pa.Array) -> pa.Array:
        kinds = form.to_pylist()
        texts = (x.as_py() for x in output.cast(pa.large_binary()))  # one after the other: no second copy of the batch
        return pa.array([bytes(restored(t or b"", k, plan)) for t, k in zip(texts, kinds, strict=True)], pa.large_binary()).cast(pa.large_string())

    return back(output, form)
