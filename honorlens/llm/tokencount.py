"""Token counts without tokenizing: a byte-level BPE vocabulary compiled to transducers.

Two deterministic machines replace the tokenizer, and both write their result on the
transitions:

* ``SPLITTER`` reads classes of characters and marks where a pre-token begins (one
  character late where the pattern looks ahead). Long texts are cut into chunks; each
  chunk is run from every state until the runs agree, which gives its *state map*; maps
  compose, so a parallel prefix scan over them gives every chunk's first state, and
  then all chunks are run at once.
* ``MergeMachine`` reads the bytes of a pre-token and emits how many tokens more (or
  fewer) the encoding of the prefix has. An encoding is right exactly when each of its
  neighbouring tokens stays apart under the merges, so the machine keeps, for every
  suffix read that may still grow into a token, the token before it; the set of these is
  a state. States are made when they are first reached and kept in a table of bounded
  size that starts afresh when full.

Everything is a table lookup over arrays: one step moves all chunks, or all pre-tokens
of a block, by one character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
CHUNK = 512
#: States of the merge machine that a worker keeps.
MAX_STATES = 100_000

# classes of characters; the letters of the contractions have their own
SPACE, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE, SHORT, L_R, L_E, L_V, L_L, NONE = range(12)
LETTERS = (LETTER, SHORT, L_R, L_E, L_V, L_L)
# states of the splitter
START, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, IN_LETTERS, IN_NUMBERS, IN_OTHER, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORTENED = range(13)
CUT_HERE, CUT_BEFORE = 1, 2  # a pre-token begins at this character; at the one before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cuts, by state * 12 + class, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ."""
    go, cut = np.zeros((13, 12), dtype=np.int64), np.zeros((13, 12), dtype=np.uint8)

    def set_(state: int, kinds, to: int, cuts: int) -> None:
        go[state, list(kinds)], cut[state, list(kinds)] = to, cuts

    def fresh(state: int, more: int = 0) -> None:
        """A pre-token begins at whatever comes."""
        set_(state, (SPACE,), ONE_SPACE, CUT_HERE | more)
        set_(state, (WHITE,), ONE_WHITE, CUT_HERE | more)
        set_(state, LETTERS, IN_LETTERS, CUT_HERE | more)
        set_(state, (NUMBER,), IN_NUMBERS, CUT_HERE | more)
        set_(state, (OTHER,), IN_OTHER, CUT_HERE | more)
        set_(state, (APOSTROPHE,), QUOTE, CUT_HERE | more)

    for state in range(13):
        fresh(state)
    set_(IN_LETTERS, LETTERS, IN_LETTERS, 0)
    set_(IN_NUMBERS, (NUMBER,), IN_NUMBERS, 0)
    set_(IN_OTHER, (OTHER, APOSTROPHE), IN_OTHER, 0)
    for state, spaced, more in ((ONE_SPACE, True, 0), (ONE_WHITE, False, 0), (MORE_SPACE, True, CUT_BEFORE), (MORE_WHITE, False, CUT_BEFORE)):
        fresh(state, more)
        if spaced:  # one space goes with what follows, and then no contraction begins
            set_(state, LETTERS, IN_LETTERS, more)
            set_(state, (NUMBER,), IN_NUMBERS, more)
            set_(state, (OTHER, APOSTROPHE), IN_OTHER, more)
        set_(state, (SPACE,), MORE_SPACE, 0)
        set_(state, (WHITE,), MORE_WHITE, 0)
    set_(QUOTE, (OTHER, APOSTROPHE), IN_OTHER, 0)
    set_(QUOTE, (SHORT,), SHORTENED, 0)
    for letter, state, last in ((L_R, QUOTE_R, L_E), (L_V, QUOTE_V, L_E), (L_L, QUOTE_L, L_L)):
        set_(QUOTE, (letter,), state, 0)
        fresh(state, CUT_BEFORE)  # it was the letter of a word after all
        set_(state, LETTERS, IN_LETTERS, CUT_BEFORE)
        set_(state, (last,), SHORTENED, 0)
    go[:, NONE], cut[:, NONE] = np.arange(13), 0
    return go.ravel(), cut.ravel()


SPLITTER, CUTS = _splitter()


@lru_cache(maxsize=4)
def compiled(path: str) -> dict:
    """What the machines need of a vocabulary file: tokens as bytes, merges, added tokens, and the
    classes of characters as runs (asked of the file's own pre-tokenizer, so that both know the same letters)."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # how the file writes bytes: these as they are,
    hidden = [b for b in range(256) if b not in shown]  # the others from U+0100 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    as_bytes = lambda s: bytes(byte[c] for c in s)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = np.array([*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)])  # the rest is unassigned or private
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for lo in range(0, len(points), 8192):
        some = points[lo : lo + 8192]
        joined = {}
        for kind, mark in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            pieces = split("".join(f"{mark}{chr(c)}\n" for c in some.tolist()))
            joined[kind] = np.isin(3 * np.arange(len(some)) + 1, [p[1][0] for p in pieces], invert=True)
        kinds[some] = np.select([joined[LETTER], joined[NUMBER], joined[OTHER]], [LETTER, NUMBER, OTHER], WHITE)
    kinds[[32, 39]] = SPACE, APOSTROPHE
    for letters, kind in (("stmd", SHORT), ("r", L_R), ("e", L_E), ("v", L_V), ("l", L_L)):
        kinds[[ord(c) for c in letters]] = kind
    at = np.flatnonzero(np.diff(kinds, prepend=255))
    return {
        "merges": [(as_bytes(a), as_bytes(b)) for a, b in merges],
        "added": sorted(added, key=len, reverse=True),
        "kind_at": at,
        "kinds": kinds[at],
    }


class MergeMachine:
    """Lazily determinised transducer from the bytes of a pre-token to changes of its token count."""

    def __init__(self, merges: list[tuple[bytes, bytes]], max_states: int = MAX_STATES):
        self.max_states = max_states
        number = {bytes([b]): b for b in range(256)}  # tokens in the order in which merges make them
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in number:
                raise ValueError("a token has two merges")
            number[a + b] = len(self.parts)
            self.merged[number[a], number[b]] = len(self.parts)
            self.parts.append((number[a], number[b]))
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for word, n in number.items():
            node = 0
            for b in word:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = n
        self._clear()

    def _clear(self) -> None:
        self._apart: dict[tuple[int, int], bool] = {}
        self.states = [((-1, 0, 0),)]  # suffixes that may grow: (token before, node of the suffix, count there against now)
        self.known = {self.states[0]: 0}
        self.column = np.full(256, -1, dtype=np.int64)
        self.width, self.used = 16, 0
        self.table = np.full((1024, self.width), -1, dtype=np.int32)

    def apart(self, a: int, b: int) -> bool:
        """Do the merges keep tokens a and b apart where they stand side by side?

        Merges are undone from the latest on, on either side of the border; they would join
        if what meets there at some time has a merge that comes before those undone.
        """
        if a < 0:
            return True
        found = self._apart.get((a, b))
        if found is None:
            left, right, due = a, b, len(self.parts) + 1
            while True:
                joint = self.merged.get((left, right))
                if joint is not None and joint < due:
                    found = False
                    break
                undo_left = self.parts[left] is not None and (self.parts[right] is None or left > right)
                if undo_left:
                    due, left = left, self.parts[left][1]
                elif self.parts[right] is not None:
                    due, right = right + 1, self.parts[right][0]
                else:
                    found = True
                    break
            self._apart[a, b] = found
        return found

    def _step(self, state: int, byte: int) -> int:
        """Next state * 256 + change of the count + 128."""
        alive, token, change = [], -1, 0
        for before, node, ago in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            alive.append((before, to, ago))
            n = self.token[to]
            if n >= 0 and self.apart(before, n):
                token, change = n, ago + 1
        key = (*((before, node, ago - change) for before, node, ago in alive if self.child[node]), (token, 0, 0))
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
        return to * 256 + change + 128

    def _fill(self, asked: np.ndarray) -> None:
        for code in asked.tolist():
            state, byte = code >> 8, code & 255
            value = self._step(state, byte)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            column = self.column[byte]
            if column < 0:
                column = self.column[byte] = self.used
                self.used += 1
                if self.used > self.width:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                    self.width *= 2
            self.table[state, column] = value

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[start : start + length]."""
        if len(self.states) > self.max_states:
            self._clear()
        order = np.argsort(-lengths, kind="stable")
        start, size = starts[order], lengths[order]
        state, count = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        running = len(order) - np.searchsorted(np.sort(lengths), np.arange(int(size[0]) if len(size) else 0), "right")
        for i, n in enumerate(running.tolist()):
            now, byte = state[:n], data[start[:n] + i]
            column = self.column[byte]
            value = self.table[now, column].astype(np.int64)
            miss = np.flatnonzero((column < 0) | (value < 0))
            if len(miss):
                self._fill(np.unique(now[miss] * 256 + byte[miss]))
                value[miss] = self.table[now[miss], self.column[byte[miss]]]
            state[:n] = value >> 8
            count[:n] += (value & 255) - 128
        out = np.empty_like(count)
        out[order] = count
        return out


def pretoken_starts(kinds: np.ndarray, rows: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which pre-tokens begin. ``kinds``: classes of the characters of all rows, ``rows``: n + 1 offsets."""
    size = np.diff(rows)
    rows, size = rows[:-1][size > 0], size[size > 0]
    if not len(rows):
        return np.empty(0, dtype=np.int64)
    parts = -(-size // chunk)
    row = np.repeat(np.arange(len(rows)), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = rows[row] + nth * chunk
    length = np.minimum(chunk, size[row] - nth * chunk)
    order = np.argsort(-length, kind="stable")  # chunks that are still running are a prefix
    begin, length, back = begin[order], length[order], np.argsort(order)
    running = (len(length) - np.searchsorted(np.sort(length), np.arange(int(length[0])), "right")).tolist()

    # state maps: from every state at once until they agree, then in one lane
    maps = np.tile(np.arange(13), (len(begin), 1))
    agreed = np.zeros(len(begin), dtype=bool)
    one = np.zeros(len(begin), dtype=np.int64)
    for i, n in enumerate(running):
        kind = kinds[begin[:n] + i].astype(np.int64)
        single = agreed[:n]
        if single.all():
            one[:n] = SPLITTER[one[:n] * 12 + kind]
            continue
        one[:n] = np.where(single, SPLITTER[one[:n] * 12 + kind], 0)
        open_ = np.flatnonzero(~single)
        moved = SPLITTER[maps[open_] * 12 + kind[open_, None]]
        maps[open_] = moved
        same = open_[(moved == moved[:, :1]).all(axis=1)]
        agreed[same], one[same] = True, maps[same, 0]
    maps[agreed] = one[agreed, None]

    # prefix scan over the maps of each row's chunks, in log2 of their number steps
    scan, step = maps[back], 1
    while step < int(parts.max()):
        later = np.flatnonzero(nth >= step)
        scan[later] = np.take_along_axis(scan[later], scan[later - step], axis=1)
        step *= 2
    after = scan[:, START]
    first = np.where(nth == 0, START, np.concatenate([[START], after[:-1]]))[order]

    cut = np.zeros(len(kinds) + 1, dtype=bool)
    for i, n in enumerate(running):
        at = begin[:n] + i
        code = first[:n] * 12 + kinds[at]
        found = CUTS[code]
        cut[at[(found & CUT_HERE) > 0]] = True
        cut[at[(found & CUT_BEFORE) > 0] - 1] = True
        first[:n] = SPLITTER[code]
    last = after[np.cumsum(parts) - 1]  # a text that ends in 'r, 'v or 'l: the letter is a word
    cut[(rows + size - 1)[(last == QUOTE_R) | (last == QUOTE_V) | (last == QUOTE_L)]] = True
    cut[rows] = True
    return np.flatnonzero(cut)


class Counter:
    """Token counts of whole Arrow columns with a compiled vocabulary."""

    def __init__(self, spec: dict, max_states: int = MAX_STATES):
        self.machine = MergeMachine(spec["merges"], max_states)
        self.added = [w.encode() for w in spec["added"]]
        self.kinds = np.repeat(spec["kinds"], np.diff(np.append(spec["kind_at"], 0x110000)))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row; added tokens found in a text are one token each and split it."""
        raw = data.tobytes()
        bounds, extra = offsets, np.zeros(len(offsets) - 1, dtype=np.int64)
        spans, taken = [], bytearray(len(raw))
        for word in self.added:
            at = raw.find(word)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(word) <= offsets[row + 1] and taken.find(1, at, at + len(word)) < 0:
                    spans.append((at, at + len(word)))
                    taken[at : at + len(word)] = b"\1" * len(word)
                    extra[row] += 1
                    at = raw.find(word, at + len(word))
                else:
                    at = raw.find(word, at + 1)
        marks = np.array(sorted(spans), dtype=np.int64).reshape(-1, 2)
        if len(marks):
            bounds = np.unique(np.concatenate([offsets, marks.ravel()]))
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        if len(points) == len(data):
            byte_at, char_at = np.arange(len(data) + 1), bounds
        else:
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            byte_at = np.concatenate([[0], np.cumsum(width)])
            char_at = np.searchsorted(byte_at, bounds)
        starts = pretoken_starts(self.kinds[points], char_at)
        begin = byte_at[starts]
        size = np.diff(np.append(begin, len(data)))
        if len(marks):
            stays = ~np.isin(begin, marks[:, 0])
            inside = np.searchsorted(marks[:, 0], begin, "right") - 1
            stays &= (inside < 0) | (begin >= marks[np.maximum(inside, 0), 1])
            begin, size = begin[stays], size[stays]
        tokens = self.machine.counts(data, begin, size)
        row = np.searchsorted(offsets, begin, "right") - 1
        return extra + np.bincount(row, weights=tokens, minlength=len(extra)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row: what the library's encoding would have.

    Null and empty texts have 0 bytes and tokens. Null doc_ids and repeated rows are kept,
    other columns not read, no rows give none. Nothing is shuffled.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(compiled(tokenizer))  # the size of the vocabulary file

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text_units import blocks, utf8

        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = Counter(sent.value)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n = [_COUNTERS[tokenizer].count(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in blocks(offsets)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(np.concatenate(n) if n else np.empty(0, dtype=np.int64))})

    out = docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
