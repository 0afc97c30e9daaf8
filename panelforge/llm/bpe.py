"""Byte-level BPE: encoding and decoding of whole texts.

The split of a text before the merges follows the pattern of the rank files

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regex: every code point gets a class, class and near neighbours give a symbol, and each symbol is a
function from the state before it to the state after it.  Functions compose associatively, so the state at every
position comes from a blocked scan over all texts of a batch at once; a slice begins where a transition says so.
The byte slices go through a cache of merged pieces.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import small_batches
from ._text import codepoints, filled, flat, lists, numbered, pieces_of, tidied

#: Texts are handled in runs of about so many bytes, which bounds a worker's memory.
RUN_BYTES = 1 << 19
#: Merged pieces from which a worker's cache is set aside for a new one, which takes over what is still met.
CACHE_PIECES = 200_000
#: Longer pieces merge by a heap and aren't kept.
LONG_PIECE = 96
BLOCK = 128

OTHER, LETTER, NUMBER, SPACE = range(4)
# Symbols of the scan.
S_LETTER, S_NUMBER, S_OTHER, S_APOS1, S_APOS2, S_BLANK, S_JOIN, S_LAST = range(8)
# States: at a slice's end, in letters, in numbers, in others, after a blank that joins what follows, in blanks,
# one or two letters before the end of a contraction.
AT_END, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)


def _transition(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a slice begins at it."""
    if symbol == S_LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (AT_END if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if symbol in (S_OTHER, S_APOS1, S_APOS2):
        if state in (IN_OTHERS, JOINING) or symbol == S_OTHER:
            return IN_OTHERS, state not in (IN_OTHERS, JOINING)
        return (ONE_LEFT if symbol == S_APOS1 else TWO_LEFT), True
    if symbol == S_BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (JOINING if symbol == S_JOIN else AT_END), True  # the last blank before something else


class _Scan:
    """Transition tables, and the closure of the symbols' functions under composition."""

    def __init__(self) -> None:
        # symbols 8..15 are 0..7 at the first code point of a text, where no earlier state counts; 16 changes nothing
        steps = [[_transition(s if k < 8 else AT_END, k % 8) for s in range(8)] for k in range(16)]
        steps.append([(s, False) for s in range(8)])
        self.after = np.array([[x[0] for x in row] for row in steps], np.uint8).ravel()
        self.begins = np.array([[x[1] for x in row] for row in steps], bool).ravel()
        functions = [tuple(x[0] for x in row) for row in steps]
        names = {f: k for k, f in enumerate(dict.fromkeys(functions))}
        self.of_symbol = np.array([names[f] for f in functions], np.int32)
        todo = list(names)
        generators = list(names)
        while todo:
            f = todo.pop()
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in names:
                    names[h] = len(names)
                    todo.append(h)
        every = np.array(list(names), np.uint8)
        self.size = len(every)
        self.result = every[:, AT_END].copy()
        index = {tuple(map(int, f)): k for k, f in enumerate(every)}
        self.compose = np.array([[index[tuple(map(int, g[f]))] for g in every] for f in every], np.int32).ravel()

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a slice begins at each position."""
        n = len(symbols)
        blocks = -(-n // BLOCK)
        grid = np.full(blocks * BLOCK, 16, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
        whole = self.of_symbol[grid[0]]
        for row in grid[1:]:
            whole = self.compose[whole * self.size + self.of_symbol[row]]
        step = 1
        while step < blocks:  # prefixes of the blocks' functions
            whole[step:] = self.compose[whole[:-step] * self.size + whole[step:]]
            step *= 2
        state = np.concatenate(([AT_END], self.result[whole[:-1]])).astype(np.intp)
        out = np.empty((BLOCK, blocks), bool)
        for k, row in enumerate(grid):
            at = row.astype(np.intp) * 8 + state
            out[k] = self.begins[at]
            state = self.after[at].astype(np.intp)
        return out.T.ravel()[:n]


@lru_cache(1)
def _scan() -> _Scan:
    return _Scan()


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, read off the tokenizer library's own character tables."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([k]): k for k in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        reader = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        table[codepoints(reader.decode_bytes(reader.encode_ordinary(every)))] = kind
    return table


def slice_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each code point; ``at`` has the first code point of each text, and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kinds = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[at] = True  # an empty text's start is that of the next
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_BLANK], np.uint8)[kinds]
    blank = np.append(kinds == SPACE, True)
    last = blank[:-1] & ~blank[1:] & ~first[1:]
    symbols[last] = S_LAST
    symbols[last & (points == 32)] = S_JOIN
    marks = np.flatnonzero(points == 39)
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1]]
    if len(marks):
        one = points[marks + 1]
        symbols[marks[np.isin(one, np.frombuffer(b"stmd", np.uint8))]] = S_APOS1
        marks = marks[marks + 2 < n]
        marks = marks[~first[marks + 2]]
        pair = points[marks + 1] << 8 | points[marks + 2]
        symbols[marks[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]] = S_APOS2
    symbols[first[:-1]] += 8
    return _scan().starts(symbols)


class Vocabulary:
    """Ranks of byte strings; merges and the cache of pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.lengths = np.array([len(w) for w in self.words], np.int32)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one slice: again and again the pair of lowest rank, the leftmost of equals, becomes one."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._merge_long(piece) if len(piece) > LONG_PIECE else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, len(self.words)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < none:
            k = pairs.index(low)
            parts[k : k + 2] = [self.words[low]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same in n log n: parts are a linked list, pairs a heap whose outdated entries are passed over."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts at each position; 0 where none starts
        before = list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            middle = end[k]
            if not middle or middle >= n or ranks.get(piece[k : end[middle]]) != rank:
                continue
            stop = end[middle]
            end[k], end[middle] = stop, 0
            if stop < n:
                before[stop] = k
                if (r := ranks.get(piece[k : end[stop]])) is not None:
                    heapq.heappush(heap, (r, k))
            if (left := before[k]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : end[k]]])
            k = end[k]
        return out

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice as little-endian int32 bytes."""
        if len(self.cache) >= CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        found = list(map(cache.get, pieces))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    piece = pieces[k]
                    if (ids := cache.get(piece)) is None:
                        if (ids := older.get(piece)) is None:
                            ids = np.array(self.merge(piece), "<i4").tobytes()
                        if len(piece) <= LONG_PIECE:
                            cache[piece] = ids
                    found[k] = ids
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, the byte at which each starts in its text, and each text's first id."""
        data, rows = flat(column)
        raw = bytes(data)
        points = codepoints(raw)
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(wide)))
        starts = slice_starts(points, np.searchsorted(byte_at, rows))
        cuts = byte_at[np.flatnonzero(starts)]
        ends = np.append(cuts[1:], len(raw)) if len(cuts) else cuts
        parts = self.packed([raw[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)])
        ids = np.frombuffer(b"".join(parts), "<i4")
        count = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)))
        at = count[np.searchsorted(cuts, rows)]  # a text's first slice starts at its first byte
        byte_of = np.concatenate(([0], np.cumsum(self.lengths[ids], dtype=np.int64)))[: len(ids)]
        return ids, (byte_of - np.repeat(rows[:-1], np.diff(at))).astype(np.int32), at


    def decode(self, values: np.ndarray, at: np.ndarray, offsets: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """The bytes of rows of ids one after another, and each row's first byte; ``offsets`` must be those of the ids."""
        if len(values) and (values.min() < 0 or values.max() >= len(self.words)):
            raise ValueError("an id is outside the vocabulary")
        byte_at = np.concatenate(([0], np.cumsum(self.lengths[values], dtype=np.int64)))
        rows = byte_at[at]
        if offsets is not None and (len(offsets) != len(values) or not np.array_equal(offsets, byte_at[:-1] - np.repeat(rows[:-1], np.diff(at)))):
            raise ValueError("ids and offsets disagree")
        words = self.words
        return b"".join([words[k] for k in values.tolist()]), rows


def _binaries(data: bytes, rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer(rows.astype(np.int32).tobytes()), pa.py_buffer(data)])


def parse(content: bytes) -> Vocabulary:
    """A vocabulary from lines of a base64 byte string and its rank."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())})


@lru_cache(2)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as file:
        return parse(file.read())


def _vocabulary(path: str, content: bytes) -> Vocabulary:
    """The worker's vocabulary, parsed once per process from the broadcast file content."""
    if path not in _LOADED:
        _LOADED[path] = parse(content)
    return _LOADED[path]


_LOADED: dict[str, Vocabulary] = {}


def _ship(df: DataFrame, path: str) -> pyspark.Broadcast:
    """The rank file's bytes for the executors (under 1 MB for 50,000 ranks), so that only the driver needs the file."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all but ``text``) with ``ids`` and ``offsets`` of each whole text.

    ``ids`` are what the tokenizer library gives for the ranks in the file at ``path`` without special tokens;
    ``offsets`` have the UTF-8 byte of the text at which each id starts.  A null or empty text has no ids.  With
    ``decoded``, a column of that name has the bytes that the ids decode to, as ``decode`` would give, from the same
    worker.  A column of ``df`` with a new name gives way if it is kept.  Rows are handled one by one, in runs of
    bounded size: equal rows, ties and empty tables need nothing special, and there is no shuffle.
    """
    small_batches(df.sparkSession)
    shipped = _ship(df, path)
    new = ["ids", "offsets", *([decoded] if decoded else [])]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new} and (keep is not None or c != text)]
    source, names, keep = numbered(df, keep, F.col(f"`{text}`").alias("__text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, shipped.value)
        for batch in batches:
            for part in pieces_of(batch, "__text__", RUN_BYTES):
                ids, offsets, at = vocabulary.encode(filled(part.column("__text__")))
                back = [_binaries(*vocabulary.decode(ids, at, offsets))] if decoded else []
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists(ids, at), lists(offsets, at), *back], [*keep, *new])
        vocabulary.older = {}  # the worker stays for other tasks

    ints = T.ArrayType(T.IntegerType(), False)
    more = [T.StructField("ids", ints), T.StructField("offsets", ints), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return source.mapInArrow(tidied(run), T.StructType([*[source.schema[c] for c in keep], *more])).toDF(*names, *new)


def decode(df: DataFrame, path: str, ids: str = "ids", offsets: str | None = "offsets", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all but ``offsets``) with ``decoded``, the bytes of the ids (null ids: empty).

    Where ``offsets`` is given, each id's bytes must start there; a row for which they don't raises an error, as an id
    outside the vocabulary does.  A column of ``df`` called decoded gives way.
    """
    small_batches(df.sparkSession)
    shipped = _ship(df, path)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "decoded" and (keep is not None or c != offsets)]
    source, names, keep = numbered(df, keep, F.col(f"`{ids}`").alias("__ids__"), *([F.col(f"`{offsets}`").alias("__offsets__")] if offsets else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, shipped.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                column = part.column("__ids__")
                counts = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
                at = np.concatenate(([0], np.cumsum(counts)))
                told = part.column("__offsets__").flatten().to_numpy(zero_copy_only=False) if offsets else None
                found = vocabulary.decode(column.flatten().to_numpy(zero_copy_only=False), at, told)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], _binaries(*found)], [*keep, "decoded"])

    return source.mapInArrow(tidied(run), T.StructType([*[source.schema[c] for c in keep], T.StructField("decoded", T.BinaryType())])).toDF(*names, "decoded")


def joined(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))
