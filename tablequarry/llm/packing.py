"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity.

The placements depend on lengths alone, and there are at most `capacity` distinct lengths. So the
driver packs a histogram, however many documents there are, and each document then finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, slices

#: Without effect, for callers that set it: one rule places all pieces, however many.
PLAN_PIECES = 20_000
#: Text outside these characters goes to the slower library, whose Unicode tables are the contract's.
_ODD = re.compile("[^\t\n\r -~¡-ɏ]")
_SPACES = re.compile(r"\s\s")
_encoders: dict[tuple, Callable[[str], np.ndarray]] = {}


def located(name: str) -> str:
    """A vocabulary file: a whole path as it is, a bare name as the worker's own installation has it."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32) by the tokenizers file at path, special tokens' strings being ordinary text.

    ranks_path and pattern (default: that of the public vocabularies): the same vocabulary as
    ranks, read by tiktoken, which gives the same ids several times faster for text in Latin
    letters and ASCII; other text stays with tokenizers. Paths: see located.
    """
    key = (path, ranks_path, pattern)
    if key not in _encoders:
        loaded: list = []

        def by_file(text: str) -> np.ndarray:
            if not loaded:  # some 100 MB, for those workers that need it
                from tokenizers import Tokenizer

                loaded.append(Tokenizer.from_file(located(path)))
                loaded[0].encode_special_tokens = True
            return np.array(loaded[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

        if ranks_path is None:
            _encoders[key] = by_file
        else:
            import tiktoken

            if pattern is None:
                from public_tokenizers import PATTERN as pattern

            with open(located(ranks_path), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            # Without white space in a row, the pattern's look-ahead never matters; its engine is faster without.
            plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

            def encode(text: str) -> np.ndarray:
                if _ODD.search(text):
                    return by_file(text)
                return (full if _SPACES.search(text) else plain).encode_to_numpy(text, disallowed_special=())

            _encoders[key] = encode
    return _encoders[key]


def pieces(docs: DataFrame, capacity: int, encoding: dict, *, id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Tokenises each whole text once: id, piece, start, length, ids_crc32 per piece.

    end_id follows each document's ids. Only documents over the capacity are cut, so that all
    pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(**encoding)
        for batch in batches:
            out: list[tuple] = []
            for key, body in (x for part in slices(batch) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                ids = np.append(encode(body or ""), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                out += [(key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def _flows(count: list[int], length: int, capacity: int, pieces: int) -> tuple[dict[int, int], int]:
    """(moves, left): how many open sequences of each gap take a piece, one piece at a time, and how many pieces find none.

    Placing one piece in a gap changes the choices of that gap and of those a length away alone; a
    heap holds the choices, stale ones being dropped as they come up. count is brought up to date.
    """
    room = sum(count[g] * (g // length) for g in range(length, capacity))
    moves: dict[int, int] = {}
    if pieces >= room:  # every gap is used as often as it can be, in whatever order
        for gap in range(capacity - 1, length - 1, -1):
            if n := count[gap]:
                moves[gap] = n
                count[gap - length] += n
                count[gap] = 0
        count[0] = 0
        return moves, pieces - room

    def change(gap: int) -> int:
        return 2 * (count[gap - length] - count[gap]) + 2 if gap > length else 1 - 2 * count[gap]

    heap = [(change(g), g) for g in range(length, capacity) if count[g]]
    heapq.heapify(heap)
    while pieces:
        key, gap = heapq.heappop(heap)
        if not count[gap] or key != change(gap):
            continue
        # The best stays the best for n pieces: each makes it worse by 4 at most, and others better by 2 at most.
        other = heap[0][0] if heap else key
        low = gap - length
        if low >= length:  # the gap that is left, where no sequence has been, becomes a choice
            other = min(other, change(low))
        n = min(pieces, count[gap], 1 + max(0, other - key - 1) // 6)
        moves[gap] = moves.get(gap, 0) + n
        pieces -= n
        count[gap] -= n
        if low:
            count[low] += n
        for g in (gap, gap + length, low):
            if length <= g < capacity and count[g]:
                heapq.heappush(heap, (change(g), g))
    return moves, 0


def sum_of_squares(histogram: dict[int, int], capacity: int, batch: int = 1) -> list[tuple[int, int, int, int]]:
    """Packs pieces, the longest first; returns rows (length, sequence, offset, n): n pieces in as many sequences from one on.

    Each goes where the sum, over residual gaps, of the squared number of open sequences with
    that gap becomes smallest (full sequences count no more; ties: the tighter gap). A new
    sequence opens only where no open one has room. Sequences of one gap are alike to that rule,
    so each length's moves are counted by gap, piece by piece, and then made in runs of
    sequences: the rows depend on lengths and gaps, not on the number of pieces. `batch` has no effect.
    """
    count = [0] * (capacity + 1)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: first sequence, how many
    sequences, slots = 0, []
    for length in sorted(histogram, reverse=True):
        moves, left = _flows(count, length, capacity, histogram[length])
        if left:  # each new sequence is filled before the next opens
            most = capacity // length
            whole, rest = divmod(left, most)
            opened = whole + (rest > 0)
            open_[capacity].append((sequences, opened))
            sequences += opened
            for k in range(most):
                gap = capacity - k * length
                moves[gap] = moves.get(gap, 0) + whole + (rest > k)
            for gap, n in ((capacity - most * length, whole), (capacity - rest * length, int(rest > 0))):
                if gap:
                    count[gap] += n
        for gap in sorted(moves, reverse=True):  # those moved into a gap may move on
            n = moves[gap]
            while n:
                first, run = open_[gap].pop()
                if run > n:
                    open_[gap].append((first + n, run - n))
                    run = n
                slots.append((length, first, capacity - gap, run))
                n -= run
                if gap > length:
                    open_[gap - length].append((first, run))
    return slots


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Places all pieces of a histogram: rows (length, first rank, sequence, offset) by length and rank.

    The piece of rank r goes to sequence + (r - first rank). All pieces are placed by one rule,
    however many they are.
    """
    slots = sum_of_squares(histogram, capacity)
    length, sequence, offset, n = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4).T
    before = np.cumsum(n) - n
    rank = before - before[np.searchsorted(length, length)]  # from the first row of the same length
    return np.stack([length, rank, sequence, offset], axis=1)


def pack(docs: DataFrame, encoding: dict, *, capacity: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every document: id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.

    A null text is an empty one (its end id alone). Repeated rows, and rows without an id, are
    packed each as a document of its own. A long text gives as many pieces as it needs. An empty
    table gives an empty result; further columns are not read, so none can clash. Pieces of equal length are ranked
    by a hash, so equal input gives equal output up to equal rows.
    """
    found = cut(pieces(docs, capacity, encoding, id=id, text=text).withColumn("_h", F.xxhash64("id", "piece", "ids_crc32")))
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    ranked = numbered(found, ["length"], ["_h", "id", "piece", "ids_crc32"], max(histogram.values(), default=0), "rank")
    slots = plan(histogram, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sorted key for length and rank: ranks stay below 2**48.
        keys = (slots[:, 0] << 48) + slots[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id)
