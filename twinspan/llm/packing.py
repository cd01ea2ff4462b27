"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are tokenised and cut into pieces where they lie; only the pieces' numbers travel. Pieces
that fill a sequence stand alone. The others are dealt to groups of bounded size, by row and not by
any value of it, so that no key makes a group large; each group is packed by best fit, longest first,
and then improved: documents move, or are exchanged one for one or two for one, between underfull
sequences, always so that the sum of squared fills rises, until sequences run empty. A group leaves
less than one sequence's worth of tokens that a packing of all rows at once could have saved.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.llm.words import tidy
from twinspan.plans.scratch import bounded_batches, save
from twinspan.sources.tables import table

CAPACITY = 2048
#: Pieces packed by one task.
GROUP = 20_000
#: Sequences, those with most room first, that local search tries for a document.
NEAR = 32
#: Documents of a sequence, the shortest, that are tried in twos.
PAIRED = 16
#: Words, and pieces of words, whose ids a worker keeps: some 20 MB of each.
MEMO = 100_000

# The word pattern of word_bpe_49k for texts of ASCII and Latin-1 letters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Words whose pieces that pattern gives: no special token's "<", nothing that normalisation changes but case.
_PLAIN = re.compile(r"[!-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]{1,64}")


class WordIds(dict):
    """Token ids of words, as little-endian unsigned 32-bit numbers, kept for the words seen last.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words
    in turn. Plain words go straight to the merges; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in shown]
        self.sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECE.findall(text.lower())])
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else "".join(map(self.sign.__getitem__, piece.encode()))
        if len(self.pieces) >= MEMO:
            self.pieces.clear()
        self.pieces[piece] = ids = np.array([t.id for t in self.model.tokenize(signs)], "<u4").tobytes()
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


@lru_cache(1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, then id 0, cut at `capacity`."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = known.ids(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of row numbers: each row, longest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r is open
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = some >> lengths[i]
        if fits:
            r = lengths[i] + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            some ^= (not room[r]) << r
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room[r - lengths[i]].append(b)
        some |= 1 << r - lengths[i]
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges; each raises the sum of squared fills, so it ends.

    The emptiest bin that isn't stuck gives to those with most room that are fuller than it, an
    exchange at a time, until it is empty or none of them can take anything; then it is stuck, unless an
    exchange changes it again.
    """
    held = [sorted((lengths[i], i) for i in b) for b in bins]
    fill = [sum(n for n, _ in b) for b in held]
    spare = sum(capacity - f for f in fill)
    order = sorted((f, b) for b, f in enumerate(fill) if f < capacity)  # the underfull
    waiting = list(order)  # a heap, whose outdated entries are passed over
    while waiting and spare >= capacity:  # with less room in all, no bin can run empty
        f, a = heappop(waiting)
        if fill[a] != f or not held[a]:
            continue
        k = bisect_left(order, (f, a))
        b = _step(a, [x for _, x in order[k + 1 : k + 1 + NEAR]], held, fill, capacity)
        if b is None:
            continue
        gain = f - fill[a]
        del order[bisect_left(order, (fill[b] - gain, b))], order[bisect_left(order, (f, a))]
        spare -= 0 if held[a] else capacity
        for x in (a, b):
            if held[x] and fill[x] < capacity:
                insort(order, (fill[x], x))
                heappush(waiting, (fill[x], x))
        k = bisect_left(order, (fill[a], a))
        for x in order[max(0, k - NEAR) : k]:  # emptier ones, stuck so far, of which a document fits now
            if held[x[1]][0][0] <= capacity - fill[a]:
                heappush(waiting, x)
    return [[i for _, i in b] for b in held if b]


def _step(a: int, others: list[int], held: list[list[tuple[int, int]]], fill: list[int], capacity: int) -> int | None:
    """Makes the exchange that takes most tokens from bin `a` to another; that other bin, if there is one."""
    best: tuple[int, int, list, list] = (0, -1, [], [])
    mine = held[a]
    twos = [(x[0] + y[0], [x, y]) for i, x in enumerate(mine[:PAIRED]) for y in mine[i + 1 : PAIRED]]
    for b in others:
        room = capacity - fill[b]
        theirs = held[b]
        for n, given in [(x[0], [x]) for x in mine] + twos:
            if n <= room:  # a move
                gain, back = n, []
            else:
                k = bisect_left(theirs, (n - room, -1))  # one for one, or two for one
                gain, back = (n - theirs[k][0], [theirs[k]]) if k < len(theirs) else (0, [])
                if len(given) == 1:  # one for two
                    for i, x in enumerate(theirs[:PAIRED]):
                        k = bisect_left(theirs, (n - room - x[0], -1), i + 1)
                        if k < len(theirs) and n - x[0] - theirs[k][0] > gain:
                            gain, back = n - x[0] - theirs[k][0], [x, theirs[k]]
            if gain > best[0]:
                best = (gain, b, given, back)
    gain, b, given, back = best
    if not gain:
        return None
    held[a] = sorted([x for x in mine if x not in given] + back)
    held[b] = sorted([x for x in held[b] if x not in back] + given)
    fill[a] -= gain
    fill[b] += gain
    return b


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the rows of `pieces`. Written once, for every later pass reads it."""
    cut = save(cut, "pieces").withColumn("row", F.monotonically_increasing_id())
    full = cut.where(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        lengths = frame["length"].tolist()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for b, rows in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            sequence[rows] = (int(frame["group"].iloc[0]) << 32) + b
            offset[rows] = np.cumsum([0, *(lengths[i] for i in rows[:-1])])
        return frame.drop(columns=["row", "group"]).assign(sequence_id=sequence, offset=offset)

    return rest.groupBy("group").applyInPandas(run, full.schema).union(full)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    path: a tokenizer file that every executor has; the public 49k word vocabulary unless given. A
    null or empty text is its separator alone. Repeated rows are packed each for itself; an empty
    table gives no rows; other columns of the input are left alone.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, path, capacity), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
