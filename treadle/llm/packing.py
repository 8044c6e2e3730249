"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Documents longer than a window are first cut into full windows; what remains of each is placed, longest first, into
the open window with the least room that still holds it. A segment tree over remaining room finds that window. A first round works
where the texts are read, on a bounded number of tokens at a time; windows that still have room stay open for the next
lot, so a task holds one lot's tokens and the open windows' room, whatever its input. Its pieces are kept in the shared folder. Those in
windows that end with more than SLACK free are then taken out and packed anew, in tasks of about LOT_TOKENS each,
so that the padding doesn't follow how many files or parts the texts come in.

Null text counts as empty: such a document still has its end-of-document id. Equal lengths are placed in input order.
Repeated rows are packed each on its own; a null id is kept. A very long text is encoded whole, in its own row. Further columns of
the input aren't read. An empty table gives no rows. Sequence ids are unique: the round, the task's number and a counter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadle.llm.bpe import codec
from treadle.llm.common import stored, tidied

WINDOW = 1024
LOT_TOKENS = 4_000_000
#: Free places of a window that are left as they are.
SLACK = 8
#: Sequence ids are broadcast up to this many (8 bytes each).
BROADCAST_ROWS = 1_000_000
SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining room, 1 to ``size``; the tree's nodes count the open windows below them."""

    def __init__(self, size: int):
        self.leaves = 1 << (size).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, window: tuple[int, int]) -> None:
        if room:
            self.stacks[room].append(window)
            self._add(room, 1)

    def tightest(self, need: int) -> int:
        """The least room of an open window that is at least ``need``; 0 if there is none."""
        at, count = need + self.leaves, self.count
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return 0

    def take(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.stacks[room].pop()


class Packer:
    def __init__(self, size: int, first: int):
        self.size, self.next, self.open = size, first, OpenWindows(size)

    def place(self, lengths: list[int]) -> list[tuple[int, int, int, int]]:
        """(piece, start, sequence, offset) for documents of these lengths; pieces of a document cover it without overlap."""
        size, out, rest = self.size, [], []
        for k, n in enumerate(lengths):
            full = n // size
            out += [(k, j * size, self.next + j, 0) for j in range(full)]
            self.next += full
            if n % size:
                rest.append((n % size, k, full * size))
        rest.sort(key=lambda x: -x[0])
        for n, k, start in rest:
            room = self.open.tightest(n)
            if room:
                sequence, used = self.open.take(room)
            else:
                sequence, used, room = self.next, 0, size
                self.next += 1
            out.append((k, start, sequence, used))
            self.open.put(room - n, (sequence, used + n))
        return out


def placed_rows(held: list[tuple], packer: Packer) -> Iterator[pa.RecordBatch]:
    """Pieces of (document, place of the first id there, ids, the document's ids), and where the packer puts them."""
    placed = packer.place([len(ids) for _, _, ids, _ in held])
    for k in range(0, len(placed), 2048):
        part = placed[k : k + 2048]
        own = [held[d] for d, *_ in part]
        found = [ids[start : start + packer.size] for (_, start, _, _), (_, _, ids, _) in zip(part, own, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([doc for doc, *_ in own], pa.int64()),
                pa.array([first + start for (_, start, _, _), (_, first, _, _) in zip(part, own, strict=True)], pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()),
                pa.array([tokens for *_, tokens in own], pa.int64()),
                pa.array([s for _, _, s, _ in part], pa.int64()),
                pa.array([o for _, _, _, o in part], pa.int64()),
            ],
            ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, its first token's place there, its ids, its sequence and its place in that."""

    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        code = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(code.encode(text or ""), np.uint32(end_id))
                    yield doc, 0, ids, len(ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, start, ids, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                yield doc, start, np.frombuffer(ids, np.uint32), tokens

    def packed(first: int, read) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(window, first + (TaskContext.get().partitionId() << 40))
            held, tokens = [], 0
            for row in read(batches):
                held.append(row)
                tokens += len(row[2])
                if tokens >= LOT_TOKENS:
                    yield from placed_rows(held, packer)
                    held, tokens = [], 0
            yield from placed_rows(held, packer)

        return run

    done = stored(plain.mapInArrow(tidied(packed(0, encode)), SCHEMA))
    fills = done.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    loose = fills.where(F.col("fill") < window - SLACK)
    n, tokens = loose.agg(F.count("*"), F.sum("fill")).first()
    if n < 2:
        return done
    loose = stored(loose.select("sequence_id"))
    loose = F.broadcast(loose) if n <= BROADCAST_ROWS else loose
    again = done.join(loose, "sequence_id", "left_semi").select("id", "start", "ids", "doc_tokens", "sequence_id", "offset")
    again = again.repartition(max(1, -(-tokens // LOT_TOKENS)), F.xxhash64("sequence_id", "offset")).select("id", "start", "ids", "doc_tokens")
    return done.join(loose, "sequence_id", "left_anti").select(*done.columns).unionByName(again.mapInArrow(tidied(packed(1 << 62, pieces)), SCHEMA))
