"""Byte-level BPE: content-defined chunk reuse.

A text is cut where a rolling hash of its last 16 code points hits a mask, so equal passages of different
documents give equal chunks. A chunk is encoded once per Python worker while it stays in a bounded cache. The
tokens at a chunk join can differ from those of the whole text; the join is repaired by encoding the text between
the nearest sure token boundaries around it again, and the window widens until both sides agree with it.

Texts in the Latin range go through tiktoken with the file's vocabulary, texts with other characters, or with runs of 2,000 white spaces,
through the tokenizers library itself: the ids are the same, the first is several times as fast.

Null text counts as empty. An empty text has no ids. Very long texts are processed chunk by chunk. Rows, repeated or
not, are independent of one another, and equal texts have equal ids; there are no ties, as merges have ranks. Further columns of the
input aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treadle.llm.common import tidied

#: The split pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to this code point the two regex libraries' character tables are known to be equal (tested one by one).
_WIDE = re.compile("[^\x00-ɏ]")
_LONG_SPACE = re.compile(r"\s{2000}")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes as the tokenizers library does with the file at ``path`` (special tokens recognised, none added).

    Where the file is a plain byte-level BPE and the text is in the Latin range, tiktoken does the merges, which gives
    the same ids several times as fast; other texts go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        spec = json.loads(self.slow.to_str())
        pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab", {})
        plain = spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.fast = None
        if plain:
            import tiktoken

            alphabet = byte_alphabet()
            ranks = {bytes(alphabet[c] for c in token): k for token, k in vocab.items() if all(c in alphabet for c in token)}
            special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            ranks = {b: k for b, k in ranks.items() if k not in set(special.values())}
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            size = max([*ranks.values(), *special.values()]) + 1
            self.bytes_of = np.zeros(size, np.int64)
            for b, k in [*ranks.items(), *((s.encode(), k) for s, k in special.items())]:
                self.bytes_of[k] = len(b)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and (text.isascii() or not _WIDE.search(text)) and not _LONG_SPACE.search(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        if self.fast is not None:
            return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")
        return self.slow.decode(ids.tolist(), skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


_GEAR = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def cuts(text: str, mask_bits: int = 11, least: int = 512, most: int = 16384) -> list[int]:
    """Positions at which a text is cut: where a rolling hash of the last 16 code points ends in zeros, at least ``least`` and at most ``most`` apart."""
    n = len(text)
    if n <= least:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _GEAR[points & 0xFFFF]
    for shift in (1, 2, 4, 8):
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint32(shift)
        h = more
    hits = np.flatnonzero((h >> np.uint32(16 - mask_bits)) & np.uint32((1 << mask_bits) - 1) == 0)
    out, last = [], 0
    for at in hits.tolist():
        at += 1
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least and at < n:
            out.append(at)
            last = at
    while n - last > most:
        last += most
        out.append(last)
    return out


def _sure(text: str, at: int) -> bool:
    """A space between two letters or digits begins a token, whatever stands further away."""
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1].isalnum() and text[at + 1].isalnum()


def sure_before(text: str, at: int) -> int:
    while at > 0 and not _sure(text, at):
        at = text.rfind(" ", 0, at)
    return max(at, 0)


def sure_after(text: str, at: int) -> int:
    n = len(text)
    while at < n and not _sure(text, at):
        at = text.find(" ", at + 1)
        if at < 0:
            return n
    return at


class ChunkEncoder:
    """Encodes texts chunk by chunk and keeps at most ``keep`` code points of encoded chunks for reuse."""

    def __init__(self, path: str, keep: int = 12_000_000):
        self.codec, self.keep, self.held = codec(path), keep, 0
        self.chunks: OrderedDict[str, np.ndarray] = OrderedDict()
        self.reused = self.encoded = 0

    def chunk(self, piece: str) -> np.ndarray:
        ids = self.chunks.get(piece)
        if ids is not None:
            self.chunks.move_to_end(piece)
            self.reused += 1
            return ids
        self.encoded += 1
        ids = self.chunks[piece] = self.codec.encode(piece)
        self.held += len(piece)
        while self.held > self.keep:
            self.held -= len(self.chunks.popitem(last=False)[0])
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text or self.codec.fast is None:  # without known token bytes joins can't be checked
            return self.codec.encode(text or "")
        at = cuts(text)
        edges = [0, *at, len(text)]
        windows: list[list[int]] = []
        for c in at:
            left, right = sure_before(text, c), sure_after(text, c)
            if windows and left <= windows[-1][1]:
                windows[-1][1] = max(right, windows[-1][1])
            else:
                windows.append([left, right])
        out, start = [], 0
        for left, right in [*windows, [len(text), len(text)]]:
            while start < left:  # the inner part of one chunk
                k = bisect.bisect_right(edges, start) - 1
                inner = self._inner(text, edges[k], edges[k + 1], start, left)
                if inner is not None:
                    out.append(inner)
                    break
                wider = sure_before(text, left - 1)  # no agreement yet: the window takes in more of the text
                left = wider if wider > start else start
            if left < right:
                out.append(self.codec.encode(text[left:right]))
            start = right
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _inner(self, text: str, begin: int, end: int, start: int, stop: int) -> np.ndarray | None:
        """The ids of text[start:stop] out of those of the chunk text[begin:end]; None if the chunk has no token boundary there."""
        ids = self.chunk(text[begin:end])
        if start == begin and stop == end:
            return ids
        ends = np.cumsum(self.codec.bytes_of[ids])
        total = int(ends[-1]) if len(ends) else 0
        head, tail = len(text[begin:start].encode("utf-8", "surrogatepass")), total - len(text[stop:end].encode("utf-8", "surrogatepass"))
        a, b = int(np.searchsorted(ends, head)) + 1 if head else 0, int(np.searchsorted(ends, tail)) + 1
        if (head and (a > len(ends) or ends[a - 1] != head)) or b > len(ends) or ends[b - 1] != tail:
            return None
        return ids[a:b]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row: its ids as little-endian unsigned 32-bit integers, and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([encoder.codec.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return plain.mapInArrow(tidied(run), "id long, ids binary, decoded string")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
