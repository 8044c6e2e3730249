"""Snapshots in the packed little-endian form with the magic DS10, one file per root.

Fixed layout: magic, root length (u32), root, device and inode (u64), birth time (i64), node count (u32); per node path
length (u32), path relative to the root, score and opens (f64), directory flag (u8); edge count (u32); per edge from and to
(u32), weight (f64); at the end the time of the last decay (i64).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"DS10"


def encode(root: str, nodes: list[tuple[str, float, float, bool]], edges: list[tuple[int, int, float]], identity: tuple[int, int, int] = (0, 0, 0), last_decay: int = 0) -> bytes:
    raw = root.encode()
    out = [MAGIC, struct.pack("<I", len(raw)), raw, struct.pack("<QQq", *identity), struct.pack("<I", len(nodes))]
    for rel, score, opens, is_dir in nodes:
        name = rel.encode()
        out += [struct.pack("<I", len(name)), name, struct.pack("<ddB", score, opens, is_dir)]
    out.append(struct.pack("<I", len(edges)))
    out += [struct.pack("<IId", *e) for e in edges]
    return b"".join([*out, struct.pack("<q", last_decay)])


def _relative_ok(rel: str) -> bool:
    return rel == "" or ("\0" not in rel and all(s not in ("", ".", "..") for s in rel.split("/")))


def decode(data: bytes) -> dict:
    """All fields; ValueError if any is wrong, or if bytes are missing or left over."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise ValueError("the snapshot ends too early")
        at += size
        return struct.unpack_from(form, data, at - size)

    def text(n: int) -> str:
        return take(f"<{n}s")[0].decode()

    if take("<4s")[0] != MAGIC:
        raise ValueError("not a snapshot")
    root = text(take("<I")[0])
    identity = take("<QQq")
    nodes, seen = [], set()
    for _ in range(take("<I")[0]):
        rel = text(take("<I")[0])
        score, opens, is_dir = take("<ddB")
        if not _relative_ok(rel) or rel in seen or is_dir > 1 or not all(math.isfinite(x) and x >= 0 for x in (score, opens)):
            raise ValueError(f"a bad node: {rel!r}")
        seen.add(rel)
        nodes.append((rel, score, opens, bool(is_dir)))
    edges = []
    for _ in range(take("<I")[0]):
        src, dst, weight = take("<IId")
        if src >= len(nodes) or dst >= len(nodes) or not math.isfinite(weight) or weight < 0:
            raise ValueError(f"a bad edge: {src}, {dst}")
        edges.append((src, dst, weight))
    (last_decay,) = take("<q")
    if at != len(data) or last_decay < 0:
        raise ValueError("bytes are left over, or the decay time is wrong")
    return {"root": root, "identity": identity, "nodes": nodes, "edges": edges, "last_decay": last_decay}


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(root, id, rel, pgrk, opens, is_dir) of all snapshot files at a path, a file per task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                got = decode(bytes(content))
                yield pd.DataFrame([(got["root"], k, *n) for k, n in enumerate(got["nodes"])], columns=["root", "id", "rel", "pgrk", "opens", "is_dir"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "root string, id int, rel string, pgrk double, opens double, is_dir boolean")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(root, src, dst, weight) of all snapshot files at a path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                got = decode(bytes(content))
                yield pd.DataFrame([(got["root"], *e) for e in got["edges"]], columns=["root", "src", "dst", "weight"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "root string, src int, dst int, weight double")
