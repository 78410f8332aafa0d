"""Packing documents into fixed token windows: bounded-space best fit inside each task, then a merge of what is left.

Each task keeps at most ``open_windows`` windows. A document fills whole windows first; its rest goes to the open window
it fits most tightly. When it fits none, the fullest window is closed: if it still has a gap of ``min_cut`` tokens or more,
the piece is cut to fill it. What is open when a task ends is re-packed, best fit in order of decreasing length, in groups
of bounded size. Memory of a task: one Arrow batch and the open windows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import only, written

# Fixed value: how byte-level BPE vocabularies of this family cut a text before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text under a byte-level ``tokenizer.json`` without added special tokens, run by tiktoken: the same ids, several times faster.

    Where a text contains the string of a special token, that is the special token's id, as ``tokenizers`` has it.
    """
    if path not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        made = tiktoken.Encoding("packing", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def ids(text: str) -> list[int]:
            if any(s in text for s in special):
                return made.encode(text, allowed_special="all")
            return made.encode_ordinary(text)

        _ENCODERS[path] = ids
    return _ENCODERS[path]


PIECE = "leftover boolean, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """The open windows of one task."""

    def __init__(self, base: int, window: int, open_windows: int, min_cut: int, with_ids: bool):
        self.window, self.room, self.min_cut, self.with_ids = window, open_windows, min_cut, with_ids
        self.next_id, self.open = base, []
        self.out: list[tuple] = []

    def _piece(self, doc, ids, start, n, total):
        part = ids[start : start + n]
        return (doc, start, n, zlib.crc32(part.tobytes()), total, part.tolist() if self.with_ids else None)

    def _emit(self, pieces, leftover=False):
        at = 0
        for p in pieces:
            self.out.append((leftover, *p[:5], self.next_id, at, p[5]))
            at += p[2]
        self.next_id += 1

    def add(self, doc, ids):
        total, start = len(ids), 0
        while total - start >= self.window:
            self._emit([self._piece(doc, ids, start, self.window, total)])
            start += self.window
        while start < total:
            n = total - start
            fits = [w for w in self.open if self.window - w[0] >= n]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.room:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
                gap = self.window - best[0]
                if gap < self.min_cut:
                    self.open.remove(best)
                    self._emit(best[1])
                    continue
                n = gap
            best[1].append(self._piece(doc, ids, start, n, total))
            best[0] += n
            start += n
            if best[0] == self.window:
                self.open.remove(best)
                self._emit(best[1])

    def finish(self):
        for fill, pieces in self.open:
            self._emit(pieces, leftover=self.window - fill >= self.min_cut)
        self.open = []


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _pack_task(path: str, window: int, open_windows: int, min_cut: int, end_id: int, with_ids: bool):
    kinds = [("leftover", pa.bool_())] + [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = _Packer(TaskContext.get().partitionId() << 32, window, open_windows, min_cut, with_ids)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packer.add(doc, np.array(ids, dtype="<u4"))
                if len(packer.out) >= 4096:
                    yield _batches(packer.out, schema)
                    packer.out = []
        packer.finish()
        if packer.out:
            yield _batches(packer.out, schema)

    return run


def _merge_group(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit decreasing; ``by_gap`` finds the tightest open window through a bit mask of gaps."""
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        by_gap: dict[int, list[int]] = {}
        mask, fills, seq, off = 0, [], [], []
        for n in pdf["length"].tolist():
            usable = mask >> n
            if usable:
                gap = n + (usable & -usable).bit_length() - 1
                k = by_gap[gap].pop()
                if not by_gap[gap]:
                    mask &= ~(1 << gap)
            else:
                gap, k = window, len(fills)
                fills.append(0)
            seq.append(k)
            off.append(fills[k])
            fills[k] += n
            left = gap - n
            if left:
                by_gap.setdefault(left, []).append(k)
                mask |= 1 << left
        base = (1 << 62) + (int(pdf["grp"].iloc[0]) << 32)
        return pdf.assign(sequence_id=[base + k for k in seq], offset=off, leftover=False).drop(columns=["grp"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1,
    open_windows: int = 48, min_cut: int = 32, merge_tokens: int = 1 << 23, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on demand).

    Null and empty texts are one piece of the end token. Repeated rows are packed each. A null id is carried as null. An
    empty table gives an empty result; other columns are ignored. The last window of each merged group may be short, and
    is then padded (not needed where its length is a power of two).
    """
    kind = PIECE + ", ids array<int>"
    task = _pack_task(tokenizer_path, window, open_windows, min_cut, end_id, with_ids)
    docs = only(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = written(rows.mapInArrow(task, kind), "packing-pieces")
    left = pieces.filter("leftover")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // merge_tokens))
    names = only(pieces, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids").columns
    # What one task left over goes to one group, so a group gets a bounded number of windows from each task dealt to it.
    merged = (
        left.withColumn("grp", F.pmod(F.shiftright("sequence_id", 32), F.lit(groups))).groupBy("grp")
        .applyInPandas(_merge_group(window), kind)
    )
    out = pieces.filter("NOT leftover").select(*names).unionByName(merged.select(*names))
    return out if with_ids else out.drop("ids")
