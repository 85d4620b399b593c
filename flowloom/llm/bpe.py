"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern; each distinct word of a task is a byte array into which the
ranked merges are folded once, and the ids are kept in a bounded memo. Decoding concatenates the binary
pieces. Both run on Arrow batches and never shuffle. The rank map has a fixed size (one vocabulary file)
and goes to the executors as a broadcast variable, so they need not hold the file.
"""

from __future__ import annotations

import base64
import heapq
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import table

#: Words a task remembers at most before it starts over, and the longest word (bytes) it remembers.
MEMO_WORDS, MEMO_BYTES = 200_000, 64
#: Words above so many bytes are merged with a heap instead of repeated scans.
SCAN_BYTES = 96
#: Texts of an Arrow batch handled at once, in rows.
STEP = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold: the leftmost pair of least rank merges, until no neighbouring pair has a rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for long words, in n log n: live parts in a linked list, pairs in a heap by rank and place."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return merge_scan(word, ranks) if len(word) <= SCAN_BYTES else merge_heap(word, ranks)


class Memo(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = encode_word(raw, self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = packed
        return packed


def _schema(df: DataFrame, drop: str, field: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != drop]
    return ", ".join([*kept, f"{drop} {field}"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds `ids_col` (binary: ids as little-endian unsigned 32-bit integers); a column of that name is replaced.

    A null or empty text has no ids. Every row keeps its other columns. Rows that repeat a text get the same ids, an empty table gives no
    rows. A very long text is encoded whole: its words one after the other, a very long word by a heap.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    docs = docs.drop(ids_col)

    def run(batches):
        import pyarrow as pa
        import regex

        split, memo = regex.compile(pattern).findall, Memo(ranks.value)
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                ids = [b"".join(map(memo.__getitem__, split(t or ""))) for t in part[text_col].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, ids_col])

    return docs.mapInArrow(run, _schema(docs, ids_col, "binary"))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds `bytes_col` (binary): the pieces of the ids, concatenated. Null ids decode to no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    encoded = encoded.drop(bytes_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        piece = {r: b for b, r in ranks.value.items()}.__getitem__
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                texts = [b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())) for x in part[ids_col].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, bytes_col])

    return encoded.mapInArrow(run, _schema(encoded, bytes_col, "binary"))


def vocabulary():
    """Path and pattern of the vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text"), path)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
