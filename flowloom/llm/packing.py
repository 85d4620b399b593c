"""Best-fit packing of token sequences by exact complements.

Pieces of equal length are interchangeable, so the plan is made from the histogram of lengths (at most `length` rows, whatever the
number of documents): patterns of lengths, each with the number of sequences that follow it. The longest piece left opens a pattern;
single lengths, sums of pairs and sums of triples are indexed as bit sets over the lengths still available, and a combination that
fills the gap exactly closes it. Where none does, the piece that fits best goes in and the smaller gap is looked up again. A
pattern is used as often as the counts of its lengths allow, so every pattern uses up a length or nearly so.

Spark then numbers the pieces of each length: a running number inside a task, plus the counts of the tasks before, so no length,
however common, meets in one task. The number picks the pattern, the sequence and the place in it.

Texts are tokenised in Arrow batches. The tokenizer splits at white space and its normaliser never acts across a space, so
a text's ids are those of its stretches between spaces and line ends, and each stretch is tokenised once for a worker's bounded memo.

Defined cases: a null or empty text has no ids but the closing one; a document too long for one sequence is cut into full pieces and a
last one that may be shorter; rows that repeat a doc_id, or have none, are documents of their own; an empty table gives no rows;
other columns are not read. Very long texts cost their ids once, as one row at a time is tokenised.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import materialize, table

#: Tokens of a sequence at most, and the id that ends each document.
LENGTH, END = 2048, 0
#: Stretches, and words of them, that a Python worker remembers before it starts over, and the longest stretch that it remembers.
MEMO, MEMO_CHARS = 500_000, 40
STEP = 256


#: Stretches that are lower-cased and split here, by rule, before the model: no character is composed, none of the contractions or special tokens occur.
PLAIN = re.compile("[!-&(-;=-{}~\xa1-\u012f]+")
#: The tokenizer's own split of such a stretch.
SPLIT = r"\p{L}+|\p{N}|[^\p{L}\p{N}]+"
#: Characters that stand for bytes in the vocabulary: printable ones of Latin-1 for themselves, the others from 256 on.
_own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTES = {b: b if b in _own else 256 + i - sum(x < b for x in _own) for i, b in enumerate(range(256))}


class Memo(dict):
    """A stretch of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, described: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_str(described), regex.compile(SPLIT).findall
        self.model, self.words = self.tokenizer.model, {}

    def word(self, word: str) -> bytes:
        """Ids of one word: the model's, without the tokenizer's costlier steps before it."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
        packed = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self.words) >= MEMO:
            self.words.clear()
        self.words[word] = packed
        return packed

    def __missing__(self, stretch: str) -> bytes:
        if len(stretch) <= MEMO_CHARS and PLAIN.fullmatch(stretch):
            words = self.words
            packed = b"".join([words.get(w) or self.word(w) for w in self.split(stretch.lower())])
        else:
            packed = array("I", self.tokenizer.encode(stretch, add_special_tokens=False).ids).tobytes()
        if len(stretch) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[stretch] = packed
        return packed


_memo: dict[str, Memo] = {}


def memo_of(described: str) -> Memo:
    """The memo of a Python worker, which outlives a task."""
    if described not in _memo:
        _memo.clear()
        _memo[described] = Memo(described)
    return _memo[described]


def stretches(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def pieces(docs: DataFrame, described: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit integers).

    `described` is a tokenizer's JSON text: of a fixed size, sent to the executors, which need not hold the file.
    """
    sent = docs.sparkSession.sparkContext.broadcast(described)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import pyarrow as pa

        memo, last = memo_of(sent.value), np.array([end], "<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                cut = [stretches(t or "") for t in part["text"].to_pylist()]
                out: list[list] = [[], [], [], [], [], []]
                for doc, own in zip(part["doc_id"].to_pylist(), cut, strict=True):
                    ids = b"".join(map(memo.__getitem__, own)) + last
                    for i, at in enumerate(range(0, len(ids), 4 * length)):
                        piece = ids[at : at + 4 * length]
                        for c, x in zip(out, (doc, i, at // 4, len(piece) // 4, zlib.crc32(piece), piece), strict=True):
                            c.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


class Lengths:
    """Counts of the lengths that are left, and the index of their single, pair and triple sums."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
        self.refresh()

    def refresh(self) -> None:
        """Bit s of `pairs` is set if two pieces that are left sum to s."""
        self.left = {n: c for n, c in self.left.items() if c}
        self.all = list(self.left)
        have = sum(1 << n for n in self.all)
        self.pairs = 0
        for n, c in self.left.items():
            self.pairs |= (have if c > 1 else have & ~(1 << n)) << n
        self.most = self.all[0] if self.all else 0

    def pair(self, total: int, besides: int = 0) -> list[int] | None:
        """The most uneven two lengths that sum to `total`, while one piece of length `besides` is in use."""
        if total <= 0 or not self.pairs >> total & 1:
            return None
        free = lambda n: self.left.get(n, 0) - (n == besides)
        for n in self.all:
            if 2 * n < total:
                return None
            if n < total and free(n) > 0 and free(total - n) > (2 * n == total):
                return [n, total - n]
        return None

    def filling(self, gap: int) -> list[int] | None:
        """One, two or three lengths that fill a gap exactly."""
        if self.left.get(gap, 0):
            return [gap]
        if gap > 3 * self.most:
            return None
        if found := self.pair(gap):
            return found
        for n in self.all:
            if 3 * n < gap:
                return None
            if n < gap and self.left[n] > 0 and (rest := self.pair(gap - n, n)):
                return [n, *rest]
        return None

    def fitting(self, gap: int) -> int | None:
        """The longest piece that fits: it leaves the smallest gap."""
        return next((n for n in self.all if n <= gap and self.left[n] > 0), None)


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns that use all counted lengths: (number of sequences, [(length of a piece, pieces side by side), ...])."""
    lengths, out = Lengths(counts), []
    while lengths.all:
        own, gap = [], length
        while gap:
            found = lengths.filling(gap) if own or lengths.most == gap else [lengths.most]
            if found is None:
                found = [best] if (best := lengths.fitting(gap)) else []
            if not found:
                break
            for n in found:
                lengths.left[n] -= 1
            own += found
            gap -= sum(found)
        used = Counter(own)
        more = min(lengths.left[n] // m for n, m in used.items())
        for n, m in used.items():
            lengths.left[n] -= more * m
        lengths.refresh()
        out.append((1 + more, [(n, len(list(g))) for n, g in groupby(sorted(own, reverse=True))]))
    return out


def runs(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as runs of numbered pieces of a length: from number `first` on, `side` pieces for each sequence, from `sequence` and `offset` on.

    Sorted by length and first number; `key` holds both.
    """
    rows, given, sequence = [], Counter(), 0
    for times, parts in patterns:
        offset = 0
        for n, side in parts:
            rows.append((n, given[n], sequence, offset, side))
            given[n] += times * side
            offset += n * side
        sequence += times
    rows.sort()
    names = ("length", "first", "sequence", "offset", "side")
    out = {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}
    return out | {"key": (out["length"] << 44) + out["first"]}


def pack(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to `length`: gapless, at most `length` in a sequence.

    Columns named part, local and before are taken by the operator; the rows are written once on the way.
    """
    names = found.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, given = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            own = batch["length"].to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            ranked = own[order]
            fresh = np.flatnonzero(np.diff(ranked, prepend=-1))
            local = np.empty(len(own), np.int64)
            local[order] = np.arange(len(own)) - np.repeat(fresh, np.diff([*fresh, len(own)])) + given[ranked]
            given += np.bincount(own, minlength=length + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(local)], [*batch.schema.names, "part", "local"])

    rows = materialize(found.mapInArrow(number, f"{schema}, part int, local long"))
    counts = materialize(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    planned = found.sparkSession.sparkContext.broadcast(runs(plan(histogram, length)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")).hint("merge"), ["part", "length"]).select(*names, "local", "before")

    def place(batches):
        import pyarrow as pa

        p = planned.value
        for batch in batches:
            number = batch["local"].to_numpy(zero_copy_only=False) + batch["before"].to_numpy(zero_copy_only=False)
            own = batch["length"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(p["key"], (own << 44) + number, side="right") - 1
            number, side = number - p["first"][at], p["side"][at]
            kept = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p["sequence"][at] + number // side), pa.array(p["offset"][at] + number % side * own)], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        described = f.read()
    return pack(pieces(table(spark, sf_dir, "documents"), described).drop("ids"))
