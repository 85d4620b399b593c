"""LM scoring: a class-based bigram model whose classes come from exchange clustering.

P(word | previous) = P(class | previous class) * P(word | class). All training words take part in the exchange, in two parts.
The HEAD most frequent words move one at a time, each to the class that raises the likelihood most; every other word
stands meanwhile in a bucket of its ending, whose bigrams count as well, so this part is bounded (TYPES squared counts on the
driver). Then every other training word moves, in a distributed step, to the class that its own bigrams with the
classes of the fixed table favour; only words without training counts keep the class of their ending. The class
bigrams are counted again after that. Word counts are never cut and stay distributed.

Texts are tokenised once: each task puts its documents into blocks of about BLOCK_BYTES, a row with the block's distinct
words and its texts as places in them. Counts, contexts and scores are array work on those rows; only the words of
each block are shuffled, one row for a word and block however often it stands there.
"""

from __future__ import annotations

import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import materialize, table

HEAD, ENDINGS, CLASSES, SWEEPS = 512, 256, 48, 8
END = HEAD + ENDINGS
TYPES = END + 1
BLOCK_BYTES = 8_000_000
#: Taken from the count of every seen word, in favour of unseen ones; weight of the class frequencies in a transition.
DISCOUNT, PRIOR = 0.5, 20.0
FOLDS, HELD_OUT = 7, 2
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A block: its words, and packed arrays: of each word its ending and training count, of each text its size, of all texts the places of their words.
BLOCK = "block long, words binary, ending binary, c binary, doc_ids array<long>, train binary, sizes binary, ids binary"
#: A class near a word (see contexts()) and how often.
NEAR = np.dtype([("at", np.uint8), ("c", "<u4")])


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, all first ones, then all second ones and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def ending(word: bytes) -> int:
    """Bucket of a word's last two characters."""
    return zlib.crc32(word.decode("utf-8", "replace")[-2:].encode("utf-8", "replace")) % ENDINGS


class Places(dict):
    """word -> its place in the block; `words` lists them. Place 0 is the text's end."""

    def __init__(self):
        super().__init__()
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each type from the bigram counts of types (the last type is the text's end, a class of its own).

    Types move, one at a time, to the class that raises the likelihood of the class bigram model most.
    """
    n = len(pairs)
    freq = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = np.argsort(-freq[: n - 1], kind="stable")
    of = np.zeros(n, dtype=np.int64)
    of[order] = np.arange(n - 1) % (classes - 1)
    of[n - 1] = classes - 1
    one = np.eye(classes)[of]
    counts = one.T @ pairs @ one
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not freq[w]:
                continue
            k, self_ = of[w], pairs[w, w]
            one[w] = 0
            row, col = pairs[w] @ one, pairs[:, w] @ one  # neighbours other than w itself, by class
            counts[k] -= row
            counts[:, k] -= col
            counts[k, k] -= self_
            out, into = counts.sum(axis=1), counts.sum(axis=0)
            diag = np.arange(classes)
            gain = (f(counts + row) - f(counts)).sum(axis=1) + (f(counts + col[:, None]) - f(counts)).sum(axis=0)
            here = counts[diag, diag]
            gain += f(here + row + col + self_) - f(here) - (f(here + row) - f(here)) - (f(here + col) - f(here))
            gain -= f(out + row.sum() + self_) - f(out) + f(into + col.sum() + self_) - f(into)
            # The totals of the other classes change too: their bigrams with w count whatever its class, so alike for all.
            new = int(np.argmax(gain[: classes - 1]))
            if gain[new] <= gain[k] + 1e-9:
                new = k
            moved += new != k
            of[w] = new
            one[w, new] = 1
            counts[new] += row
            counts[:, new] += col
            counts[new, new] += self_
        if not moved:
            break
    return of


def encode(docs: DataFrame) -> DataFrame:
    """docs(doc_id, train, text) -> BLOCK rows: distinct words with their endings and training counts, and the texts as places in
    them, each closed by place 0. A block holds whole texts; one very long text is a block of its own."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        places, ids, doc_ids, train, held = Places(), [], [], [], 0

        def out():
            sizes = np.array([len(x) for x in ids], dtype=np.int32)
            flat = np.concatenate(ids)
            c = np.bincount(flat[np.repeat(np.array(train, dtype=bool), sizes)], minlength=len(places.words))
            words = zstandard.ZstdCompressor(level=1).compress(b" ".join(places.words))
            ends = np.fromiter(map(ending, places.words), np.int16, len(places.words))
            values = (task << 32) + seq, words, pack(ends), pack(c), doc_ids, pack(np.array(train, dtype=bool)), pack(sizes), pack(flat)
            kinds = pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for d, t, text in zip(part["doc_id"].to_pylist(), part["train"].to_pylist(), part["text"].to_pylist(), strict=True):
                    found = tokens(text)
                    one = np.zeros(len(found) + 1, dtype=np.int32)
                    one[:-1] = np.fromiter(map(places.__getitem__, found), np.int32, len(found))
                    ids.append(one)
                    doc_ids.append(d)
                    train.append(t)
                    held += len(text or "")
                    if held >= BLOCK_BYTES:
                        yield out()
                        places, ids, doc_ids, train, held, seq = Places(), [], [], [], 0, seq + 1
        if ids:
            yield out()

    return docs.select("doc_id", "train", "text").mapInArrow(run, BLOCK)


KINDS = {"ending": np.int16, "c": np.int64, "train": bool, "sizes": np.int32, "ids": np.int32, "k": np.int32}


def array_of(part, name: str) -> np.ndarray:
    """The packed array in a column of a one-row batch."""
    return unpack(part[name][0].as_py(), KINDS[name])


def words_of(part) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(part["words"][0].as_py()).split(b" ")


def training_places(part) -> np.ndarray:
    """Places of all training texts of a block, one text after another, with an end before the first."""
    kept = np.repeat(array_of(part, "train"), array_of(part, "sizes"))
    return np.concatenate(([0], array_of(part, "ids")[kept])).astype(np.int64)


def block_words(blocks: DataFrame) -> DataFrame:
    """block, at, word, c of every word of every block; place 0, the text's end, is left out."""

    def run(batches):
        import pyarrow as pa

        for part in rows_of(batches):
            words, c = words_of(part)[1:], array_of(part, "c")[1:]
            for low in range(0, len(words), 65536):
                some = words[low : low + 65536]
                at = pa.array(np.arange(low + 1, low + 1 + len(some)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.repeat(part["block"][0], len(some)), at, pa.array(some, pa.binary()), pa.array(c[low : low + len(some)])], ["block", "at", "word", "c"])

    return blocks.select("block", "words", "c").mapInArrow(run, "block long, at int, word binary, c long")


def types_of(part, head: list[bytes]) -> np.ndarray:
    """Type of each word of a block: its place in the head, or HEAD and the bucket of its ending; END for the text's end."""
    types = HEAD + array_of(part, "ending").astype(np.int64)
    at = {w: i for i, w in enumerate(head)}
    for i, w in enumerate(words_of(part)):
        if (found := at.get(w)) is not None:
            types[i] = found
    types[0] = END
    return types


def rows_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def type_bigrams(blocks: DataFrame, head: list[bytes]) -> np.ndarray:
    """Counts of neighbouring types over all training texts, each text between two ends."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(TYPES * TYPES, dtype=np.int64)
        for part in rows_of(batches):
            ids = types_of(part, head)[training_places(part)]
            counts += np.bincount(ids[:-1] * TYPES + ids[1:], minlength=TYPES * TYPES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["at", "c"])

    found = blocks.select("words", "ending", "train", "sizes", "ids").mapInArrow(run, "at int, c long").groupBy("at").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(TYPES * TYPES)
    out[found["at"].to_numpy(dtype=np.int64)] = found["c"].to_numpy()
    return out.reshape(TYPES, TYPES)


def contexts(blocks: DataFrame, head: list[bytes], of: np.ndarray) -> DataFrame:
    """word, near (an array of NEAR as bytes), for each block and word outside the head: how often it has a class after it
    (at < CLASSES), before it (at - CLASSES), or itself (2 * CLASSES)."""

    def run(batches):
        import pyarrow as pa

        for part in rows_of(batches):
            types, ids = types_of(part, head), training_places(part)
            cls = of[types]
            rest = np.flatnonzero((types[ids] >= HEAD) & (ids > 0))
            if not len(rest):
                continue
            w, after, before = ids[rest], ids[rest + 1], ids[rest - 1]
            other = before != w
            packed = np.concatenate(((w << 8) + np.where(after == w, 2 * CLASSES, cls[after]), (w[other] << 8) + CLASSES + cls[before[other]]))
            packed, c = np.unique(packed, return_counts=True)
            which, first = np.unique(packed >> 8, return_index=True)
            near = np.empty(len(packed), NEAR)
            near["at"], near["c"] = packed & 255, c
            raw, cuts, words = near.tobytes(), (np.append(first, len(packed)) * NEAR.itemsize).tolist(), words_of(part)
            for low in range(0, len(which), 65536):
                at = which[low : low + 65536].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.binary()), pa.array([raw[cuts[j] : cuts[j + 1]] for j in range(low, low + len(at))], pa.binary())], ["word", "near"])

    return blocks.select("words", "ending", "train", "sizes", "ids").mapInArrow(run, "word binary, near binary")


def best_classes(own: np.ndarray, seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each word that raises the likelihood most, the others staying where `counts` (class bigrams) has them.

    own: the words' classes; seen: their counts (words, 2 * CLASSES + 1), as contexts() numbers them. The gain is that of exchange().
    """
    n, k = len(own), CLASSES
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    row, col, self_ = seen[:, :k], seen[:, k : 2 * k], seen[:, 2 * k]
    here_ = np.arange(n)
    gain = np.zeros((n, k))
    for side, across, table in ((row, col, counts.T), (col, row, counts)):
        w, j = np.nonzero(side)  # only these columns (rows) of the table change
        base = table[j].astype(float)
        x = side[w, j]
        base[np.arange(len(w)), own[w]] -= x
        at_own = j == own[w]
        base[at_own] -= across[w[at_own]]
        base[at_own, j[at_own]] -= self_[w[at_own]]
        np.add.at(gain, w, f(base + x[:, None]) - f(base))
    here = np.repeat(np.diag(counts)[None].astype(float), n, axis=0)
    here[here_, own] -= row[here_, own] + col[here_, own] + self_
    gain += f(here + row + col + self_[:, None]) + f(here) - f(here + row) - f(here + col)
    for side, across, total in ((row, col, counts.sum(axis=1)), (col, row, counts.sum(axis=0))):
        mass = side.sum(axis=1) + self_
        total = total[None] - across
        total[here_, own] -= mass
        gain -= f(total + mass[:, None]) - f(total)
    # All words move at once, and would crowd a class that holds no words yet: the table says nothing about it.
    allowed = (counts.sum(axis=1) + counts.sum(axis=0) > 0)[None] | (np.arange(k)[None] == own[:, None])
    new = np.argmax(np.where(allowed, gain, -np.inf)[:, : k - 1], axis=1)
    return np.where(gain[here_, new] > gain[here_, own] + 1e-9, new, own)


class Chooser:
    """best_classes() with a memory for words that stand once, which differ only in their class and the two around them."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.memo = counts, np.full(CLASSES**3, -1, dtype=np.int64)

    def __call__(self, own: np.ndarray, seen: np.ndarray) -> np.ndarray:
        out = np.empty(len(own), dtype=np.int64)
        once = (seen[:, :CLASSES].sum(axis=1) == 1) & (seen[:, CLASSES : 2 * CLASSES].sum(axis=1) == 1) & (seen[:, 2 * CLASSES] == 0)
        more = np.flatnonzero(~once)
        for low in range(0, len(more), 4096):
            at = more[low : low + 4096]
            out[at] = best_classes(own[at], seen[at], self.counts)
        at = np.flatnonzero(once)
        code = (own[at] * CLASSES + seen[at, :CLASSES].argmax(axis=1)) * CLASSES + seen[at, CLASSES : 2 * CLASSES].argmax(axis=1)
        new, first = np.unique(code, return_index=True)
        lacking = self.memo[new] < 0
        new, first = new[lacking], at[first[lacking]]
        for low in range(0, len(new), 4096):
            part = first[low : low + 4096]
            self.memo[new[low : low + 4096]] = best_classes(own[part], seen[part], self.counts)
        out[at] = self.memo[code]
        return out


def rest_classes(found: DataFrame, of: np.ndarray, counts: np.ndarray) -> DataFrame:
    """word, k of contexts(): the class of every training word outside the head, by its own bigrams against the fixed class table."""

    def run(batches):
        import pyarrow as pa

        choose, last, waiting = Chooser(counts), None, None

        def out(words, seen):
            own = of[HEAD + np.array([ending(w) for w in words])]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(choose(own, seen).astype(np.int32))], ["word", "k"])

        for batch in batches:
            for low in range(0, batch.num_rows, 16384):
                part = batch.slice(low, 16384)
                words = part["word"].to_pylist()
                new = np.array([a != b for a, b in zip(words, [last, *words[:-1]], strict=True)])
                group = np.cumsum(new) - new[0]
                seen = np.zeros((group[-1] + 1, 2 * CLASSES + 1))
                raw = part["near"].to_pylist()
                near = np.frombuffer(b"".join(raw), NEAR)
                cell = np.repeat(group, [len(x) // NEAR.itemsize for x in raw]) * seen.shape[1] + near["at"]
                seen += np.bincount(cell, near["c"], seen.size).reshape(seen.shape)
                if not new[0]:
                    seen[0] += waiting
                names = [w for w, n in zip(words, new, strict=True) if n]
                if last is not None and new[0]:
                    yield out([last], waiting[None])
                elif last is not None:
                    names = [last, *names]
                if len(names) > 1:
                    yield out(names[:-1], seen[:-1])
                last, waiting = names[-1], seen[-1]
        if last is not None:
            yield out([last], waiting[None])

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, k int")


def type_classes(counts: DataFrame, head: list[bytes], of: np.ndarray) -> DataFrame:
    """counts(word, c, k) with a class for every word: that of its type where k is null."""

    def run(batches):
        import pyarrow as pa

        at = {w: i for i, w in enumerate(head)}
        for batch in batches:
            k = [of[at[w] if w in at else HEAD + ending(w)] if k is None else k for w, k in zip(batch["word"].to_pylist(), batch["k"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(k, pa.int32())], ["word", "c", "k"])

    return counts.select("word", "c", "k").mapInArrow(run, "word binary, c long, k int")


def with_classes(blocks: DataFrame, dictionary: DataFrame, end: tuple[int, int]) -> DataFrame:
    """The blocks' texts with arrays c and k of their words, from dictionary(block, at, c, k); `end`: c and k of the text's end."""

    def run(key, part, words):
        import pyarrow as pa

        at = words["at"].to_numpy()
        c, k = np.full(len(at) + 1, end[0], dtype=np.int64), np.full(len(at) + 1, end[1], dtype=np.int32)
        c[at], k[at] = words["c"].to_numpy(), words["k"].to_numpy()
        return part.append_column("c", pa.array([pack(c)], pa.binary())).append_column("k", pa.array([pack(k)], pa.binary()))

    texts = blocks.select("block", "doc_ids", "train", "sizes", "ids")
    schema = "block long, doc_ids array<long>, train binary, sizes binary, ids binary, c binary, k binary"
    return texts.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(run, schema)


def class_bigrams(classed: DataFrame) -> np.ndarray:
    """Counts of neighbouring classes over all training texts of with_classes()."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for part in rows_of(batches):
            ids = array_of(part, "k").astype(np.int64)[training_places(part)]
            counts += np.bincount(ids[:-1] * CLASSES + ids[1:], minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES * CLASSES), pa.int32()), pa.array(counts)], ["at", "c"])

    out = np.zeros(CLASSES * CLASSES)
    for r in classed.select("train", "sizes", "ids", "k").mapInArrow(run, "at int, c long").groupBy("at").agg(F.sum("c").alias("c")).collect():
        out[r["at"]] = r["c"]
    return out.reshape(CLASSES, CLASSES)


class Model:
    """What a fit leaves: the blocks' texts with counts and classes, the words' (word, c, k), and the tables of the classes."""

    def __init__(self, docs: DataFrame):
        train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT
        docs = docs.select("doc_id", "text", train.alias("train"))
        self.n_texts = n_texts = docs.agg(F.sum(F.col("train").cast("long")).alias("t")).first()["t"] or 0
        blocks = materialize(encode(docs))
        local = block_words(blocks)
        counts = materialize(local.groupBy("word").agg(F.sum("c").alias("c")))
        sums = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
        self.n_train, self.vocabulary = (sums["n"] or 0) + n_texts, (sums["v"] or 0) + (n_texts > 0)
        head = [bytes(r["word"]) for r in counts.where("c > 0").orderBy(F.col("c").desc(), "word").limit(HEAD).collect()]
        pairs = type_bigrams(blocks, head)
        of = exchange(pairs)
        one = np.eye(CLASSES)[of]
        rest = rest_classes(contexts(blocks, head, of), of, one.T @ pairs @ one)
        self.words = words = materialize(type_classes(counts.join(rest, "word", "left"), head, of))
        self.end = end = int(of[END])
        self.classed = materialize(with_classes(blocks, local.select("block", "at", "word").join(words, "word").select("block", "at", "c", "k"), (n_texts, end)))
        moves = class_bigrams(self.classed)
        self.class_total, self.class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in words.groupBy("k").agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).collect():
            self.class_total[r["k"]], self.class_distinct[r["k"]] = r["n"], r["v"]
        self.class_total[end] += n_texts
        self.class_distinct[end] += min(1, n_texts)
        share = self.class_total / max(self.class_total.sum(), 1)
        with np.errstate(divide="ignore"):
            log_move = np.log10((moves + PRIOR * share) / (moves.sum(axis=1, keepdims=True) + PRIOR)) if n_texts else np.zeros((CLASSES, CLASSES))
        self.log_move = np.maximum(log_move, -12.0)

    def tables(self):
        return self.log_move, self.class_total, self.class_distinct, self.n_train, self.vocabulary, self.end


def emissions(c: np.ndarray, k: np.ndarray, class_total, class_distinct, n_train: int, vocabulary: int) -> np.ndarray:
    """log10 of the probability of words with counts c in their classes k: discounted counts; the rest of a class is for its unseen words."""
    n, v = np.maximum(class_total[k], 1), class_distinct[k]
    p = np.where(c > 0, np.maximum(c - DISCOUNT, 1e-9) / n, np.where(v > 0, DISCOUNT * v / n / (v + 1), 1 / (n_train + vocabulary + 1)))
    return np.log10(np.minimum(p, 1.0))


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id counts as an empty text). A null
    or empty text is the end token alone. Where nothing can be learned every token has probability 1. Repeated rows count as
    often as they stand; among equal words the first by bytes is in the head, among equal gains the first class is taken.
    Other columns are ignored; an empty table gives no rows.
    """
    model = Model(docs)
    held = docs.sparkSession.sparkContext.broadcast(model.tables())

    def run(batches):
        import pyarrow as pa

        log_move, class_total, class_distinct, n_train, vocabulary, end = held.value
        for part in rows_of(batches):
            c, k, ids, sizes = (array_of(part, x) for x in ("c", "k", "ids", "sizes"))
            base = np.log10((c + 1) / (n_train + vocabulary + 1))
            emit = emissions(c, k, class_total, class_distinct, n_train, vocabulary)
            here = k[ids]
            before = np.concatenate(([end], here[:-1]))  # the token before a text's first is the end of another
            starts = np.cumsum(sizes, dtype=np.int64) - sizes
            add = lambda x: np.add.reduceat(x, starts)  # noqa: E731,B023
            values = part["doc_ids"].flatten(), pa.array(~array_of(part, "train")), pa.array(sizes, pa.int64()), pa.array(add((c[ids] > 0).astype(np.int64))), pa.array(np.full(len(sizes), n_train), pa.int64()), pa.array(add(base[ids])), pa.array(add(emit[ids] + log_move[before, here]))
            yield pa.RecordBatch.from_arrays(list(values), ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return model.classed.select("doc_ids", "train", "sizes", "ids", "c", "k").mapInArrow(run, schema)


def op7_brown(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
