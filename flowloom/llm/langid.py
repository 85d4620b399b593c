"""Language identification: a linear-chain conditional random field over the words of a text.

Every word is labelled by forward-backward, so a text that switches languages is labelled piece by piece; a
document gets the label with the largest mean marginal. Features: the word, its affixes, its character
trigrams and the lexicons of the languages, hashed; transitions between labels are learned with them.

The field is fitted on the driver on a bounded sample of labelled rows: at most DOCS_PER_LANG documents of each
language, chosen by a hash of id and text, cut into chains of WINDOW words, of which CHAINS_PER_LANG are taken at most. The gradient is the exact one of the
log-likelihood: single and pair marginals come from the same forward and backward messages.
Prediction covers all words of all documents and needs no shuffle. Long texts are cut into chunks whose transfer matrices
are computed side by side and then chained, which gives the exact marginals of the whole chain.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import table

DOCS_PER_LANG, WINDOW = 120, 24
#: Chains of each language at most: a few long texts don't outgrow the driver.
CHAINS_PER_LANG = 4000
HASHED = 1 << 16
EPOCHS, RATE, DECAY = 40, 0.5, 1e-4
CHUNK = 32
#: Steps after which states are brought back to scale.
SCALE = 8
#: Words handled at once and words remembered by a task, about.
STEP_WORDS, MEMO_WORDS = 60_000, 200_000
FOLDS = 5
UNKNOWN = "und"
PUNCTUATION = ".,;:!?\"'()[]{}|*#$%&<>"


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def plain(word: bytes) -> bytes:
    """Lower case without punctuation around it; empty if the word has no letter."""
    text = word.decode("utf-8", "replace").lower()
    return text.strip(PUNCTUATION).encode("utf-8", "surrogatepass") if text.isalpha() or has_letter(text) else b""


def features(words: list[bytes], lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of the words: (feature, index of its word) pairs, and which words have a letter.

    The word itself, its affixes of one to four bytes, its byte trigrams between marks, and its lexicon.
    """
    texts = [plain(w) for w in words]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    lettered = size > 0
    raw = np.frombuffer(b"^" + b"$^".join(texts) + b"$  ", dtype=np.uint8).astype(np.uint32)
    start = np.cumsum(size + 2) - size - 2  # of each word's opening mark
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(owner)) + 2 * owner  # trigrams begin at the mark and at all bytes but the last
    place = [raw[at] * np.uint32(0x9E3779B1) + raw[at + 1] * np.uint32(0x85EBCA77) + raw[at + 2] * np.uint32(0xC2B2AE3D)]
    owners = [owner]
    ahead, behind = np.zeros(len(words), dtype=np.uint32), np.zeros(len(words), dtype=np.uint32)
    for k in range(1, 5):
        long = np.flatnonzero(size >= k)
        ahead[long] = ahead[long] * np.uint32(0x01000193) + raw[start[long] + k] + np.uint32(k)
        behind[long] = behind[long] * np.uint32(0x01000193) + raw[start[long] + 1 + size[long] - k] + np.uint32(k)
        place += [ahead[long] + np.uint32(0x1000 + k), behind[long] * np.uint32(0x27D4EB2F) + np.uint32(0x2000 + k)]
        owners += [long, long]
    whole = np.flatnonzero(lettered)
    place.append(np.array([zlib.crc32(texts[i]) for i in whole], dtype=np.uint32))
    owners.append(whole)
    known = [(i, lang) for i in whole.tolist() if (lang := lexicon.get(texts[i])) is not None]
    place.append(np.array([0x3000 + lang for _, lang in known], dtype=np.uint32))
    owners.append(np.array([i for i, _ in known], dtype=np.int64))
    h = np.concatenate(place)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return ((h ^ (h >> np.uint32(15))) % np.uint32(HASHED)).astype(np.int64), np.concatenate(owners), lettered


class Numbers(dict):
    """word -> its number by first sight; `new` holds the words numbered since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Field:
    """Weights of a fitted field: labels, emissions by hashed feature, transitions, lexicon."""

    def __init__(self, labels, lexicon):
        self.labels, self.lexicon = list(labels), lexicon
        self.weight = np.zeros((HASHED, len(self.labels)))
        self.move = np.zeros((len(self.labels), len(self.labels)))

    def emissions(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the words by label, and whether a word has a letter."""
        flat, owner, lettered = features(words, self.lexicon)
        return self.sums(flat, owner, len(words)), lettered

    def sums(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Weights of each word's features, added up and scaled by the root of their number."""
        held = self.weight[flat]
        size = np.bincount(owner, minlength=n)
        total = np.stack([np.bincount(owner, held[:, k], n) for k in range(held.shape[1])], axis=1) if held.shape[1] else np.zeros((n, 0))
        return total / np.sqrt(np.maximum(size, 1))[:, None]


def marginals(scores: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Exact label marginals of several chains. scores: all words of all chains, one after another; sizes: words of each (above 0)."""
    n_labels = scores.shape[1]
    step = np.exp(move - move.max())
    chunks = -(-sizes // CHUNK)
    first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    chain = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = first[chain] + inside // CHUNK, inside % CHUNK
    total = int(chunks.sum())
    seen, there = np.ones((total, CHUNK, n_labels)), np.zeros((total, CHUNK), dtype=bool)
    seen[row, col] = np.exp(scores - scores.max(axis=1, keepdims=True))
    there[row, col] = True
    seen[first, 0] /= step.mean(axis=0)  # no move leads to a chain's first word: this undoes the one from `into`
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    short = np.flatnonzero(~there[:, -1])  # the last chunks of chains: they stop early
    carry = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    flat = carry.reshape(-1, n_labels)
    for t in range(CHUNK):
        rest = short[~there[short, t]]
        kept = carry[rest]
        np.multiply((flat @ step).reshape(carry.shape), seen[:, t, None, :], out=carry)
        if t % SCALE == SCALE - 1:
            carry /= carry.max(axis=(1, 2), keepdims=True)
        carry[rest] = kept
    into, out = np.full((total, n_labels), 1 / n_labels), np.full((total, n_labels), 1 / n_labels)
    order = np.argsort(-chunks, kind="stable")
    falling = -chunks[order]
    for j in range(1, int(chunks.max(initial=0))):
        now = first[order[: np.searchsorted(falling, -j, side="left")]] + j  # chains with more than j chunks
        into[now] = norm(np.einsum("ka,kab->kb", into[now - 1], carry[now - 1]))
    last = first + chunks - 1
    for j in range(1, int(chunks.max(initial=0))):
        now = last[order[: np.searchsorted(falling, -j, side="left")]] - j
        out[now] = norm(np.einsum("kab,kb->ka", carry[now + 1], out[now + 1]))
    ahead = np.empty((CHUNK, total, n_labels))
    state = into
    for t in range(CHUNK):  # behind a short chunk's end the states aren't read
        state = (state @ step) * seen[:, t]
        if t % SCALE == SCALE - 1:
            state /= state.max(axis=1, keepdims=True)
        ahead[t] = state
    state, back = out, step.T.copy()
    for t in range(CHUNK - 1, -1, -1):
        ahead[t] *= state
        rest = short[~there[short, t]]
        kept = state[rest]
        state = (state * seen[:, t]) @ back
        if t % SCALE == 0:
            state /= state.max(axis=1, keepdims=True)
        state[rest] = kept
    return norm(ahead[col, row])


def expected(scores: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of short chains: label marginals of the words, the expected number of each move between neighbours, and the log of the
    partition function, summed over the chains."""
    n_labels, longest = scores.shape[1], int(sizes.max(initial=0))
    step = np.exp(move)
    chain = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seen, there = np.ones((longest, len(sizes), n_labels)), np.zeros((longest, len(sizes), 1), dtype=bool)
    top = scores.max(axis=1, keepdims=True)
    seen[at, chain], there[at, chain] = np.exp(scores - top), True
    ahead, back, log_z = np.empty_like(seen), np.ones_like(seen), float(top.sum())
    for t in range(longest):
        state = seen[t] if t == 0 else (ahead[t - 1] @ step) * seen[t]
        total = state.sum(axis=1, keepdims=True)
        log_z += float(np.log(total[there[t]]).sum())
        ahead[t] = state / total
    joint = np.zeros((n_labels, n_labels))
    for t in range(longest - 1, 0, -1):
        after = seen[t] * back[t] * there[t]
        mass = np.einsum("ca,ab,cb->c", ahead[t - 1], step, after)[:, None]
        after = after / np.where(mass > 0, mass, 1)
        joint += step * (ahead[t - 1].T @ after)
        back[t - 1] = np.where(there[t], after @ step.T, 1.0)
    p = ahead[at, chain] * back[at, chain]
    return p / p.sum(axis=1, keepdims=True), joint, log_z


def fit(windows: list[tuple[str, list[bytes]]], seed: int = 5) -> Field:
    """A field from (label, words) windows. A part of them is spliced with a window of another label, so that switches are seen."""
    labels = sorted({lang for lang, _ in windows})
    at = {lang: i for i, lang in enumerate(labels)}
    counts: dict[bytes, Counter] = defaultdict(Counter)
    for lang, words in windows:
        for w in words:
            counts[plain(w)][lang] += 1
    lexicon = {w: at[c.most_common(1)[0][0]] for w, c in counts.items() if w and sum(c.values()) >= 4 and c.most_common(1)[0][1] >= 0.8 * sum(c.values())}
    field = Field(labels, lexicon)
    if len(labels) < 1:
        return field
    rng = np.random.default_rng(seed)
    chains = []
    for lang, words in windows:
        gold = [at[lang]] * len(words)
        if rng.random() < 0.3:
            other, more = windows[rng.integers(len(windows))]
            k, m = len(words) // 2, len(more) // 2
            words, gold = words[:k] + more[m:], gold[:k] + [at[other]] * (len(more) - m)
        if words:
            chains.append((words, gold))
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for words, _ in chains for w in words])
    gold = np.array([g for _, gs in chains for g in gs])
    sizes = np.array([len(w) for w, _ in chains])
    flat, owner, used = features(list(index), lexicon)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(index)), 1))[:, None]
    n_labels = len(labels)
    hot = np.eye(n_labels)[gold]
    inner = np.ones(len(ids), dtype=bool)
    inner[np.cumsum(sizes) - sizes] = False
    pairs = np.flatnonzero(inner)
    squares, move_squares = np.full((HASHED, n_labels), 1e-8), np.full((n_labels, n_labels), 1e-8)
    lettered = used[ids][:, None]
    for _ in range(EPOCHS):
        here = field.sums(flat, owner, len(index))[ids]
        p, joint, _ = expected(here, sizes, field.move)
        add = lambda i, x, n: np.stack([np.bincount(i, x[:, k], n) for k in range(n_labels)], axis=1)
        by_word = add(ids, (hot - p) * lettered, len(index))
        g = add(flat, (by_word * scale)[owner], HASHED)
        g -= DECAY * len(ids) * field.weight / 100
        squares += g * g
        field.weight += RATE * g / np.sqrt(squares)
        m = (hot[pairs - 1].T @ hot[pairs]) - joint
        m -= DECAY * len(ids) * field.move
        move_squares += m * m
        field.move += RATE * 0.2 * m / np.sqrt(move_squares)
    return field


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a label, a text, and crc32(doc_id as text) mod 5 above 0."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 0))


def remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chains_per_lang: int = CHAINS_PER_LANG) -> Field:
    """Fits a field on at most docs_per_lang labelled documents of each language, and chains_per_lang chains of their words; docs has doc_id, text, lang.

    A document is an id with a text, so rows that repeat one count once, and rows of one id with different texts are different documents.
    Documents, and chains where the texts are long, are chosen by hashes.
    """
    place = F.xxhash64("doc_id", "text", F.lit("langid")).bitwiseAND(F.lit((1 << 40) - 1))
    rows = training_rows(docs).select("lang", "text", place.alias("place"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()}
    # Twice as many as asked for pass the first, coarse choice, so that the exact one sorts few.
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (2 * docs_per_lang + 20) / max(n, 1)))).otherwise(share)
    near = rows.where(F.col("place") / F.lit(float(1 << 40)) <= share).dropDuplicates(["lang", "place"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = near.withColumn("n", first).where(F.col("n") <= docs_per_lang).select("lang", "text", "place")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            langs, windows, at = [], [], []
            for lang, text, place in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), batch["place"].to_pylist(), strict=True):
                words = text.encode().split()
                for s in range(0, len(words), WINDOW):
                    langs.append(lang)
                    windows.append(words[s : s + WINDOW])
                    at.append(place + s)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.list_(pa.binary())), pa.array(at, pa.int64())], ["lang", "words", "at"])

    chains = chosen.mapInArrow(cut, "lang string, words array<binary>, at long")
    some = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("at"), "at", "words"))
    taken = chains.withColumn("n", some).where(F.col("n") <= chains_per_lang).select("lang", "words").collect()
    return fit(sorted((r["lang"], [bytes(w) for w in r["words"]]) for r in taken))


class Labeller:
    """A fitted field at work in a task: it remembers the scores of words it has met."""

    def __init__(self, field: Field):
        self.field, self.n_labels = field, len(field.labels)
        self.forget()

    def forget(self) -> None:
        self.memo, self.scores, self.letters = Numbers(), np.zeros((0, self.n_labels)), np.zeros(0, dtype=bool)

    def __call__(self, texts):
        """Of the texts with a letter: their places, numbers of words, and of all their words the marginals and whether they have a letter."""
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        ids = [np.fromiter(map(self.memo.__getitem__, ws), np.int64, len(ws)) for ws in words]
        if self.memo.new:
            s, has = self.field.emissions(self.memo.new)
            self.scores, self.letters = np.concatenate((self.scores, s)), np.concatenate((self.letters, has))
            self.memo.new = []
        live = [i for i, x in enumerate(ids) if self.n_labels and len(x) and self.letters[x].any()]
        if not live:
            return [], np.zeros(0, dtype=np.int64), np.zeros((0, self.n_labels)), np.zeros(0, dtype=bool)
        flat, sizes = np.concatenate([ids[i] for i in live]), np.array([len(ids[i]) for i in live])
        return live, sizes, marginals(self.scores[flat], sizes, self.field.move), self.letters[flat]


def portions(batches, text_col: str):
    """Slices of the batches with about STEP_WORDS words each, one text at least, and their texts."""
    for batch in batches:
        texts, low = batch[text_col].to_pylist(), 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size < STEP_WORDS * 6):
                size += len(texts[high] or "")
                high += 1
            yield batch.slice(low, high - low), texts[low:high]
            low = high


def predict(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Adds lang_pred (string), score (double) and lang_shares (array of mean marginals, in the order of field.labels).

    `und` and score 0 for a text that is null or has no letter. Among equal shares the first label by code points wins.
    Other columns stay; those of these names are replaced. One very long text is handled whole, with some 100 bytes
    for each of its words and labels. An empty table gives no rows; repeated rows get equal results.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    docs = docs.drop("lang_pred", "score", "lang_shares")
    names = [*docs.columns, "lang_pred", "score", "lang_shares"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double, lang_shares array<double>"])

    def run(batches):
        import pyarrow as pa

        label = Labeller(held.value)
        for part, texts in portions(batches, text_col):
            got = [(UNKNOWN, 0.0, [0.0] * label.n_labels)] * len(texts)
            live, sizes, p, letters = label(texts)
            if live:
                starts = np.cumsum(sizes) - sizes
                share = np.add.reduceat(p * letters[:, None], starts, axis=0) / np.add.reduceat(letters.astype(float), starts)[:, None]
                for i, b, x in zip(live, share.argmax(axis=1), share, strict=True):
                    got[i] = (label.field.labels[b], float(min(1.0, x[b])), x.tolist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.float64()))], names)

    return docs.mapInArrow(run, schema)


def label_words(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Adds lang_runs: array of struct(start, end, lang), runs of words (end exclusive) with one most probable label.

    Words without letters take part in their chain. A text that is null or has no letter has no runs; a column of this name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    docs = docs.drop("lang_runs")
    names = [*docs.columns, "lang_runs"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_runs array<struct<start:int,end:int,lang:string>>"])

    def run(batches):
        import pyarrow as pa

        label, kind = Labeller(held.value), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for part, texts in portions(batches, text_col):
            runs = [[] for _ in texts]
            live, sizes, p, _ = label(texts)
            best = p.argmax(axis=1) if live else []
            for i, low, n in zip(live, np.cumsum(sizes) - sizes, sizes, strict=True):
                own = best[low : low + n]
                cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), int(n)]
                runs[i] = [{"start": a, "end": b, "lang": label.field.labels[own[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(runs, kind)], names)

    return docs.mapInArrow(run, schema)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = learn(docs)
    return predict(docs.select("doc_id", "text"), field).select("doc_id", (remainder() == 0).alias("held_out"), "lang_pred", "score", "lang_shares")
