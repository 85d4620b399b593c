"""Product codes, packing and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import codes, packing, search

# Product codes


def codes_by_hand(rows, rounds=6, parts=8, entries=16):
    """rows: (vec_id, vector) in order of id -> [(code, error)], codebooks."""
    kept = [[math.floor(4096 * float(x)) for x in v] for _, v in rows]
    w = len(kept[0]) // parts
    cut = [[v[i * w : (i + 1) * w] for i in range(parts)] for v in kept]
    ids, seeds = set(), []
    for (i, _), v in zip(rows, cut, strict=True):
        if i is not None and i not in ids and len(seeds) < entries:
            ids.add(i)
            seeds.append(v)
    books = [[list(s[i]) for s in seeds] for i in range(parts)]

    def assign():
        out = []
        for v in cut:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[i], c, strict=True)), e) for e, c in enumerate(books[i])) for i in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for i in range(parts):
            for e in range(len(seeds)):
                own = [v[i] for v, f in zip(cut, found, strict=True) if f[i][1] == e]
                if own:
                    books[i][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in assign()], books


VECTORS = "vec_id long, embedding array<float>, label int, code string, block long"


def test_codes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_BYTES", 16 * 4 * 7)  # several blocks, also in one task
    rng = np.random.default_rng(7)
    fine = [(i, [float(x) for x in np.float32(rng.normal(size=16) * (0.1 + i % 3))], i % 4 or None) for i in range(90)]
    fine += [(3, fine[3][1], 0), (5, [9.0] * 16, 1), (None, fine[8][1], None), (500, [2e9] * 8 + [-2e9] * 8, 2)]
    odd = [(600, None, 1), (601, [], 1), (602, [1.0] * 15, 1), (603, [1.0] * 24, 1), (604, [None, *[1.0] * 15], 1), (605, [float("nan")] * 16, 1), (606, [float("inf")] * 16, 1)]
    rows = [(*r, "x", 1) for r in [*fine, *odd]]
    random.Random(1).shuffle(rows)
    got, books = codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3))
    clip = [(i, [min(max(x, -16384.0), 16384.0) for x in v]) for i, v, _ in sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    want, by_hand = codes_by_hand(clip)
    labels = [r[2] for r in sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    sums = Counter()
    for label, (_, error) in zip(labels, want, strict=True):
        sums[label] += error
    expected = Counter((i, label, code, error, sums[label]) for (i, _), label, (code, error) in zip(clip, labels, want, strict=True))
    assert Counter((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got.collect()) == expected
    assert books.tolist() == by_hand
    assert codes.digest(books) == hashlib.sha256(",".join(str(x) for b in by_hand for c in b for x in c).encode()).hexdigest()


def test_codes_of_few_or_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 1, "x", 1), (None, [1.0] * 8, 1, "x", 1)], VECTORS)
    assert codes.compress(none)[0].count() == 0 and codes.compress(none.limit(0))[0].count() == 0
    two = spark.createDataFrame([(2, [0.5] * 8, None, "x", 1), (1, [0.5] * 8, None, "x", 1)], VECTORS)
    assert sorted(tuple(r) for r in codes.compress(two)[0].collect()) == [(1, None, "00" * 8, 0, 0), (2, None, "00" * 8, 0, 0)]


def test_only_changes_are_summed():
    parts = np.arange(24).reshape(3, 2, 4)
    old, new = np.array([[0, 1], [1, 1], [0, 0]], np.uint8), np.array([[0, 1], [0, 1], [0, 1]], np.uint8)
    cells, n, sums = codes.changes(parts, old, new, 2)
    assert dict(zip(cells, zip(n, map(tuple, sums), strict=True), strict=True)) == {0: (1, (8, 9, 10, 11)), 1: (-1, (-8, -9, -10, -11)), 2: (-1, (-20, -21, -22, -23)), 3: (1, (20, 21, 22, 23))}
    assert codes.changes(parts, new, new, 2) == ([], [], [])


def test_label_errors_of_common_and_rare_labels(spark):
    rows = spark.range(4000).select((F.col("id") % 4000).alias("vec_id"), F.when(F.col("id") < 1900, F.lit(None)).when(F.col("id") < 2000, 1).otherwise(F.col("id")).cast("int").alias("label"), F.lit("00").alias("code"), F.col("id").alias("error"))
    got = {(r["label"], r["label_error"]) for r in codes.with_label_error(rows).collect()}
    assert got == {(None, sum(range(1900))), (1, sum(range(1900, 2000))), *((i, i) for i in range(2000, 4000))} and codes.with_label_error(rows).count() == 4000


# Packing


@pytest.fixture(scope="module")
def described():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


ODD = [
    None, "", " ", "\n\t \r\n", "Don't STOP, it's they'll 'S 'st", "a<|endoftext|>b <|startoftext|> <|end", "ÄÖÜ straße ŸĀĂ İI ıß µª²½", "é café ́x ñ", "a b c　d\u0085e\x1cf\x00g​",
    "日本語のテキスト 中文 한국어", "🙂🙃 👩‍👩‍👧 naïve—“quotes” …", "x1y22 3.14 1,000 ___ a_b", "ΑΣ ΌΣΟΣ σς", "w" * 50, "word " * 5000, "ab" * 40000, "~}{ -;:, (&) #$%", "don''t ''s", "ŉ ǅ İstanbul",
]
DOCS = "doc_id long, text string, length long, part string, ids string"


def test_pieces_equal_the_library(spark, described):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(described)
    rng = random.Random(3)
    alphabet = "abcXYZÉéñß'’ .,-_<|>\n019́­ 漢"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)), ODD[4]]
    df = spark.createDataFrame([(None if i == 5 else i % 415, t, 1, "x", "y") for i, t in enumerate(texts)], DOCS)
    got = defaultdict(list)
    for r in packing.pieces(df, described, 512).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])))
    want = defaultdict(list)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 512)):
            piece = np.array(ids[at : at + 512], "<u4").tobytes()
            want[None if i == 5 else i % 415].append((n, at, len(piece) // 4, zlib.crc32(piece), piece))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def check_plan(counts, length):
    used, sequences, space = Counter(), 0, 0
    for times, parts in packing.plan(counts, length):
        assert times > 0 and sum(n * side for n, side in parts) <= length
        for n, side in parts:
            used[n] += times * side
        sequences += times
    assert used == Counter({n: c for n, c in counts.items() if c})
    return sequences


def best_fit_decreasing(counts, length):
    gaps, bins = Counter(), 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if fit is None:
                bins, fit = bins + 1, length
            else:
                gaps[fit] -= 1
            gaps[fit - n] += 1
    return bins


def test_plan_uses_every_piece_once_and_little_space():
    """At least as good as best fit of falling lengths, over all cases and nearly so in each."""
    rng, sums = random.Random(5), [0, 0]
    for _ in range(60):
        length = rng.choice([10, 64, 512])
        counts = {rng.randint(1, length): rng.choice([1, 1, 2, 7, 300]) for _ in range(rng.randint(0, 40))}
        least = max(-(-sum(n * c for n, c in counts.items()) // length), sum(c for n, c in counts.items() if 2 * n > length))
        plain, got = best_fit_decreasing(counts, length), check_plan(counts, length)
        assert least <= got <= plain * 1.02 + 1
        sums[0] += got
        sums[1] += plain
    assert sums[0] <= sums[1]
    # Many short pieces leave no space: only the last sequence isn't full.
    counts = {n: 50 + n % 7 for n in range(1, 300)}
    assert check_plan(counts, 2048) == -(-sum(n * c for n, c in counts.items()) // 2048)
    # Complements of one, two and three pieces are all found.
    assert check_plan({60: 3, 40: 1, 30: 1, 10: 3, 25: 0, 20: 1}, 100) == 3
    assert check_plan({}, 100) == 0 and check_plan({1: 5000}, 2048) == 3 and check_plan({2048: 9}, 2048) == 9


def test_few_pieces_against_all_packings():
    """Against the best of all packings of up to seven pieces: at most one sequence more, mostly none."""

    def best(left, gaps):
        if not left:
            return len(gaps)
        n, tried, found = left[0], set(), len(gaps) + len(left)
        for i, g in enumerate(gaps):
            if n <= g and g not in tried:
                tried.add(g)
                found = min(found, best(left[1:], [*gaps[:i], g - n, *gaps[i + 1 :]]))
        return min(found, best(left[1:], [*gaps, 20 - n]))

    rng, more = random.Random(11), 0
    for _ in range(300):
        pieces = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        extra = check_plan(Counter(pieces), 20) - best(sorted(pieces, reverse=True), [])
        assert 0 <= extra <= 1
        more += extra
    assert more <= 6


def test_pack(spark):
    rng = random.Random(9)
    rows = [(i % 50, rng.choice([1, 3, 64, 64, 64, 17, 40]), "z") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, length long, extra string").repartition(5)
    got = packing.pack(df, 64)
    assert got.columns == ["doc_id", "length", "extra", "sequence_id", "offset"]
    assert Counter((r["doc_id"], r["length"]) for r in got.collect()) == Counter(r[:2] for r in rows)
    held = defaultdict(list)
    for r in got.collect():
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 64
    assert packing.pack(df.limit(0), 64).count() == 0


# Search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    found = [(i, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    total, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= {w.translate(LOWER) for w in TERM.findall(t or "")}
    out = {}
    for item, terms in asked.items():
        rows = []
        for i, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out[item] = [(n + 1, r[3], -r[0]) for n, r in enumerate(sorted(rows)[:k])]
    return {i: r for i, r in out.items() if r}


@pytest.mark.parametrize("docs_each,items_each,vocabulary", [(64, 1000, 1 << 20), (3, 4, 1 << 20), (5, 1000, 0)])
def test_search_by_brute_force(spark, monkeypatch, docs_each, items_each, vocabulary):
    """Small blocks, so that some are passed over; groups of queries; an index of all terms."""
    for name, value in (("DOCS", docs_each), ("ITEMS", items_each), ("VOCABULARY", vocabulary), ("STEP", 7)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Éa", "ÉA", "日本", "x y", "IT"]
    docs = [(i, rng.choice(" .,\n_").join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(30)] + [(i, docs[9][1]) for i in (-5, 300)] + [(None, docs[7][1]), (None, docs[11][1]), (12, docs[12][1]), (13, None), (14, ""), (15, "--- !"), (16, "w1 " * 20000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(10)] + [(20, docs[7][1]), (21, None), (22, "unknown words"), (None, "w3 w4"), (3, "w30 W31"), (20, docs[7][1]), (23, "It's w2-w5"), (24, "")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, n long").repartition(4)
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, q int")
    got = defaultdict(list)
    for r in search.search_all(d, q).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert {i: sorted(r) for i, r in got.items()} == ranked(docs, items)
    if docs_each == 3:
        assert search.search_all(d.limit(0), q).count() == 0 and search.search_all(d, q.limit(0)).count() == 0
        assert search.search_all(d.where("text IS NULL OR text IN ('', '--- !')"), q).count() == 0


def test_bounds_hold_and_leave_few_blocks(spark, monkeypatch):
    """No document scores above its block's bound, and few blocks reach the threshold of the best ten."""
    monkeypatch.setattr(search, "DOCS", 4)
    rows = [(i, "apple pear plum" if i < 12 else f"apple filler{i} " * 30) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {1: {b"pear", b"plum", b"apple"}, 2: {b"apple"}}
    blocks, frequencies, total, _ = search.index(docs, {b"pear", b"plum", b"apple"})
    got = search.search(blocks, frequencies, total, found).where("item_id = 1").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(10))
    df = {r["term"]: r["df"] for r in frequencies.collect()}
    weights = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = search.Queries({i: {t.decode() for t in terms} for i, terms in found.items()}, weights)
    table = blocks.toArrow()
    bounds, reached = asked.bounds(table), 0
    for row, bound in zip(table.to_pylist(), bounds, strict=True):
        ids, scores = asked.scorer(row)
        assert all((scores(q) <= bound[q]).all() and len(scores(q)) == len(ids) == 4 for q in (0, 1))
        reached += bound[0] >= min(r["score"] for r in got)
    assert len(bounds) == 50 and reached == 3
