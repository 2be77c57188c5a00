"""Operators that build indexes inside tasks, held against exhaustive search."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame, prose
from tidewatch.llm import ranked_search, run_length_index, spelling_variants
from tidewatch.llm.suffixes import suffix_order


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- run-length index


def plain_marks(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    starts = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = Counter()
    for (doc_id, _), text in zip(rows, texts, strict=True):
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            if starts[text[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        left = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[doc_id, len(text), sum(gone), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


def test_matching_statistics_of_small_texts():
    draw = random.Random(3)
    for _ in range(60):
        strings = [bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 25))) for _ in range(draw.randint(1, 7))]
        index, starts = run_length_index.run_length_index(strings)
        found = index.matching_statistics()
        assert index.lengths.sum() == index.size == len(b"".join(strings)) + len(strings)
        for i, one in enumerate(strings):
            for p in range(len(one)):
                longest = max(
                    (len(shared(one[p:], two[q:])) for j, two in enumerate(strings) for q in range(len(two)) if (i, p) != (j, q)), default=0
                )
                assert found[starts[i] + p] == longest


def shared(one, two):
    n = next((k for k, (a, b) in enumerate(zip(one, two, strict=False)) if a != b), min(len(one), len(two)))
    return one[:n]


def test_suffix_order():
    draw = random.Random(4)
    for n in (1, 2, 50, 400):
        import numpy as np

        text = [draw.choice([1, 2, 3]) for _ in range(n - 1)] + [0]
        assert suffix_order(np.array(text), 4).tolist() == sorted(range(n), key=lambda i: text[i:])


@pytest.fixture(scope="module")
def repetitive():
    near = prose(9, 60, 40)
    rows = [(None, None), (1, ""), (2, "short"), (3, "aaaa" * 300), (4, "ab" * 200), (5, prose(1, 300, 30)), (6, prose(1, 300, 30)), (None, "é𝒳" * 50)]
    rows += [(20 + i, prose(i, 20, 12) + " shared passage of a fair length, says everyone " + prose(i + 50, 20, 12)) for i in range(20)]
    rows += [(60 + i, near[: i * 3] + "!" + near[i * 3 :]) for i in range(20)]
    return [*rows, rows[20], (rows[20][0], "same id, other text")]


@pytest.mark.parametrize(
    "limits", [{}, {"hot_bytes": 300}, {"most_bits": 8, "shard_bytes": 2000}, {"hot_bytes": 0, "gram": 5}], ids=["plain", "hot", "no filter", "all hot"]
)
def test_repeated_bytes(spark, repetitive, limits):
    found = run_length_index.dedup(frame(spark, repetitive), **{"length": 24, "gram": 8} | limits).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == plain_marks(repetitive, 24)


def test_repeated_bytes_of_odd_rows(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(run_length_index, "HOT_COPIES", 1)
    found = run_length_index.dedup(odd_docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == plain_marks(odd_rows, 200)
    texts = dict(odd_rows)
    for row in found:
        assert row["n_removed"] == sum(s["stop"] - s["start"] for s in row["spans"])
        if row["doc_id"] == 200:
            left = run_length_index.without(texts[200].encode(), [(s["start"], s["stop"]) for s in row["spans"]])
            assert hashlib.sha256(left).hexdigest() == row["kept_sha256"]
    assert run_length_index.dedup(no_docs).count() == 0


# ---- spelling variants


def plain_variants(rows, least=7, count=2, dominance=10):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    n = {word: c for word, c in n.items() if c >= count}
    one_less, near = defaultdict(set), defaultdict(set)
    for word in n:
        one_less[word].add((None, word))
        for i in range(len(word)):
            one_less[word[:i] + word[i + 1 :]].add((i, word))
    for words in one_less.values():
        for i, one in words:
            for j, two in words:
                if one != two and (i is None or j is None or (i == j and len(one) == len(two))):
                    near[one].add(two)
    form = {}
    for word in n:
        best = min(near[word], key=lambda other: (-n[other], other), default=None)
        form[word] = best if best and n[best] >= dominance * n[word] else None

    def root(word):
        return root(form[word]) if form[word] else word

    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


@pytest.fixture(scope="module")
def misspelt():
    draw = random.Random(1)
    base = ["spelling", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÀéÿÀéÿÀé", "abababab", "babababa", "variant", "variants"]
    rows = [(None, None), (1, ""), (None, "Variant variants"), (1, "Variant variants"), (500, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 3001)]
    for i in range(100):
        words = []
        for _ in range(60):
            word = draw.choice(base) if draw.random() < 0.9 else "".join(draw.choice("ab") for _ in range(draw.randint(6, 9)))
            if draw.random() < 0.15:
                k = draw.randrange(len(word))
                word = draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice("abcé") + word[k:], word[:k] + draw.choice("abcñ") + word[k + 1 :]])
            words.append(word.upper() if draw.random() < 0.1 else word)
        rows.append((i, draw.choice([" ", "-", "中", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("shard_symbols", [spelling_variants.SHARD_SYMBOLS, 300])
def test_spelling_variants(spark, misspelt, shard_symbols):
    docs = frame(spark, misspelt)
    wanted = plain_variants(misspelt, dominance=2)
    assert Counter(tuple(r) for r in spelling_variants.group(docs, dominance=2, shard_symbols=shard_symbols).collect()) == wanted
    assert sum(row[4] for row in wanted) > 1000 and any(row[2] != row[1] for row in wanted if row[1])


def test_spelling_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert Counter(tuple(r) for r in spelling_variants.group(odd_docs, least_length=2).collect()) == plain_variants(odd_rows, least=2)
    assert spelling_variants.group(no_docs).count() == 0


# ---- ranked search


def plain_ranking(rows, items, k=50):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))

    docs = [(doc_id, Counter(terms(text))) for doc_id, text in rows]
    docs = [(doc_id, counted) for doc_id, counted in docs if counted]
    n_docs, n_all = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, counted in docs for t in counted)
    out = Counter()
    for item_id, text in items:
        scored = []
        for doc_id, counted in docs:
            m = 50 + (50 * counted.total() * n_docs) // n_all
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counted[t]) // (1000 * counted[t] + 20 * m))
                for t in set(terms(text))
                if t in counted
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            out[item_id, rank, None if none else doc_id, -score] += 1
    return out


@pytest.fixture(scope="module")
def questions():
    return [(1, prose(2, 12)), (2, "one two words"), (2, "one two words"), (3, ""), (4, None), (5, "nothingknown"), (None, "Mail id HERE"), (7, prose(60, 40) + " w0 W0 w1")]


@pytest.mark.parametrize(("k", "chunk", "block_bytes"), [(50, (1 << 14, 1 << 22), 1 << 20), (5, (4, 100), 60), (1, (1, 1), 1 << 20)])
def test_ranked_search(spark, odd_docs, odd_rows, questions, k, chunk, block_bytes):
    items = spark.createDataFrame(questions, "item_id long, text string").withColumn("score", F.lit("clash"))
    found = ranked_search.rank(odd_docs, items, k, block_bytes, chunk)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == plain_ranking(odd_rows, questions, k)


def test_reading_stops_before_the_ends_of_the_lists(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(5)
    sizes = np.full(4000, 100)
    codes = [np.array([0, 1, *([2] if i % 900 == 0 else [])], np.int32).tobytes() for i in range(4000)]
    counts = [draw.integers(1, 30, len(c) // 4).astype(np.int32).tobytes() for c in codes]
    lists = ranked_search.Lists(sizes, codes, counts, np.array([900, 40, 7000]), 4000, 400_000)
    read = []
    real = np.bincount
    monkeypatch.setattr(ranked_search.np, "bincount", lambda documents, *rest: (read.append(len(documents)), real(documents, *rest))[1])
    found, scores = lists.best(np.array([2]), 3, 1)
    assert len(found) == 3 and sum(read) <= 2 * 5
    read.clear()
    found, scores = lists.best(np.array([0, 1]), 3, 1)
    assert (np.sort(scores)[-3:] > 0).all() and sum(read) < 8000


def test_ranking_of_nothing(spark, odd_docs, no_docs, questions):
    items = spark.createDataFrame(questions, "item_id long, text string")
    assert ranked_search.rank(no_docs, items).count() == 0
    assert ranked_search.rank(odd_docs, items.limit(0)).count() == 0
