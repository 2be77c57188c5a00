import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame, prose
from tidewatch.llm import decontamination, hidden_markov, pii, url_filter

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- decontamination


def plain_contamination(docs, items):
    windows = {}
    for name, text in items:
        words = re.findall(WORD, lower(text))
        n = min(13, len(words))
        for s in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[s : s + n]), set()).add(str(name))
    out = []
    for i, text in docs:
        words, hit, names = re.findall(WORD, lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                if found := windows.get(tuple(words[s : s + n])):
                    hit.update(range(s, s + n))
                    names |= found
        out.append((i, len(words), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(words)))
    return out


@pytest.fixture(scope="module")
def exam(odd_rows):
    long = next(t for i, t in odd_rows if i == 6).split()
    items = [
        (1, prose(2, 60)), (2, " ".join(long[500:540])), (10, "two, WORDS!"), (11, "one"), (12, "one"), (12, "éà ü"),
        (13, ""), (14, prose(77, 40)), (15, " ".join(["w1"] * 20)),
    ]
    return items


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 300])
def test_contamination(spark, odd_docs, odd_rows, exam, block_bytes):
    rows = [*odd_rows, (300, "w1 " * 30), (301, "One, two words.")]
    table = spark.createDataFrame([*exam, (None, "one"), (16, None)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontamination.searched(frame(spark, rows), table, block_bytes).select("doc.doc_id", "found.n_words", "found.n_hit", "found.items").collect()
    wanted = plain_contamination(rows, exam)
    assert Counter((r[0], r[1], r[2], tuple(r[3])) for r in found) == Counter(w[:4] for w in wanted)
    if block_bytes > 300:
        clean = decontamination.clean(frame(spark, rows), table)
        assert clean.schema == odd_docs.schema
        assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(
            row for row, w in zip(rows, wanted, strict=True) if not w[4]
        )


def test_contamination_of_nothing(spark, odd_docs, odd_rows, no_docs, exam):
    table = spark.createDataFrame(exam, "item_id long, text string")
    assert decontamination.contamination(no_docs, table).count() == 0
    none = decontamination.contamination(odd_docs, table.limit(0)).collect()
    assert len(none) == len(odd_rows) and not any(r["contaminated"] or r["items"] for r in none)


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        double = int(c) * (1 + i % 2)
        total += double - 9 * (double > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if valid:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = [
    "a@b.c_d@e.f x@y @z.a a@b a@-.- a..b%+@c-d.e.f. q@w.e@r.t",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3 1.2.3.4. 00000255.0.0.0 999999999999999999999.1.1.1",
    "4539 1488 0343 6467 4539-1488-0343-6467 4539  1488 0343 6467 45391488034364670000000000 4539148803436468",
    "+1 (555) 010-2030 +1234567 +12345678 + 1234567890 +1-+1 555 010 2030) +1((((((((( +123456789012345678",
    "𝒳é +49 30 1234567 a@b.cd\n10.0.0.1\n" + "9" * 5000 + " " + "x." * 3000 + "@ " + "1 " * 4000 + "+1" + ")" * 3000,
    "card 4539148803436467 and ip 10.20.30.40 and a@b.co" * 50,
]


def test_base_spans(spark, odd_rows, no_docs):
    rows = [*odd_rows, *((500 + i, t) for i, t in enumerate(HARD))]
    got = pii.judge(frame(spark, rows)).select("doc_id", "base", "spans").collect()
    assert Counter((r["doc_id"], r["base"]) for r in got) == Counter((i, plain_spans(t)) for i, t in rows)
    assert all(r["spans"].startswith(r["base"]) for r in got)
    assert pii.judge(no_docs).count() == 0


@pytest.fixture(scope="module")
def secret_rows():
    """The nickname stands near one address in several texts, and nowhere else but
    once alone; 'contact' stands near every address."""
    rows = [(i, f"{prose(i, 20)} contact Zorro42x at the.fox@mail.example.com {prose(i + 50, 20)}") for i in range(6)]
    rows += [(10 + i, f"{prose(i + 100, 20)} contact someone{i} at user{i}@mail.example.com") for i in range(30)]
    rows += [(50 + i, prose(i + 200, 40)) for i in range(60)]
    rows += [(200, "Yesterday ZORRO42X was seen."), (201, "zorro42xy and xzorro42x are others")]
    return rows


def test_disclosing_terms(spark, secret_rows, monkeypatch):
    docs = frame(spark, secret_rows)
    for bound in (pii.BROADCAST_TERMS, -1):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
        found = {r["doc_id"]: r for r in pii.judge(docs).collect()}
        named = {i: [(t["start"], t["end"]) for t in r["terms"]] for i, r in found.items() if r["terms"]}
        texts = dict(secret_rows)
        assert set(named) == {0, 1, 2, 3, 4, 5, 200}
        assert all(texts[i][a:b].lower() == "zorro42x" for i, spans in named.items() for a, b in spans)
        assert found[200]["spans"] == "term:10:18"


def test_bits_missing(spark, secret_rows):
    found = pii.base(frame(spark, secret_rows))
    pairs = {(r["term"], r["entity"]): r["n_both"] for r in pii.candidates(found).collect()}
    assert pairs["zorro42x", "email:the.fox@mail.example.com"] == 6 and pairs["contact", "email:the.fox@mail.example.com"] == 6
    # six of the seven texts with the name hold the value; it is written as a name
    bits = -math.log2((6 + pii.NAMED) / (7 + pii.NAMED + pii.PRIOR))
    assert pii.REMOVE < bits < pii.GENERALISE


def test_other_documents_change_no_verdict(spark):
    """Names beside values of one and of two texts are found, rare plain words stay, and
    copies of a text are no further evidence, whatever else there is."""
    told = [
        (3000, "plain w1 Quillon at q1@mail.example.com w2"), (3001, "w3 plain Brandt +49 30 1234567 w4"),
        (3002, "w5 plain w6 Brandt +49 30 1234567"), (3003, "please write to alice@corp.example.org about teh zxqtypo thing. Mondays too"),
        (3004, "mail of zebedee, zebedee@mail.example.com, came"), (3005, "the Quark is no name: see Quark, and quark"), (3006, "a quark"),
        (3007, "one quark and 10.1.2.3"), (3008, "secretword and 10.9.9.9"), (3009, "10.9.9.9 is secretword's"), (3010, "secretword: 10.9.9.9"),
    ]
    told += [(3100 + i, "plain lowly r1@mail.example.com") for i in range(5)]
    wanted = {3000: ["Quillon"], 3001: ["Brandt"], 3002: ["Brandt"], 3004: ["zebedee", "zebedee"], 3008: ["secretword"], 3009: ["secretword"], 3010: ["secretword"]}
    for n in (50, 700):
        rows = [(i, f"w{i % 50} w{i % 7} plain") for i in range(n)] + told
        found = {r["doc_id"]: r for r in pii.judge(frame(spark, rows)).filter("size(terms) > 0").collect()}
        assert {i: [dict(rows)[i][t["start"] : t["end"]] for t in r["terms"]] for i, r in found.items()} == wanted


def test_many_values_in_one_text(spark):
    """Work grows with the matches of a text, not with their square."""
    n = 3000
    rows = [(1, " ".join(f"user{i} u{i}@mail.example.com" for i in range(n))), (2, "short")]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r for r in pii.judge(docs).collect()}
    assert found[1]["base"] == plain_spans(rows[0][1]) and len(found[1]["email"]) == n and not found[1]["terms"]
    assert pii.candidates(pii.base(docs), spark.createDataFrame([], "term string")).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[1] == " ".join(f"user{i} [EMAIL]" for i in range(n))


def test_terms_of_whole_documents(spark):
    """Terms far from the value, of digits and of two letters are counted like others;
    those that only stand inside values are no candidates."""
    far = "李四 77123 Quillon " + " ".join(f"w{k % 50}" for k in range(60)) + " q.one@mail.example.com"
    near = "Quillon q.one@mail.example.com " + " ".join(f"w{k}" for k in range(50)) + " 李四 77123"
    rows = [(i, " ".join(f"w{(i + k) % 50}" for k in range(9))) for i in range(120)]
    rows += [(1000 + i, f"{'w1 ' * i}{far if i % 2 else near}") for i in range(8)]
    docs = frame(spark, rows)
    pairs = {r["term"]: r["n_both"] for r in pii.candidates(pii.base(docs)).collect()}
    assert pairs["quillon"] == pairs["李四"] == pairs["77123"] == 8
    assert not {"q", "one", "mail", "com"} & set(pairs)
    found = {r["doc_id"]: r for r in pii.judge(docs).filter("size(terms) > 0").collect()}
    texts = dict(rows)
    assert {i: {texts[i][t["start"] : t["end"]] for t in r["terms"]} for i, r in found.items()} == {
        1000 + i: {"Quillon", "李四", "77123"} for i in range(8)
    }


def test_sanitised_texts(spark, secret_rows, odd_docs, odd_rows, no_docs):
    docs = frame(spark, secret_rows)
    clean = pii.sanitised(docs)
    assert clean.schema.simpleString() == docs.schema.simpleString()
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[200]["text"] == "Yesterday [TERM] was seen." and got[200]["n_chars"] == len(got[200]["text"])
    assert "contact [TERM] at [EMAIL] " in got[0]["text"]
    assert all(got[i]["text"] == t for i, t in secret_rows if 50 <= i < 200 or i == 201)
    odd = Counter((r["doc_id"], r["text"]) for r in pii.sanitised(odd_docs).collect())
    changed = Counter(odd_rows) - odd
    assert [i for i, _ in changed] == [13] and sum(odd.values()) == len(odd_rows)
    assert odd[13, "Mail [EMAIL], call [PHONE] or [IP]; card [CARD]."] == 1
    assert pii.sanitised(no_docs).count() == 0


def test_overlapping_spans_are_covered(spark):
    docs = frame(spark, [(1, "see +1.2.3.45678@x.yz end")])
    spans = plain_spans("see +1.2.3.45678@x.yz end").split(",")
    covered = pii.sanitised(docs).first()["text"]
    assert len(spans) >= 1 and covered.startswith("see [") and covered.endswith("] end") and "@" not in covered


# ---- url filter

URLS = [
    "http://a.com/x", "https://www.example.com/en/1", "http://M.Example.COM/en/", "http://example.com/en", "http://a.com",
    "http://b.net/es/1", "http://b.net/fr/", "http://b.net/de/", "http://xcom/", "http://com/", "no scheme", None, "", "://", "a://b://c",
    "http://free-bets.example.org/", "http://www.spam-farm.org?x=/en/", "http://spam-farm2.org/", "ftp://u.org#frag/en/", "http://É.ÀX.org/é?q",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = lower(host)
    best = None
    for verdict, of, start in url_filter.RULES:
        if (host == of or host.endswith("." + of)) and path.startswith(start) and (best is None or len(of + start) > len(best[0])):
            best = (of + start, verdict)
    listed = bool(set(host.split(".")) & set(url_filter.BLOCKED_LABELS))
    return host, path, best and best[0], best[1] if best else "block" if listed else "allow"


@pytest.mark.parametrize("max_bits", [url_filter.MAX_BITS, 256])
def test_url_verdicts(spark, max_bits):
    urls = URLS + [f"http://{'spam-farm' if i % 3 == 0 else 'site'}.h{i}.org/{i}" for i in range(700)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    got = url_filter.judge(pages, url_filter.labelled_hosts(pages), max_bits=max_bits).collect()
    assert sorted(map(tuple, got)) == [(i, *plain_verdict(u)) for i, u in enumerate(urls)]
    nothing = pages.limit(0)
    assert url_filter.judge(nothing, url_filter.labelled_hosts(nothing)).count() == 0


def test_cascade_is_exact_and_small(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 10 == 0).alias("listed"))
    cascade = url_filter.build(universe)
    assert universe.filter(cascade.listed(F.col("key")) != F.col("listed")).count() == 0
    assert len(cascade.levels) > 1 and sum(level.size for level in cascade.levels) < 400 * 16


# ---- language model


def plain_model(docs):
    texts = [(i, [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t))] + [b""]) for i, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in texts]
    counts = Counter(w for (_, t), h in zip(texts, held, strict=True) if not h for w in t)
    return texts, held, counts


def test_base_scores_and_head_words(spark, odd_docs, odd_rows, no_docs):
    texts, held, counts = plain_model(odd_rows)
    n, v = sum(counts.values()), len(counts)
    wanted = Counter()
    for (i, t), h in zip(texts, held, strict=True):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        wanted[i, h, len(t), sum(counts[w] > 0 for w in t), n, round(base, 5)] += 1
    for head in (40, 100_000 // 2):
        got = hidden_markov.score(odd_docs, head=head, states=2, rounds=1).collect()
        assert Counter((*r[:5], round(r["base_score"], 5)) for r in got) == wanted
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert hidden_markov.score(no_docs).count() == 0


def test_the_head_is_filled_exactly(spark):
    rows = [(f"w{i:03}".encode(), 3) for i in range(50)] + [(b"often", 900), (b"rare", 1)]
    counts = spark.createDataFrame(rows, "word binary, c long").repartition(4)
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    for most in (0, 1, 2, 49, 50, 51, 52, 60):
        assert hidden_markov.frequent_words(counts, most) == ranked[:most]


def test_forward_and_counts_match_all_paths():
    import itertools

    import numpy as np

    draw = np.random.default_rng(3)
    unit = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hidden_markov.Model(unit(draw.random(2), 0), unit(draw.random((2, 2)), 1), unit(draw.random((4, 2)), 0))
    codes = [np.array(c, np.uint16) for c in ([0, 3, 1, 1, 2], [2], [1, 0, 3])]
    flat, starts, sizes = hidden_markov.segments(codes, 100)
    logs, _ = hidden_markov.forward(model, flat, starts, sizes)
    first, moves, emits, total = hidden_markov.expected(model, flat, starts, sizes)
    all_first, all_moves, all_emits, all_logs = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), []
    for seq in sorted(codes, key=len, reverse=True):
        paths = []
        for path in itertools.product((0, 1), repeat=len(seq)):
            p = model.start[path[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(path)])
            paths.append((path, p * np.prod([model.emit[s, k] for s, k in zip(seq, path, strict=True)])))
        whole = sum(p for _, p in paths)
        all_logs.append(np.log10(whole))
        for path, p in paths:
            all_first[path[0]] += p / whole
            for a, b in itertools.pairwise(path):
                all_moves[a, b] += p / whole
            for s, k in zip(seq, path, strict=True):
                all_emits[s, k] += p / whole
    assert np.allclose(logs, all_logs) and np.isclose(total, sum(all_logs))
    assert np.allclose(first, all_first) and np.allclose(moves, all_moves) and np.allclose(emits, all_emits)


def test_counts_do_not_depend_on_the_stretch():
    import numpy as np

    draw = np.random.default_rng(0)
    model = hidden_markov.first_model(np.full(50, 0.02), 3)
    texts = [draw.integers(0, 50, n).astype(np.uint16) for n in (37, 20, 20, 5, 1)]
    flat, starts, sizes = hidden_markov.segments(texts, 100)
    whole = hidden_markov.expected(model, flat, starts, sizes, 100)
    for stretch in (1, 7, 20, 36):
        for one, two in zip(whole, hidden_markov.expected(model, flat, starts, sizes, stretch), strict=True):
            assert np.allclose(one, two, atol=1e-4)


def test_segments_cover_each_text():
    import numpy as np

    codes = [np.arange(n, dtype=np.uint16) for n in (1, 64, 65, 200)]
    flat, starts, sizes = hidden_markov.segments(codes, 64)
    covered = sorted(p for s, n in zip(starts, sizes, strict=True) for p in range(s, s + n))
    assert covered == list(range(len(flat))) and max(sizes) == 64 and len(starts) == 1 + 1 + 2 + 4


def test_rounds_count_whole_texts(spark, monkeypatch):
    """A round over texts longer than a stretch counts as over the uncut texts."""
    import numpy as np

    draw = np.random.default_rng(5)
    unit = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hidden_markov.Model(unit(draw.random(2), 0), unit(draw.random((2, 2)), 1), unit(draw.random((5, 2)), 0))
    texts = [draw.integers(0, 5, n).astype(np.uint16) for n in (1, 63, 64, 65, 128, 300, 640)]
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "codes binary").repartition(2)
    got, logs = hidden_markov.improved(rows, model, np.full(5, 0.2))
    monkeypatch.setattr(hidden_markov, "_AT_ONCE", 50)  # then texts are worked on in stretches
    again, _ = hidden_markov.improved(rows, model, np.full(5, 0.2))
    assert np.allclose(got.start, again.start) and np.allclose(got.move, again.move) and np.allclose(got.emit, again.emit)
    starts, moves, total = np.zeros(2), np.zeros((2, 2)), 0.0
    for text in texts:  # unscaled sums would vanish, so each step is scaled on its own
        alphas, betas = [model.start * model.emit[text[0]]], [np.ones(2)]
        for c in text[1:]:
            alphas.append(alphas[-1] / alphas[-1].sum() @ model.move * model.emit[c])
        for c in text[:0:-1]:
            back = model.move @ (model.emit[c] * betas[0])
            betas.insert(0, back / back.sum())
        total += sum(np.log10(a.sum()) for a in alphas)
        starts += unit(alphas[0] * betas[0], 0)
        for t in range(1, len(text)):
            step = alphas[t - 1][:, None] * model.move * (model.emit[text[t]] * betas[t])[None]
            moves += step / step.sum()
    assert np.isclose(logs, total) and np.allclose(got.start, unit(starts + 1e-3, 0)) and np.allclose(got.move, unit(moves + 1e-3, 1))


def test_rounds_improve_and_find_structure(spark):
    """Texts of two vocabularies: states tell them apart, so texts become likelier."""
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + k * k) % 23}" for k in range(40))) for i in range(300)]
    got = hidden_markov.score(frame(spark, rows), states=2, rounds=5).filter("held_out").collect()
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert len(got) > 20 and gain > 0.15
