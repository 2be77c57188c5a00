import hashlib
import re
from collections import Counter

import pytest
import xxhash

from tests.llm.conftest import frame, prose
from tidewatch.llm import simhash, substring_dedup
from tidewatch.llm.components import components


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits):
    roots = {p: p for p in prints}

    def find(p):
        while roots[p] != p:
            p = roots[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= bits:
                roots[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprints_and_groups(odd_docs, odd_rows):
    got = simhash.near_duplicates(odd_docs).select("doc_id", simhash.hexadecimal(simhash.F.col("fp")).alias("fp"), "component_id").collect()
    prints = [plain_fingerprint(t) for _, t in odd_rows]
    root = groups(set(prints), 2)
    least = {}
    for (i, _), p in zip(odd_rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    wanted = Counter((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(odd_rows, prints, strict=True))
    assert Counter(tuple(r) for r in got) == wanted


@pytest.mark.parametrize("pair_file", [1, 3, 1000])
@pytest.mark.parametrize("bits", [1, 2])
def test_no_link_is_lost_in_full_files(spark, bits, pair_file):
    """Clusters around a few centres: pairs, and stars over one-bit neighbours."""
    prints = set()
    for centre in (0, 0x0123456789ABCDEF, (1 << 64) - 1):
        for a in range(0, 64, 5):
            prints |= {centre ^ 1 << a, centre ^ 1 << a ^ 1 << (a * 7 + 3) % 64, centre ^ 0b10101 << a % 60}
    prints = sorted({p & (1 << 64) - 1 for p in prints})
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits, pair_file=pair_file)
    got = {signed[r["node"]]: signed[r["root"]] for r in components(found).collect()}
    wanted = groups(prints, bits)
    by_wanted, by_got = {}, {}
    for p in prints:
        by_wanted.setdefault(wanted[p], set()).add(p)
        by_got.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, by_wanted.values())) == sorted(map(sorted, by_got.values()))


def test_components_of_a_long_path_and_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100)], "u long, v long")
    assert {tuple(r) for r in components(path).collect()} == {(i, 0) for i in range(61)}
    assert components(path.limit(0)).count() == 0


def test_one_representative_of_each_group(odd_docs, odd_rows, no_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.schema == odd_docs.schema
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    prints = {plain_fingerprint(t) for _, t in odd_rows}
    assert len(rows) == len(set(groups(prints, 2).values()))
    # empty texts are one group, and the row with an id is preferred to the one without
    assert [i for i, t in rows if not (t or "").split()] == [1]
    assert Counter(i for i, _ in rows)[8] == 1 and Counter(i for i, _ in rows)[7] == 0
    assert simhash.representatives(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def plain_removal(rows, size=13):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        for s in range(len(words) - size + 1):
            if i is not None:
                first[tuple(words[s : s + size])] = min(i, first.get(tuple(words[s : s + size]), i))
    out = []
    for i, words in texts:
        gone = set()
        for s in range(len(words) - size + 1):
            if i is not None and first[tuple(words[s : s + size])] < i:
                gone.update(range(s, s + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeated_passages_go(odd_docs, odd_rows, no_docs):
    got = substring_dedup.dedup(odd_docs).drop("kept").collect()
    wanted = plain_removal(odd_rows)
    assert Counter(tuple(r) for r in got) == Counter(wanted)
    assert sum(n for _, _, n, _ in wanted) > 20_000
    assert substring_dedup.dedup(no_docs).count() == 0


def test_a_passage_of_many_documents_stays_in_the_first(spark):
    passage = prose(9, 20)
    rows = [(i, f"{prose(1000 + i, 5)} {passage} {prose(2000 + i, 9)}") for i in range(60)] + [(60, passage), (61, " ".join(passage.split()[:13]))]
    got = substring_dedup.dedup(frame(spark, rows)).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_removal(rows))


def test_a_full_filter_changes_nothing(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(substring_dedup, "LEAST_BITS", 1 << 10)
    monkeypatch.setattr(substring_dedup, "BITMAP", 1 << 10)
    monkeypatch.setattr(substring_dedup, "PROBES", 1)
    assert (substring_dedup.places(substring_dedup._FACTORS, 0, 1 << 10) < 1 << 10).all()
