"""Exact, near and substring dedup against plain Python on small tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from graspmeter.llm import exact_dedup, simhash_dedup, substring_dedup
from graspmeter.llm.components import connected_components
from graspmeter.llm.exact_dedup import drop_copies, exact_groups, merge_sorted
from graspmeter.llm.golay import code
from graspmeter.llm.queries import QUERIES

SPACE = r"[\x20\x09-\x0D]+"


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_exact_groups_with_nulls_ties_and_repeated_rows(docs):
    long = "word " * 60_000
    frame = docs((5, "a  b"), (3, "a\tb"), (3, "a b"), (9, None), (8, ""), (7, " "), (1, long), (2, long + " "), (None, "a b"), (None, "z"), (4, "a\u00a0b"))
    rows = exact_groups(frame).collect()
    assert len(rows) == 11
    by_text = defaultdict(list)
    for row in rows:
        by_text[row.text_sha256].append(row)
    for group in by_text.values():
        assert sum(r.kept for r in group) == 1
        assert {r.group_size for r in group} == {len(group)}
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {min(ids, default=None)}
    assert len(by_text[hashlib.sha256(b"a b").hexdigest()]) == 4
    assert len(by_text[hashlib.sha256(b"").hexdigest()]) == 2
    kept = drop_copies(frame)
    assert kept.columns == frame.columns and kept.count() == len(by_text)
    assert exact_groups(docs().limit(0)).count() == 0


def test_filters_are_built_in_little_more_than_linear_time(monkeypatch):
    """Small batches: what is sorted and merged grows as n log n, and the counters are those of one sort."""
    moved = {}
    for n in (20_000, 80_000):
        moved[n] = 0

        def counting(keys, counts, n=n):
            moved[n] += len(keys)
            return merge_sorted(keys, counts)

        monkeypatch.setattr(exact_dedup, "merge_sorted", counting)
        monkeypatch.setattr(exact_dedup, "NEW", 256)
        keys = np.random.default_rng(n).integers(0, n // 2, n).astype(np.uint64)
        build = exact_dedup.Build()
        for start in range(0, n, 100):
            build.add(keys[start : start + 100])
        found = build.finished()
        want = np.unique(keys, return_counts=True)
        assert (found[0] == want[0]).all() and (found[1] == want[1]).all()
    assert moved[80_000] < 6 * moved[20_000] and moved[80_000] < 80_000 * 12
    assert len(exact_dedup.Build().finished()[0]) == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, n) for n in (0, 1, 400, 30)]
    merged = [merge_sorted(p, np.ones(len(p), np.int64)) for p in parts]
    keys, counts = merge_sorted(np.concatenate([k for k, _ in merged]), np.concatenate([c for _, c in merged]))
    expected = np.unique(np.concatenate(parts), return_counts=True)
    assert (keys == expected[0]).all() and (counts == expected[1]).all()


def brute_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_keys_find_every_pair_within_three_bits():
    rng, pick = np.random.default_rng(2), random.Random(2)
    words = rng.integers(0, 1 << 23, 5000)
    flipped = words ^ (1 << rng.integers(0, 23, len(words)))
    assert (code().near(words) == code().nearest(flipped)[0][:, None]).any(axis=1).all()
    fps = rng.integers(-(2**63), 2**63 - 1, 2000)
    for bits in range(4):
        masks = [sum(1 << b for b in pick.sample(range(64), bits)) for _ in fps]
        others = (fps.view(np.uint64) ^ np.array(masks, np.uint64)).view(np.int64)
        sought, filed = simhash_dedup.sought_keys(fps), simhash_dedup.filed_keys(others)
        assert all(np.intersect1d(a, b).size for a, b in zip(sought, filed))


def test_near_groups_equal_brute_force(spark, docs, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join(f"w{i % 97}x{i}" for i in range(400))
    rows += [(10_000 + i, base.replace(f"x{i * 7} ", f"y{i} ")) for i in range(40)]
    rows += [(20_000, None), (20_001, ""), (20_002, "One two"), (20_003, "one TWO"), (20_004, "É é"), (20_002, "One two"), (None, base)]
    prints = [brute_fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    root = roots(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 3])
    least = {}
    for (doc, _), fp in zip(rows, prints):
        if doc is not None:
            least[root[fp]] = min(doc, least.get(root[fp], doc))
    expected = sorted((str(d), f"{fp:016x}", least[root[fp]]) for (d, _), fp in zip(rows, prints))
    found = simhash_dedup.near_groups(docs(*rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found.collect()) == expected
    assert len(set(root.values())) < len(nodes)
    assert simhash_dedup.near_groups(docs().limit(0)).count() == 0
    assert QUERIES["op7_simhash_dedup"](spark, sf).count() == 200


def test_fingerprint_of_a_text_longer_than_a_piece(monkeypatch):
    text = " ".join(f"Word{i % 500}" for i in range(3000))
    monkeypatch.setattr(simhash_dedup, "PIECE", 100)
    assert simhash_dedup.fingerprint(text, 3) % (1 << 64) == brute_fingerprint(text)


def test_components_equal_union_find(spark):
    pick = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [(pick.randrange(100, 400), pick.randrange(100, 400)) for _ in range(200)] + [(7, 7), (1, 0)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.root for r in found} == roots(nodes, edges) and len(found) == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows, least):
    units = []
    for doc, text in rows:
        number = 0
        for m in re.finditer(r"[^\n.!?]+[.!?]*", text or ""):
            words = re.findall(r"\w+", m.group().lower())
            if words:
                units.append((doc, text, number, " ".join(words), len(words), m.start(), m.end()))
                number += 1
    first = {}
    for doc, *_, key, _, _, _ in units:
        if doc is not None:
            first[key] = min(doc, first.get(key, doc))
    seen, flagged = set(), defaultdict(dict)
    for doc, text, number, key, n, begin, end in units:
        again = (doc, text, key) in seen
        seen.add((doc, text, key))
        if again or (key in first and first[key] != doc):
            flagged[doc, text][number] = (n, begin, end)
    spans = set()
    for (doc, _), marked in flagged.items():
        for number in sorted(marked):
            if number - 1 in marked:
                continue
            run = [marked[number]]
            while number + len(run) in marked:
                run.append(marked[number + len(run)])
            if sum(n for n, *_ in run if n >= substring_dedup.COUNTED) >= least:
                spans.add((doc, run[0][1], run[-1][2], sum(n for n, *_ in run), len(run)))
    return spans


def test_spans_equal_brute_force(docs):
    passage = "It was a long day. The rain fell, and nobody came.\nSo they went home again! Nothing else was said"
    rows = [
        (4, f"Own words here. {passage}. And more of it."), (2, f"glued {passage}"), (9, passage.upper() + "."), (3, "Unique text only."),
        (5, "Same line once again.\n" * 8), (12, "OH!! NO!! " * 90), (6, None), (7, ""), (8, "... \n\n!!"), (None, passage), (1, "Licensed freely."), (11, "Licensed freely."),
    ]
    for least in (1, 10):
        found = substring_dedup.repeated_spans(docs(*rows), least).collect()
        assert {(r.doc_id, r.begin, r.end, r.words, r.units) for r in found} == brute_spans(rows, least)
    frame = docs(*rows, (4, rows[0][1]))
    cut = substring_dedup.without_repeats(frame, 10)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.count() == len(rows) + 1 and texts[3] == "Unique text only." and texts[6] is None
    assert "nobody came" in texts[2] and "nobody came" not in texts[4] and texts[4].startswith("Own words here.")
    assert substring_dedup.repeated_spans(docs().limit(0)).count() == 0


def test_whole_units_of_a_cut_passage_are_removed(docs):
    passage = "through the long valley. Two men were sitting by the cold river. They had seen nobody since the early spring. Then a boat"
    rows = [(1, f"She walked {passage} came by."), (2, f"He once rode {passage} sank there.")]
    found = substring_dedup.repeated_spans(docs(*rows)).collect()
    assert [(r.doc_id, rows[1][1][r.begin : r.end], r.words, r.units) for r in found] == [
        (2, " Two men were sitting by the cold river. They had seen nobody since the early spring.", 16, 2)
    ]


def test_short_units_are_removed_and_count(docs):
    rows = [
        (1, "red\nblue sky\ngreen"), (2, "red\nblue sky\ngreen\nown end here"), (5, "Same line again.\n" * 8),
        (6, "First 3.14 of www.some.org/a then."), (7, "Other 2.14 of www.some.net/a then."), (8, "Value 3.14 of www.some.org/a then."),
    ]
    for least, expected in ((1, {(2, 0, 18, 4, 3), (5, 17, 135, 21, 7)}), (4, {(2, 0, 18, 4, 3), (5, 17, 135, 21, 7)}), (5, {(5, 17, 135, 21, 7)})):
        found = substring_dedup.repeated_spans(docs(*rows), least).collect()
        assert {(r.doc_id, r.begin, r.end, r.words, r.units) for r in found} == expected
    assert {r.doc_id for r in substring_dedup.repeated_spans(docs(*rows)).collect()} == {2, 5}
