"""Fill-in-the-middle and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from graspmeter.llm import fill_middle, importance
from graspmeter.llm.fill_middle import Chunks, Text, chunk_ends, fill_in_middle, restored
from graspmeter.llm.importance import hashed_runs, importance_ranks, resampled, word_counts
from graspmeter.llm.prefix_crc import Running, crc_of_parts
from graspmeter.llm.queries import QUERIES
from pyspark.sql import functions as F


def brute_middle(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_middles_of_all_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_fill_middle"](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        *fields, output = brute_middle(row.doc_id, texts[row.doc_id])
        assert tuple(row)[1:] == (*fields, sha(output), sha(texts[row.doc_id] or ""))


def test_middles_of_odd_texts(docs):
    pick = random.Random(2)
    texts = [None, "", "x", "é", "🙂", "a<P>b", "<S", ">", "<M>", "<S<S>", "日本" * 9000, "ab" * 60_000, "<P" * 3000, "\x00\n"]
    texts += ["".join(pick.choice("ab<PSM>é🙂 ") for _ in range(pick.randrange(200))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "none"), (3, "other text of id 3"), (3, "other text of id 3")]
    found = fill_in_middle(docs(*rows)).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted((str(r.doc_id), r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect())
    want = sorted((str(i), t or "", *brute_middle(i, t)) for i, t in rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs().limit(0)).count() == 0


def test_chunks_follow_the_content(monkeypatch):
    pick = random.Random(4)
    shared = "".join(pick.choice("abcdefgh éß") for _ in range(30_000)).encode()
    ends = chunk_ends(shared)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(shared) and sizes.max() <= fill_middle.MOST and (sizes[:-1] >= fill_middle.LEAST).all()
    moved = chunk_ends(b"some words before " + shared)
    assert len({e - 18 for e in moved} & set(ends)) > 0.9 * len(ends)
    monkeypatch.setattr(fill_middle, "PIECE", 1000)
    assert chunk_ends(shared) == ends
    chunks = Chunks()
    first = Text(shared, chunks)
    known = dict(chunks.known)
    again = Text(shared, chunks)
    assert chunks.known == known and all(a is b for a, b in zip(first.parts, again.parts))
    text = shared.decode()
    assert again.points == len(text) and [again.place(k) for k in (0, 1, 777, len(text))] == [len(text[:k].encode()) for k in (0, 1, 777, len(text))]


def test_equal_digests_of_other_content_are_told_apart(monkeypatch):
    monkeypatch.setattr(fill_middle.xxhash, "xxh3_64_intdigest", lambda chunk: 0)
    chunks = Chunks(memory=200)
    texts = ["a" * 150, "é" * 75, "b<P>" * 30, "a" * 150]
    assert [(Text(t.encode(), chunks).points, Text(t.encode(), chunks).marked()) for t in texts] == [(len(t), "<P>" in t) for t in texts]


def test_markers_across_chunks():
    cut = chunk_ends(b"q" * 9000)[0]
    for shift in range(4):
        raw = b"q" * (cut - shift) + b"<M>" + b"q" * 5000
        assert Text(raw, Chunks()).marked() and not Text(raw.replace(b"<M>", b"<X>"), Chunks()).marked()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, longest=2):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_ranks(rows, target, percent=25, least=20, buckets=10_000):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    corpus = Counter(bucket(f) for _, text in rows for f in brute_features(text)[1])
    aim = Counter(bucket(f) for text in target for f in brute_features(text)[1])
    s_all, t_all = sum(corpus.values()), sum(aim.values())
    found = []
    for doc_id, text in rows:
        words, features = brute_features(text)
        gains = [math.floor(1000 * math.log((aim[b] + 1.0) * (s_all + 10000) / ((corpus[b] + 1.0) * (t_all + 10000)))) for b in map(bucket, features)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        found.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in found if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in found]


def test_ranks_of_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = [tuple(r) for r in QUERIES["op13_importance_resampling"](spark, sf).collect()]
    assert sorted(found) == sorted(brute_ranks(rows, target))


def test_ranks_of_odd_rows(spark, docs):
    pick = random.Random(6)
    words = ["the", "Of", "é", "日本", "x1", "İ", "ß", "a_b", "don't", "99"]
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(60))) for _ in range(200)]
    rows = [*enumerate([None, "", "one", "..", "x " * 30_000, *texts]), (None, "y " * 25), (None, "y " * 25), (5, texts[0]), (5, texts[0])]
    frame = docs(*rows)
    target = [None, "", "the Of é", "x1 x1"]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = [tuple(r) for r in importance_ranks(frame, aim).collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_ranks(rows, target)))
    drawn = [r for r in found if r[4] is not None]
    assert sorted(r[4] for r in drawn) == list(range(1, len(drawn) + 1))
    kept = resampled(frame, aim)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in drawn}
    assert importance_ranks(frame.limit(0), aim).count() == 0
    assert [r.rank for r in importance_ranks(docs((1, "a b")), aim.limit(0)).collect()] == [None]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_do_not_depend_on_pieces(longest, monkeypatch):
    pick = random.Random(8)
    texts = [None, " ", "x" * 500, *(" ".join("ab"[: pick.randrange(1, 3)] * pick.randrange(1, 90) for _ in range(pick.randrange(40))) for _ in range(40))]
    want = sorted((row, zlib.crc32(f.encode()) % 997) for row, t in enumerate(texts) for f in brute_features(t, longest)[1])

    def got():
        return sorted((int(r), int(b)) for rows, found in hashed_runs(texts, longest, 997) for r, b in zip(rows, found))

    assert got() == want
    monkeypatch.setattr(importance, "PIECE", 60)
    monkeypatch.setattr(importance, "STREAM", 300)
    assert got() == want
    assert list(word_counts(texts)) == [len(brute_features(t)[0]) for t in texts]


def test_crcs_of_parts_equal_the_library():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 5000):
        stream = rng.integers(0, 256, size, np.uint8).tobytes()
        ends = np.sort(rng.integers(0, size + 1, (50, 2)), axis=1)
        running = Running(stream)
        got = crc_of_parts(running.at(ends[:, 0]), running.at(ends[:, 1]), ends[:, 1] - ends[:, 0])
        assert got.tolist() == [zlib.crc32(stream[a:b]) for a, b in ends]
