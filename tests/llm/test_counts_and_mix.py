"""Token counts, URL filters and mixing."""

import random
from collections import defaultdict

import public_tokenizers
import pytest
from graspmeter.llm.mixing import mix
from graspmeter.llm.queries import QUERIES, URL_RULES
from graspmeter.llm.token_counts import count_tokens, merger
from graspmeter.llm.url_filters import judge_urls, split_url
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_counts_equal_the_library(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in QUERIES["op3_token_counts"](spark, sf).collect():
        n = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len(texts[row.doc_id].encode()), n > 512)


def test_counts_of_odd_texts(docs, library, monkeypatch):
    pick = random.Random(3)
    letters = "aab \n\t\x1c\x85\xa0   '0²½Ⅳßéñ日🙂\u0301_-$"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(30))) for _ in range(500)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoft", "a" * 50_000, "ab " * 30_000, "", " ", "  x", "I'll they've 's"]
    counts = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert merger(VOCABULARY).tokens(texts) == counts
    monkeypatch.setattr("graspmeter.llm.token_counts.PIECE", 50)
    assert merger(VOCABULARY).tokens(texts) == counts
    rows = count_tokens(docs((1, None), (1, None), (2, ""), (None, "a b")), VOCABULARY, 1).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [
        ("1", 0, 0, False), ("1", 0, 0, False), ("2", 0, 0, False), ("None", 3, 2, True),
    ]
    assert count_tokens(docs().limit(0), VOCABULARY, 1).count() == 0


def brute_rule(url, rules):
    host, path = split_url(url)
    best = None
    for action, rule in rules:
        rhost, slash, rpath = rule.partition("/")
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(slash + rpath):
            if best is None or (len(rule), len(rhost), action == "block") > best[0]:
                best = ((len(rule), len(rhost), action == "block"), rule, action)
    return best[1:] if best else (None, "allow")


def test_urls_equal_brute_force(spark):
    rules = [*URL_RULES, ("block", "org"), ("allow", "a.org/x/y"), ("block", "a.org/x/yz/"), ("allow", "net/es/"), ("allow", "b.org/")]
    pick = random.Random(5)
    parts = (["http", "HTTPS", ""], ["com", "WWW.Example.com", "xexample.com", "a.example.com", "q.a.org", "b.org", "k.net", ".net", ""])
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/", "/es//x", "/fr/?a=/en/", "/x/y", "/x/yz", "/x/yz/", "/x/yzq#/", "?/en/", "#top"]
    urls = [f"{pick.choice(parts[0])}://{pick.choice(parts[1])}{pick.choice(paths)}" for _ in range(400)] + [None, "", "no scheme/en/", "://", "a://b://c"]
    frame = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, verdict string")
    rows = judge_urls(frame, rules).collect()
    assert len(rows) == 2 * len(urls)
    for row in rows:
        assert (row.host, row.path) == split_url(urls[row.page_id])
        assert (row.rule, row.verdict) == brute_rule(urls[row.page_id], rules)
    assert judge_urls(frame.limit(0), rules).count() == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-6 and open_:
        each, total = left, sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += each * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix_meets_its_targets(docs):
    pick = random.Random(6)
    rows = [(i, " ".join(["w"] * pick.choice([0, 1, 5, 80])), pick.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)]
    rows += [(600, None, "a"), (602, "twice here", "b"), (602, "twice here", "b"), (None, "no id", "c"), (601, "\x1c \u00a0", "empty")]
    frame = docs(*rows)
    found = mix(frame).collect()
    assert len(found) == len(rows)
    size_of = {(i, s): len([w for w in (t or "").replace("\t", " ").split(" ") if w]) for i, t, s in rows}
    source_of, sizes = {i: s for i, _, s in rows}, defaultdict(int)
    for i, _, s in rows:
        sizes[s] += size_of[i, s]
    target, taken = brute_targets(sizes), defaultdict(int)
    for row in found:
        source = source_of[row.doc_id]
        assert row.size == size_of[row.doc_id, source] and row.source_size == sizes[source]
        assert row.target == pytest.approx(target[source]) and 0 <= row.taken <= 2 * row.size
        taken[source] += row.taken
    assert all(taken[s] == int(target[s] + 0.5) for s in sizes)
    assert sorted(map(str, found)) == sorted(map(str, mix(frame.repartition(7)).collect()))
    assert mix(docs().limit(0)).count() == 0 and mix(docs((1, None), (2, ""))).agg({"taken": "sum"}).first()[0] == 0
