"""Quality and toxicity by held-out accuracy, and the parts of the models."""

import numpy as np
import pandas as pd
import pytest
from graspmeter.llm import gru, toxicity
from graspmeter.llm.gbdt import train
from graspmeter.llm.quality import STATISTICS, keep_good, score_quality, statistics
from graspmeter.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "least"), [("op1_quality_classifier", "quality", 0.97), ("op8_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    rows = QUERIES[query](spark, SMALL).toPandas().merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    held = rows[rows.held_out]
    assert len(held) > 50 and rows.score.between(0, 1).all()
    assert (held.predicted == held[label]).mean() >= least


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score", [score_quality, toxicity.score_toxicity])
def test_odd_rows_are_scored(spark, docs, score):
    rows = [(i, "fine words here" if i % 2 else "BAD!! idiot ###") for i in range(60)]
    frame = docs(*rows, (100, None), (101, ""), (102, "x " * 40_000), (None, "fine words here"), (1, rows[1][1]))
    labels = labelled(spark, [(i, i % 2, 1 - i % 2) for i in range(60)] + [(1, None, None), (999, 1, 1), (None, 0, 0)])
    found = score(frame, labels).collect()
    assert len(found) == 65 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in found)
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    assert {r.score for r in found if r.doc_id == 100} == {r.score for r in found if r.doc_id == 101}
    assert score(frame, labels.limit(0)).count() == 65
    assert score(docs().limit(0), labels).count() == 0


def test_held_out_labels_are_not_used(spark, docs):
    frame = docs(*[(i, "fine words here" if i % 2 else "BAD!! ###") for i in range(40)])
    rows = [(i, i % 2, 0) for i in range(40)]
    plain = {r.doc_id: (r.score, r.held_out) for r in score_quality(frame, labelled(spark, rows)).collect()}
    turned = [(i, 1 - q if plain[i][1] else q, t) for i, q, t in rows]
    assert {r.doc_id: (r.score, r.held_out) for r in score_quality(frame, labelled(spark, turned)).collect()} == plain


def test_rejected_documents_go(spark, docs):
    frame = docs(*[(i, "fine words here" if i % 2 else "BAD!! ###") for i in range(60)], (None, "BAD!! ###"))
    kept = keep_good(frame, labelled(spark, [(i, i % 2, 0) for i in range(60)]))
    assert kept.columns == frame.columns
    # A row without id is judged by its text like all others.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in range(1, 60, 2))


def test_statistics_do_not_depend_on_pieces(monkeypatch):
    text = "Some words\nand MORE!! " * 50 + "\n\n" + "1234 | é"
    assert len(statistics(text)) == len(STATISTICS) and statistics(None) == statistics("")
    assert all(np.isfinite(statistics(""))) and all(np.isfinite(statistics("x" * 10**6)))


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 3))
    labels = (rows[:, 0] * rows[:, 1] > 0).astype(int)
    forest = train(rows, labels, trees=40)
    assert ((forest.score(rows) > 0.5) == labels).mean() > 0.97
    assert np.allclose(train(rows, np.ones(2000)).score(rows), train(rows, np.ones(2000)).score(rows[:1])[0])
    assert len(train(np.zeros((0, 3)), np.zeros(0)).score(rows)) == 2000


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    params = {k: v.astype(float) for k, v in gru.fresh({"word": {}, "head": {}, "tail": {}}).items()}
    ids, mask, labels = rng.integers(0, 6, (5, 4)), np.ones((5, 4)), np.array([0, 1, 1, 0.0])
    mask[3:, 1] = 0
    vectors = rng.normal(size=(6, gru.INPUT))

    def loss():
        logit = gru.logits(params, gru.gate_inputs(params, vectors), ids, mask)
        return np.log1p(np.exp(-logit * (2 * labels - 1))).mean()

    found, d_vectors, _ = gru.gradients(params, vectors, ids, mask, labels)
    for table, grad in [*((params[k], found[k]) for k in found), (vectors, d_vectors)]:
        at = tuple(rng.integers(0, n) for n in table.shape)
        kept = table[at]
        table[at] = kept + 1e-2
        above = loss()
        table[at] = kept - 1e-2
        below = loss()
        table[at] = kept
        assert grad[at] == pytest.approx((above - below) / 2e-2, abs=2e-5)


def test_windows_hold_every_word():
    for n in (0, 1, 48, 49, 80, 81, 500):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, s + toxicity.WINDOW)}
        assert covered >= set(range(n)) and (n <= 48 or starts.max() + 48 == n)


def test_score_is_the_worst_window():
    rows = {"word": {"idiot": 1}, "head": {}, "tail": {}}
    scorer = toxicity.Scorer(toxicity.Model(rows, gru.fresh(rows)))
    words = [f"w{i}" for i in range(30)] + ["idiot"] + [f"v{i}" for i in range(100)]
    alone = [scorer.score([" ".join(words[s : s + 48])])[0] for s in toxicity.window_starts(len(words))]
    assert scorer.score(["  ".join(words), None])[0] == pytest.approx(max(alone), abs=1e-6)


def sampled(spark, *rows):
    return spark.createDataFrame(rows, "id string, label int, text string")


def test_training_judges_all_windows(spark):
    """The one telling word stands late in a long text; the window that holds it comes out highest."""
    long = [f"w{i}" for i in range(3000)]
    rows = [(f"y{k}", 1, " ".join([*long[:2500], "Idiot!", *long[2500:]])) for k in range(6)]
    rows += [(f"n{k}", 0, " ".join(long)) for k in range(20)] + [("e", 0, ""), ("z", 0, None)]
    model = toxicity.known_features(sampled(spark, *rows), 50)
    assert "idiot" in model.rows["word"] and all(len(known) <= 50 for known in model.rows.values())
    chosen = toxicity.chosen_windows(sampled(spark, *rows), model)
    best = chosen[(chosen.label == 1) & (chosen.place == 0)]
    assert len(best) == 6 and all("idiot" in text.split() for text in best.words)
    counts = chosen.groupby("id").size()
    assert counts.max() <= toxicity.HIGHEST + toxicity.CHANCE and set(counts.index) == {r[0] for r in rows}
    assert set(chosen[chosen.id.isin(["e", "z"])].words) == {""}


def test_features_tell_how_labels_are_spread(spark):
    rows = [(f"y{k}", 1, "Bad word") for k in range(8)] + [(f"n{k}", 0, "good word " * 3) for k in range(12)] + [("r", 0, "rare")]
    model = toxicity.known_features(sampled(spark, *rows), 1000)
    assert set(model.rows["word"]) == {"bad", "good", "word"}
    lean = {name: float(model.params["word leaning"][row]) for name, row in model.rows["word"].items()}
    even = 8 * 8 / 21
    assert lean["bad"] == pytest.approx((8 - even) / np.sqrt(even * 13 / 21 + toxicity.PRIOR) / toxicity.SPREAD, abs=1e-6)
    assert lean["good"] < 0 < lean["bad"] and abs(lean["word"]) < 0.1
    assert set(model.rows["inner"]) == {"good", "word"} and "ba" not in model.rows["head"]


def test_rows_of_words_are_those_of_their_features():
    words = ["", "a", "idiot", "Übermäßig", "x" * 40, "word", "wor"]
    names = {part: sorted({n for w in words[::2] for n in gru.features(w)[part] if n}) for part in gru.PARTS}
    rows = {part: {name: i + 1 for i, name in enumerate(known)} for part, known in names.items()}
    for part, found in gru.lexicon(rows, words).items():
        assert found.tolist() == [[rows[part].get(name, 0) for name in gru.features(w)[part]] for w in words]
    assert not any(found.any() for found in gru.lexicon({}, words).values())


def test_a_repeated_id_counts_once(spark, docs):
    frame = docs((1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (5, "held"))
    known = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (9, 0)], "id long, label int")
    texts = frame.selectExpr("doc_id id", "text")
    rows = {(r.id, r.label): r.text for r in toxicity.sample_texts(texts, known, 10).collect()}
    assert rows.keys() <= {(1, 1), (2, 0)} and rows.get((1, 1), "a") in ("a", "b")


def test_passages_lie_whole_in_some_window():
    for n in (49, 60, 100, 500):
        starts = toxicity.window_starts(n)
        for first in range(n - toxicity.STRIDE + 1):
            assert any(s <= first and first + toxicity.STRIDE <= s + toxicity.WINDOW for s in starts)


def test_scores_do_not_depend_on_groups(monkeypatch):
    rows = {"word": {"idiot": 1}, "head": {"abc": 1, "abcd": 2}, "tail": {}, "inner": {"word": 1}}
    model = toxicity.Model(rows, gru.fresh(rows), True)
    texts = ["", None, "one idiot", "word " * 3000, *(" ".join(f"abcd{i * k} w{k}" for k in range(i)) for i in range(80))]
    want = toxicity.Scorer(model).score(texts)
    for group, piece, cache in ((1, 1 << 20, 5), (1 << 18, 40, 5), (300, 1000, 50)):
        monkeypatch.setattr(toxicity, "GROUP", group)
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "CACHE", cache)
        assert toxicity.Scorer(model).score(texts) == pytest.approx(want, abs=1e-6)


def test_means_are_of_known_rows():
    rng = np.random.default_rng(2)
    table, rows = rng.normal(size=(9, 4)).astype(np.float32), rng.integers(0, 9, (50, 6)) * (rng.random((50, 6)) < 0.3)
    table[0] = 0
    want = [np.mean([table[r] for r in row if r], axis=0) if row.any() else np.zeros(4) for row in rows]
    assert np.allclose(gru.means_of(table, rows), want, atol=1e-6)
    assert not gru.means_of(table, np.zeros((3, 2), np.int64)).any()
