"""Toxicity: a small bidirectional recurrent network over all overlapping windows of a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graspmeter.llm import gru
from graspmeter.llm.common import held_out, written

#: Words of a window, and how far the next one begins: any passage of ``STRIDE`` words lies whole in some window.
WINDOW, STRIDE = 48, 24
#: Toxic documents (twice as many others) that training takes at most.
SAMPLE = 1_500
#: Documents of the sample that must have a feature, at least, and features of a part at most: those that tell most.
LEAST_TEXTS, FEATURES = 5, 3_000
#: Variance that is added to a feature's own, which keeps rare ones small, and deviations that make a leaning of one.
PRIOR, SPREAD = 2.0, 8.0
#: Windows of a document that training takes: those of the highest scores, and some by chance.
HIGHEST, CHANCE = 2, 2
#: Passes over the windows that the features choose, and over those that the network chooses.
PASSES = (5, 5)
#: Steps that a pass has at least; a small sample is gone through several times for that.
LEAST_STEPS = 60
#: Words that a worker remembers, windows that it scores at once, characters it splits at once.
CACHE, CHUNK, PIECE = 400_000, 2_048, 1 << 20
#: Characters of texts whose words are looked up together.
GROUP = 1 << 18
SPACE = re.compile(r"\s")


def pieces(text: str | None) -> Iterator[list[str]]:
    """The words of a text, in lists."""
    text, start = text or "", 0
    while start < len(text):
        cut = SPACE.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield text[start:end].split()
        start = end


def window_starts(words: int) -> np.ndarray:
    """Beginnings of overlapping windows that hold every word; the last one ends with the text."""
    if words <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.r_[np.arange(0, words - WINDOW, STRIDE), words - WINDOW])


@dataclass
class Model:
    rows: gru.Rows
    params: gru.Params
    trained: bool = False


class Scorer:
    """Scores texts; the gate inputs of words met are kept until they are too many."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {"": 0}
        self.raw: dict[str, int] = {}
        self.table = np.zeros((2, 4096, gru.GATES), np.float32)

    def learn(self, words: set[str]) -> None:
        forms = {word: gru.plain(word) for word in words if word not in self.raw}
        unknown = list({form for form in forms.values() if form not in self.places})
        if unknown:
            start, end = len(self.places), len(self.places) + len(unknown)
            if end > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros((2, end, gru.GATES), np.float32)], axis=1)
            self.table[:, start:end] = self.gate_inputs(unknown)
            self.places.update(zip(unknown, range(start, end)))
        self.raw.update((word, self.places[form]) for word, form in forms.items())

    def gate_inputs(self, unknown: list[str]) -> np.ndarray:
        return gru.gate_inputs(self.model.params, gru.vectors_of(self.model.params, gru.lexicon(self.model.rows, unknown)))

    def places_of(self, texts: list[str | None], free: Callable[[], bool]) -> Iterator[tuple[int, np.ndarray]]:
        """For each text its words as places in the table; ``free`` tells whether no places are in use.

        Short texts learn their words together, a long one piece by piece.
        """
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or "") <= GROUP):
                size += len(texts[end] or "")
                end += 1
            if len(self.raw) > CACHE and free():
                self.clear()
            together = end - start > 1 or size <= PIECE
            split = [list(pieces(text)) for text in texts[start:end]] if together else [pieces(texts[start])]
            if together:
                self.learn({word for parts in split for words in parts for word in words})
            for number, parts in enumerate(split, start):
                found = [np.zeros(0, np.int32)]
                for words in parts:
                    if not together:
                        self.learn(set(words))
                    found.append(np.fromiter(map(self.raw.__getitem__, words), np.int32, len(words)))
                yield number, np.concatenate(found)
            start = end

    def windows(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(text numbers, first words, logits)`` of all windows, in parts; a text without words is one empty window."""
        ids, sizes, owners, firsts = [], [], [], []
        held = 0
        for number, words in self.places_of(texts, lambda: not held):
            flat = words
            starts = window_starts(len(flat))
            flat = np.pad(flat, (0, max(0, WINDOW - len(flat))))
            for some in np.array_split(starts, -(-len(starts) // CHUNK)):
                ids.append(flat[some[:, None] + np.arange(WINDOW)])
                sizes.append(np.full(len(some), min(WINDOW, len(words))))
                owners.append(np.full(len(some), number))
                firsts.append(some)
                held += len(some)
                if held >= CHUNK:
                    yield np.concatenate(owners), np.concatenate(firsts), self.logits(ids, sizes)
                    ids, sizes, owners, firsts, held = [], [], [], [], 0
        if held:
            yield np.concatenate(owners), np.concatenate(firsts), self.logits(ids, sizes)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The largest window score of each text."""
        best = np.full(len(texts), -np.inf, np.float32)
        for owners, _, logits in self.windows(texts):
            np.maximum.at(best, owners, logits)
        return gru.sigmoid(best.astype(float))

    def logits(self, ids: list, sizes: list) -> np.ndarray:
        mask = (np.arange(WINDOW)[:, None] < np.concatenate(sizes)[None]).astype(np.float32)
        return gru.logits(self.model.params, self.table, np.ascontiguousarray(np.concatenate(ids).T), mask)


class Leaning(Scorer):
    """Scores a window by its word that leans most to the label, for a network that is not trained yet."""

    def gate_inputs(self, unknown: list[str]) -> np.ndarray:
        leaning = gru.leanings_of(self.model.params, gru.lexicon(self.model.rows, unknown))[:, 0]
        return np.broadcast_to(leaning[None, :, None], (2, len(unknown), gru.GATES))

    def logits(self, ids: list, sizes: list) -> np.ndarray:
        held = np.arange(WINDOW)[None] < np.concatenate(sizes)[:, None]
        return np.where(held, self.table[0, :, 0][np.concatenate(ids)], -9).max(axis=1)


def sample_texts(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(id, label, text)`` of a bounded number of labelled documents that are not held out, chosen by hash.

    A label counts for one text: of rows that share an id the text with the smallest hash is taken.
    """
    known = labels.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(2 * sample)
    chosen = chosen.unionByName(known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(sample))
    text = F.min_by("text", F.xxhash64("text")).alias("text")
    return written(docs.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(text), "sample")


def known_features(sampled: DataFrame, size: int) -> Model:
    """The features that tell most of the label, each with how far it is from an even spread, and fresh parameters.

    How many sampled documents of each label have a feature is counted where the texts are; at
    most ``size`` features of each part come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                found = {(part, name) for words in pieces(text) for word in set(map(gru.plain, words)) for part, names in gru.features(word).items() for name in names}
                for key in found:
                    counts.setdefault(key, [0, 0])[int(label)] += 1
        keys = [key for key in counts if key[1]]
        yield pd.DataFrame(
            {"part": [k[0] for k in keys], "name": [k[1] for k in keys], "no": [counts[k][0] for k in keys], "yes": [counts[k][1] for k in keys]}
        ).astype({"part": str, "name": str, "no": np.int64, "yes": np.int64})

    labels = {row.label: row.n for row in sampled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = labels.get(1, 0) / max(1, sum(labels.values()))
    counted = sampled.select("label", "text").mapInPandas(run, "part string, name string, no long, yes long")
    counted = counted.groupBy("part", "name").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).withColumn("n", F.col("no") + F.col("yes"))
    even = F.col("n") * share
    counted = written(counted.where(F.col("n") >= LEAST_TEXTS).withColumn("z", (F.col("yes") - even) / F.sqrt(even * (1 - share) + PRIOR)), "features")
    rows, leaning = {}, {}
    for part in gru.PARTS:
        best = counted.where(F.col("part") == part).orderBy(F.desc(F.abs("z")), "name").limit(size).select("name", "z").toPandas().sort_values("name")
        rows[part] = {name: i + 1 for i, name in enumerate(best["name"])}
        leaning[part] = np.clip(best["z"].to_numpy(np.float32) / SPREAD, -1, 2)
    return Model(rows, gru.fresh(rows, leaning=leaning))


def chosen_windows(sampled: DataFrame, model: Model) -> pd.DataFrame:
    """``(id, label, place, words)``: of each sampled document the windows of the highest scores, and some by chance.

    All windows of the sampled texts are judged where the texts are; windows with the same words
    are one. ``place`` counts from 0 by score and is -1 for those by chance.
    """
    sent = sampled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = (Scorer if sent.value.trained else Leaning)(sent.value)
        for batch in batches:
            texts = list(batch["text"])
            owners, firsts, logits = map(np.concatenate, zip(*scorer.windows(texts)))
            rows = []
            for number, (name, label, text) in enumerate(zip(batch["id"].astype(str), batch["label"], texts)):
                words = [gru.plain(word) for part in pieces(text) for word in part]
                mine = np.flatnonzero(owners == number)
                ordered = mine[np.lexsort((firsts[mine], -logits[mine]))]
                by_chance = ordered[np.argsort([xxhash.xxh32_intdigest(f"{name}:{firsts[at]}") for at in ordered], kind="stable")[:CHANCE]]
                seen: set[str] = set()
                for place, at in [*enumerate(ordered[: 4 * HIGHEST]), *((-1, at) for at in by_chance)]:
                    window = " ".join(words[firsts[at] : firsts[at] + WINDOW])
                    if window not in seen and (place < 0 or len(seen) < HIGHEST):
                        seen.add(window)
                        rows.append((name, int(label), len(seen) - 1 if place >= 0 else -1, float(logits[at]), window))
            yield pd.DataFrame(rows, columns=["id", "label", "place", "logit", "words"])

    frame = sampled.mapInPandas(run, "id string, label int, place int, logit double, words string").toPandas()
    # The order must not depend on the tasks.
    return frame.sort_values(["id", "place", "words"]).reset_index(drop=True)


def trained(model: Model, frame: pd.DataFrame, passes: int, rng: np.random.Generator) -> Model:
    """The network after some passes over the chosen windows.

    A document has one label, its windows have none: the highest window of a toxic document is
    taken for toxic, its others only if they score high too.
    """
    windows = frame[(frame["label"] == 0) | (frame["place"] == 0) | ((frame["place"] > 0) & (frame["logit"] >= (0 if model.trained else 1)))]
    places: dict[str, int] = {"": 0}
    split = [[places.setdefault(w, len(places)) for w in text.split(" ")] if text else [] for text in windows["words"]]
    ids = np.zeros((WINDOW, len(split)), np.int64)
    mask = np.zeros((WINDOW, len(split)), np.float32)
    for number, words in enumerate(split):
        ids[: len(words), number] = words
        mask[: len(words), number] = 1
    labels, lexical = windows["label"].to_numpy(np.float32), gru.lexicon(model.rows, list(places))
    adam = gru.Adam(model.params, rate=0.01)
    for _ in range(passes):
        for _ in range(-(-LEAST_STEPS * gru.BATCH // max(1, len(split)))):
            gru.train_pass(model.params, adam, lexical, ids, mask, labels, rng)
        adam.rate *= 0.8
    return Model(model.rows, model.params, trained=True)


def fit(sampled: DataFrame, size: int = FEATURES) -> Model:
    """The network, from a written sample (id, label, text)."""
    model, rng = known_features(sampled, size), np.random.default_rng(11)
    if sampled.select("label").distinct().count() < 2:
        return model
    for passes in PASSES:
        model = trained(model, chosen_windows(sampled, model), passes, rng)
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``held_out, score, predicted`` of every row; the score is that of the worst window.

    Null and empty texts have the score of an empty window; rows without id are scored but
    never learned from; repeated rows are scored each; labels that are null or without document
    are left out; without labels of both kinds the network stays as it began. Other columns are
    not read; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(fit(sample_texts(texts, known, sample)))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for batch in batches:
            yield pd.Series(scorer.score(list(batch)))

    return texts.select("id", held_out("id").alias("held_out"), scored("text").alias("score")).select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
