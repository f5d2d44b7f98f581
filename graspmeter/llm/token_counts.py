"""Token counts of a byte-level BPE by rank-synchronous merging of arrays.

The distinct pre-tokens of a batch lie end to end in one numpy array. In each round every
sequence that still has a known pair merges all occurrences of its own lowest-rank pair, and
the symbols that are left at the end are the tokens. A pair that contains a merged symbol
ranks behind the pair that made it, so all occurrences of a pair may merge at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published pre-token pattern of this family of vocabularies.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct chunks that a worker remembers, before it starts anew.
CACHE = 600_000
#: Characters of text whose pre-tokens are held at once.
PIECE = 1_000_000
NONE = np.iinfo(np.int32).max
#: A space behind white space, and the spaces at which a text can be split.
MIXED = re.compile(r"\s ")
BOUNDARY = regex.compile(r"(?<=\P{White_Space}) ")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class Merger:
    """Ranks of a vocabulary file as sorted arrays, and the counts of the pre-tokens met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first = np.array([vocab[c] for c in byte_letters()], np.int32)
        specials = [t["content"] for t in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(b) for b in raw], np.int64)
        total = np.ones(len(raw), np.int64)
        total[length == 0] = 0
        symbols = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), length)
        ranks = self.pair_ranks(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(owner)])
            done = lowest == NONE
            if done.any():
                total[owner[starts[done]]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # In a run of overlapping pairs (a a a) every other one merges, from the left.
            run = np.flatnonzero(np.r_[True, np.diff(chosen) > 1])
            offset = np.arange(len(chosen)) - np.repeat(run, np.diff(np.r_[run, len(chosen)]))
            chosen = chosen[offset % 2 == 0]
            symbols[chosen] = self.merged[ranks[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            # Only the pairs beside a merged symbol have new ranks.
            at = moved[chosen]
            stale = np.unique(np.r_[at, at[at > 0] - 1])
            self.update(symbols, owner, ranks, stale)
        return total

    def pair_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), NONE, np.int32)
        self.update(symbols, owner, ranks, np.arange(len(symbols)))
        return ranks

    def update(self, symbols: np.ndarray, owner: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> None:
        ranks[at] = NONE
        inner = at[at < len(symbols) - 1]
        inner = inner[owner[inner] == owner[inner + 1]]
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])

    def chunks(self, text: str) -> Iterator[tuple[list[str], list[str]]]:
        """Parts of ``text`` that no pre-token spans: the first of a piece, and those behind a space, without it.

        A space behind another character always begins a pre-token, so texts without other
        runs of white space are just split at their spaces.
        """
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > PIECE and (cut := BOUNDARY.search(text, pos=start + PIECE)):
                end = cut.start()
            piece = text[start:end]
            if MIXED.search(piece):
                parts = BOUNDARY.split(piece[1:])
                parts[0] = piece[0] + parts[0]
            else:
                parts = piece.split(" ")
                if parts[0] == "":
                    del parts[0]
                    parts[0] = " " + parts[0]
            first, parts = parts[0], parts[1:]
            yield [first], parts
            start = end

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string counts as one token."""
        result = [0] * len(texts)
        held: list[tuple[int, list[str], list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            result[i] += len(parts) - 1
            for part in parts:
                for bare, spaced in self.chunks(part):
                    held.append((i, bare, spaced))
                    size += 2 * len(spaced)
                    if size >= PIECE:
                        self.settle(held, result)
                        held, size = [], 0
        self.settle(held, result)
        return result

    def settle(self, held: list[tuple[int, list[str], list[str]]], result: list[int]) -> None:
        """Add what the held chunks count; ``known`` has them without the space they begin with."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = [part for part in set().union(*(spaced for *_, spaced in held)) if part not in self.known]
        bare = [part for _, parts, _ in held for part in parts]
        counts = self.count_chunks([" " + part for part in new] + bare)
        self.known.update(zip(new, counts))
        for (i, _, spaced), n in zip(held, counts[len(new) :]):
            result[i] += n + sum(map(self.known.__getitem__, spaced))

    def count_chunks(self, chunks: list[str]) -> list[int]:
        found = [self.pattern.findall(chunk) for chunk in chunks]
        words = list(set().union(*found)) if found else []
        tokens = dict(zip(words, self.count(words).tolist()))
        return [sum(map(tokens.__getitem__, parts)) for parts in found]


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """The vocabulary, read once by each worker."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, UTF-8 bytes, tokens and whether they exceed ``limit``, for every row.

    ``vocabulary`` is the path of a byte-level BPE file on every worker. Null and empty texts
    have 0 of both; repeated rows are counted each; other columns are not read.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = merger(vocabulary).tokens
        for batch in batches:
            yield pd.Series(tokens([t or "" for t in batch]), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
