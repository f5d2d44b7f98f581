"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments of 22, 21 and 21 bits. If two fingerprints differ in at
most three bits, then either one segment is equal and another differs in one bit at most, or
each segment differs in exactly one bit. For the first case a key joins the equal segment with
a codeword index of the other one, for the second with codeword indices of two segments and the
parities of all three. A fingerprint is filed under its nearest indices and looks up all
indices that a one-bit neighbour can have as nearest, so equal keys find every such pair.
What the keys bring together is verified by the bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graspmeter.llm.common import row_key, written
from graspmeter.llm.components import connected_components
from graspmeter.llm.golay import code

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The distance that three segments with one-bit neighbours cover.
MAX_BITS = 3
#: Bytes of text whose words are held at once.
PIECE = 1 << 20


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """Lists of the words of a text, A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    start = 0
    while start < len(raw):
        end = start + PIECE
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        yield raw[start:end].split()
        start = end


def fingerprint(text: str | None, size: int) -> int:
    """Majority bits of the hashes of all ``size``-word shingles, as a signed 64-bit number.

    A text of fewer words is one shingle; a text without words has fingerprint zero.
    """
    counts, total, held = np.zeros(64, np.int64), 0, []
    for words in words_of(text):
        held += words
        if len(held) >= size:
            counts, total = _add(counts, total, held, size)
            held = held[len(held) - size + 1 :]
    if not total:
        if not held:
            return 0
        counts, total = _add(counts, total, held, len(held))
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def _add(counts: np.ndarray, total: int, words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64, len(starts))
    for part in range(0, len(hashes), 1 << 14):
        bits = hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts = counts + np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0)
    return counts, total + len(hashes)


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), udf(F.col(text_col)).alias("fp"))


def filed_keys(fps: np.ndarray) -> np.ndarray:
    """Keys under which fingerprints are filed, a row for each."""
    segments, parity = _split(fps)
    nearest = [code().nearest(s)[0] for s in segments]
    keys = [_key(i, j, segments[i], nearest[j]) for i, j in _pairs()]
    return np.stack([*keys, _last(nearest[0], nearest[1], parity)], axis=1)


def sought_keys(fps: np.ndarray) -> np.ndarray:
    """Keys that a fingerprint looks up: with some of them within three bits is filed, a row for each."""
    segments, parity = _split(fps)
    near = [code().near(s) for s in segments]
    keys = [_key(i, j, segments[i][:, None], near[j]) for i, j in _pairs()]
    both = _last(near[0][:, :, None], near[1][:, None, :], (parity ^ 7)[:, None, None])
    return np.concatenate([*keys, both.reshape(len(fps), -1)], axis=1)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(3) for j in range(3) if i != j]


def _split(fps: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    segments = [(fps >> low) & ((1 << width) - 1) for low, width in SEGMENTS]
    return segments, sum((np.bitwise_count(s).astype(np.int64) & 1) << i for i, s in enumerate(segments))


def _key(i: int, j: int, equal: np.ndarray, index: np.ndarray) -> np.ndarray:
    return np.int64(i * 3 + j) << 40 | equal << 12 | index


def _last(first: np.ndarray, second: np.ndarray, parity: np.ndarray) -> np.ndarray:
    return np.int64(9) << 40 | first << 15 | second << 3 | parity


def _keyed(nodes: DataFrame, keys_of, name: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            keys = np.sort(keys_of(fps), axis=1)
            new = np.c_[np.ones(len(fps), bool), keys[:, 1:] != keys[:, :-1]]
            yield pd.DataFrame({"key": keys[new], name: np.repeat(fps, new.sum(axis=1))})

    return nodes.select("fp").mapInPandas(run, f"key long, {name} long")


def linked_fingerprints(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys cover distances up to {MAX_BITS}")
    pairs = _keyed(nodes, sought_keys, "a").join(_keyed(nodes, filed_keys, "b"), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_groups(
    docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each row with its fingerprint (16 hex digits) and ``component_id``, the smallest id reachable by links.

    Rows of equal fingerprints are one node, so copies are never paired. Null and empty texts
    have fingerprint zero and are linked like any other; a row without id takes part, and its
    group has no component id if no row of it has an id; repeated rows are kept; other columns
    are not read; an empty table gives an empty result.
    """
    found = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = written(connected_components(linked_fingerprints(nodes, max_bits)), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return found.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, of several the one of the smallest text hash.

    Rows without id rank behind all others, and one stays of a group that has no id. Of rows
    that share id and text one stays. Nulls and empty tables are as in ``near_groups``; all
    columns stay as they are.
    """
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    groups = near_groups(keyed.select("__key", text_col), size, max_bits, "__key", text_col)
    dropped = groups.where(F.col("__key") != F.col("component_id")).select(F.col("__key").alias("__of")).distinct()
    kept = keyed.join(dropped, F.col("__key") == F.col("__of"), "left_anti")
    return kept.dropDuplicates(["__key"]).drop("__key")
