"""Fill-in-the-middle transformation with memorised content-defined chunks.

A rolling hash over the bytes chunks a text where its content says so, so texts that share
passages share chunks. A chunk's summary (its code points, whether a marker stands inside, its
first and last bytes) is kept under the chunk's digest and used again only for equal content.
Running sums of the chunks' code points tell in which chunk a cut lies, the bytes that meet at
chunk boundaries whether a marker spans one; only the chunk of a cut is looked into.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes that the rolling hash looks back, least and most bytes of a chunk, and bits that must be zero at its end.
REACH, LEAST, MOST, ZERO_BITS = 32, 64, 4096, 9
#: Bytes that are hashed at once, and bytes of chunks that a worker remembers.
PIECE, MEMORY = 1 << 20, 1 << 25
#: A random number for each byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)


def rolling(raw: bytes) -> np.ndarray:
    """For each place the hash of the ``REACH`` bytes that end there: the sum of their numbers, older ones shifted up.

    A sum over twice as many bytes is that of the newer half and the shifted one of the older half.
    """
    sums = GEAR[np.frombuffer(raw, np.uint8)]
    reach = 1
    while reach < REACH:
        sums[reach:] += sums[:-reach] << np.uint32(reach)
        reach *= 2
    return sums


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``; the last is its length. Pieces do not change them."""
    wanted = []
    for start in range(0, len(raw), PIECE):
        before = min(start, REACH - 1)
        sums = rolling(raw[start - before : start + PIECE])[before:]
        wanted.append(np.flatnonzero(sums >> np.uint32(32 - ZERO_BITS) == 0) + start + 1)
    places = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
    ends, last = [], 0
    while last < len(raw):
        at = int(np.searchsorted(places, last + LEAST))
        last = min(int(places[at]) if at < len(places) else len(raw), last + MOST, len(raw))
        ends.append(last)
    return ends


class Summary(NamedTuple):
    content: bytes
    points: int
    marked: bool


def starts_of_points(chunk: bytes) -> np.ndarray:
    """Places of the bytes that begin a code point."""
    return np.flatnonzero(np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80)


class Chunks:
    """Summaries of chunks by digest, at most so many bytes of content."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.known = memory, 0, {}

    def summary(self, chunk: bytes) -> Summary:
        digest = xxhash.xxh3_64_intdigest(chunk)
        found = self.known.get(digest)
        if found is not None and found.content == chunk:
            return found
        made = Summary(chunk, len(starts_of_points(chunk)), any(m in chunk for m in MARKERS))
        if found is None:
            if self.held + len(chunk) > self.memory:
                self.known, self.held = {}, 0
            self.known[digest] = made
            self.held += len(chunk)
        return made


class Text:
    """A text as chunks: its code points, whether it holds a marker, and where its code points begin."""

    def __init__(self, raw: bytes, chunks: Chunks):
        self.raw, self.ends = raw, chunk_ends(raw)
        self.parts = [chunks.summary(raw[a:b]) for a, b in zip([0, *self.ends], self.ends)]
        self.until = np.cumsum([part.points for part in self.parts], dtype=np.int64)
        self.points = int(self.until[-1]) if self.parts else 0

    def marked(self) -> bool:
        reach = len(PREFIX) - 1
        seams = (left.content[-reach:] + right.content[:reach] for left, right in zip(self.parts, self.parts[1:]))
        return any(part.marked for part in self.parts) or any(m in seam for seam in seams for m in MARKERS)

    def place(self, point: int) -> int:
        """The byte at which a code point begins; the length for the number of code points."""
        at = int(np.searchsorted(self.until, point, side="right"))
        if at == len(self.parts):
            return len(self.raw)
        begin = self.ends[at] - len(self.parts[at].content)
        before = int(self.until[at - 1]) if at else 0
        return begin + int(starts_of_points(self.parts[at].content)[point - before])


def transformed(raw: bytes, draws: tuple[int, int, int, int], plain_from: int, spm_below: int, chunks: Chunks) -> tuple:
    """Code points, form, code points of prefix and middle (None if plain) and the output of one text."""
    text = Text(raw, chunks)
    n = text.points
    if not raw or draws[2] % 100 >= plain_from or text.marked():
        return n, "plain", None, None, raw
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = text.place(first), text.place(second)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if draws[3] % 100 < spm_below:
        return n, "spm", first, second - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``n, form, prefix_chars, middle_chars, output`` of every row.

    Four numbers from the hash of seed and id draw the two cuts, whether the text stays plain
    (third, of 100, ``plain_from`` or more) and the form (fourth, of 100, below ``spm_below``).
    Null counts as the empty text; that and texts with a marker stay plain. Rows without id
    draw as the empty id, rows with the same id draw the same numbers. Other columns are not
    read; an empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output binary")
    def made(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        chunks = Chunks()
        for texts, *numbers in batches:
            rows = [transformed(bytes(text), drawn, plain_from, spm_below, chunks) for text, drawn in zip(texts, zip(*(k.tolist() for k in numbers)))]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            yield pd.DataFrame(
                {
                    "n": np.array(n, np.int64), "form": pd.Series(form, dtype=object), "prefix_chars": pd.array(prefix, "Int64"),
                    "middle_chars": pd.array(middle, "Int64"), "output": pd.Series(output, dtype=object),
                }
            )

    found = docs.select(F.col(id_col), made(raw, *draws).alias("made"))
    fields = [F.col(f"made.{name}").alias(name) for name in ("n", "form", "prefix_chars", "middle_chars")]
    return found.select(id_col, *fields, F.col("made.output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The exact text from output and form; markers stand only where the transformation put them."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, third = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
