"""Main text of pages by wrapper induction over the pages of a host.

Each page becomes a tree of blocks. A few pages of each host, chosen by hash, are its patterns;
all pages of the host are aligned with each of them by simple tree matching. A text that stands
at a matched place of a pattern and reads the same on nearly all pages belongs to the template;
texts that vary fill slots. Several patterns, as a single one may be an odd page of its host. Slots inside menus, adverts, forms and other regions apart are no content either, as
their tags, classes and roles tell (their texts vary too).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graspmeter.llm.common import written
from graspmeter.llm.html_tree import parse
from graspmeter.llm.tree_match import Matcher, Tree, matched_texts
from graspmeter.llm.url_filters import split_url

#: A text is constant if this share of at least so many other pages of the host have it.
CONSTANT_SHARE, LEAST_PAGES = 0.8, 3
#: Pages of a host that are patterns.
PATTERNS = 3
#: Shapes of subtrees that a worker remembers.
SHAPES = 20_000


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Host, skeleton, hashes of all texts and the texts that may be content, for every row."""
    kinds = dict(pages.dtypes)
    schema = f"id {kinds[id_col]}, url string, host string, skeleton string, hashes array<long>, texts array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(source) for source in batch["html"]]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "url": batch["url"],
                    "host": [split_url(url)[0] for url in batch["url"]],
                    "skeleton": [page.skeleton for page in found],
                    "hashes": [[xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in page.everything] for page in found],
                    "texts": [[t if t is not None else a for t, a in zip(page.texts, page.around)] for page in found],
                }
            )

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id())


def aligned_pages(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """For each page and pattern of its host the texts that equal the text at the matched place.

    ``copy`` marks pages whose texts are all the pattern's; they say nothing about the template.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher()
        trees: dict[str, Tree] = {}
        for batch in batches:
            if len(matcher.parts) > SHAPES:
                matcher, trees = Matcher(), {}
            rows = []
            for skeleton, hashes, other, others in zip(batch["skeleton"], batch["hashes"], batch["p_skeleton"], batch["p_hashes"]):
                pattern = trees.setdefault(other, None) or Tree(other)
                trees[other] = pattern
                pairs = matched_texts(Tree(skeleton), pattern, matcher)
                same = [(at, to) for at, to in pairs if hashes[at] == others[to]]
                rows.append(([a for a, _ in same], [b for _, b in same], list(hashes) == list(others)))
            yield pd.DataFrame(rows, columns=["at", "to", "copy"]).assign(row=batch["row"], host=batch["host"], pattern=batch["pattern"])

    columns = ["row", "host", "skeleton", "hashes"]
    joined = pages.select(columns).join(patterns, "host")
    return joined.mapInPandas(run, "at array<int>, to array<int>, copy boolean, row long, host string, pattern int")


def main_texts(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    share: float = CONSTANT_SHARE,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """Id, url, main text (blocks joined by an empty line) and its code points, for every row.

    A null or empty page has an empty text. Pages without host have no template; repeated rows
    are extracted each (as copies of the pattern they don't make its texts constant). Other
    columns are not read; an empty table gives an empty result.
    """
    parsed = written(parsed_pages(pages, id_col, url_col, html_col), "parsed")
    hosted = parsed.where("host <> ''")
    shape = F.struct("skeleton", "hashes")
    first = [F.min_by(shape, F.struct(F.xxhash64(F.lit(k), "id"), "row")) for k in range(PATTERNS)]
    chosen = hosted.groupBy("host").agg(F.array_distinct(F.array(*first)).alias("patterns"))
    chosen = chosen.select("host", F.posexplode("patterns").alias("pattern", "p"))
    patterns = written(chosen.select("host", "pattern", F.col("p.skeleton").alias("p_skeleton"), F.col("p.hashes").alias("p_hashes")), "patterns")
    aligned = written(aligned_pages(hosted, patterns), "aligned")

    telling = aligned.where("not copy")
    seen = telling.groupBy("host", "pattern").agg(F.count(F.lit(1)).alias("pages"))
    equal = telling.select("host", "pattern", F.explode("to").alias("text")).groupBy("host", "pattern", "text").agg(F.count(F.lit(1)).alias("n"))
    often = (F.col("n") >= share * F.col("pages")) & (F.col("pages") >= least_pages)
    template = written(equal.join(seen, ["host", "pattern"]).where(often).select("host", "pattern", "text"), "template")
    dropped = (
        aligned.select("row", "host", "pattern", F.explode(F.arrays_zip("at", "to")).alias("m"))
        .select("row", "host", "pattern", F.col("m.at").alias("at"), F.col("m.to").alias("text"))
        .join(template, ["host", "pattern", "text"])
        .groupBy("row")
        .agg(F.collect_set("at").alias("dropped"))
    )
    held = F.filter("texts", lambda t, i: t.isNotNull() & ~F.array_contains(F.coalesce("dropped", F.array().cast("array<int>")), i))
    return (
        parsed.select("row", "id", "url", "texts")
        .join(written(dropped, "dropped"), "row", "left")
        .select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(held, "\n\n").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
