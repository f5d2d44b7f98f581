"""The import graph with targets resolved to files: importers, and everything that depends on a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graspmeter.operators.imports import import_edges
from graspmeter.session import materialize

#: What a relative import may name, in the order in which it is looked for.
CANDIDATES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py")


def _target_path(src: str, target: str):
    """Path that a relative import points to, as it stands: ``a/b.ts`` + ``../c`` -> ``c``; null above the root."""
    folder = F.filter(F.split(F.regexp_replace(src, r"[^/]*\z", ""), "/"), lambda p: p != "")
    step = F.aggregate(
        F.split(target, "/"),
        folder,
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(step, "/")


def resolved_imports(
    files: DataFrame, wide: bool = False, candidates: Sequence[str] = CANDIDATES, by: Sequence[str] = ("repo",)
) -> DataFrame:
    """``by, src, target, file``: each file's distinct relative imports and the file of the same repository they name.

    ``files`` has ``file_id, relative_path, content`` and the columns ``by``. A target may stand
    for several paths; of those that exist the first in the order of ``candidates`` counts. An
    import of which none exists has a null ``file``. The join is on the path, so a module that
    everybody imports is one row on one side.
    """
    own = files.select("file_id", *by)
    edges = import_edges(files, wide).join(own, "file_id").select(*by, "src", "target").distinct()
    paths = files.select(*by, F.col("relative_path").alias("file")).distinct()
    names = F.posexplode(F.array(*[F.lit(c) for c in candidates])).alias("order", "ending")
    looked = edges.withColumn("path", _target_path("src", "target")).select(*by, "src", "target", "path", names)
    # A path that already has its ending may also be tried with another one behind it.
    looked = looked.withColumn("file", F.concat("path", "ending"))
    hits = looked.join(paths, [*by, "file"]).groupBy(*by, "src", "target").agg(F.min_by("file", "order").alias("file"))
    return edges.join(hits, [*by, "src", "target"], "left")


def unresolved(imports: DataFrame) -> DataFrame:
    """Imports that name no file."""
    return imports.where("file is null").drop("file")


def importers(imports: DataFrame, by: Sequence[str] = ("repo",)) -> DataFrame:
    """``by, file, called_by``: a row for each file and each other file that imports it.

    Rows and not lists, as a hub module has very many importers.
    """
    used = imports.where("file is not null and file <> src")
    return used.select(*by, "file", F.col("src").alias("called_by")).distinct()


def dependents(imports: DataFrame, by: Sequence[str] = ("repo",), max_rounds: int | None = None) -> DataFrame:
    """``by, file, dependent, distance``: everything that depends on a file, directly or through others.

    Each round extends only the pairs that the round before found, so cycles end; a file in a
    cycle depends on itself at the length of the shortest one. Rounds are written to the shared
    folder, and only the number of new pairs reaches the driver. ``max_rounds`` bounds the
    distance; without it the rounds go on until nothing is new.
    """
    edges = materialize(imports.where("file is not null").select(*by, "file", F.col("src").alias("dependent")).distinct(), "edges")
    keys = [*by, "file", "dependent"]
    found = [edges.withColumn("distance", F.lit(1))]
    frontier, distance = edges, 1
    step = edges.select(*by, F.col("file").alias("through"), F.col("dependent").alias("next"))
    while max_rounds is None or distance < max_rounds:
        distance += 1
        reached = frontier.withColumnRenamed("dependent", "through").join(step, [*by, "through"]).select(*by, "file", F.col("next").alias("dependent")).distinct()
        known = found[0].select(keys)
        for more in found[1:]:
            known = known.unionByName(more.select(keys))
        frontier = materialize(reached.join(known, keys, "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("distance", F.lit(distance)))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def dependent_counts(imports: DataFrame, by: Sequence[str] = ("repo",)) -> DataFrame:
    """``by, file, imported_by, n_dependents, in_cycle``: of every file that something imports."""
    pairs = dependents(imports, by)
    direct = (F.col("distance") == 1) & (F.col("dependent") != F.col("file"))
    other = F.col("dependent") != F.col("file")
    return pairs.groupBy(*by, "file").agg(
        F.count(F.when(direct, 1)).alias("imported_by"),
        F.count(F.when(other, 1)).alias("n_dependents"),
        F.max(~other).alias("in_cycle"),
    )
