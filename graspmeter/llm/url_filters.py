"""URL filters: a broadcast trie over reversed host labels and path segments.

Rules are ``(action, "host/path")``. A rule fits its host and every subdomain of it, if the
path of the url starts with the path of the rule. Of all rules that fit, the longest wins (of
equally long ones that with the longer host, of the same rule listed twice ``block``); where
none fits, the verdict is ``default``. The rules are an argument of the caller, so their size
is bounded by the driver that holds them and does not grow with the urls.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWER = {c: c + 32 for c in range(65, 91)}
SEGMENT = re.compile(r"[^/]*/|[^/]+")
SCHEMA = "host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ``://``."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    """Nested dicts: host labels from the right, below ``"/"`` the path segments.

    A segment keeps its closing slash, so ``/en/`` does not fit ``/en``. What a rule has after
    its last slash is a beginning of a segment and stands in the list under ``"rules"``.
    """
    root: dict = {}
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.translate(LOWER).split(".")):
            node = node.setdefault("labels", {}).setdefault(label, {})
        node = node.setdefault("/", {})
        parts = SEGMENT.findall(slash + path)
        tail = parts.pop() if parts and not parts[-1].endswith("/") else ""
        for part in parts:
            node = node.setdefault("segments", {}).setdefault(part, {})
        node.setdefault("rules", []).append((tail, (len(rule), len(host), action == "block"), rule, action))
    return root


def longest_rule(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule that wins and its action, or None."""
    best = None
    segments = SEGMENT.findall(path)
    node = trie
    for label in reversed(host.split(".")):
        node = node.get("labels", {}).get(label)
        if node is None:
            break
        inner, depth = node.get("/"), 0
        while inner is not None:
            rest = segments[depth] if depth < len(segments) else ""
            for tail, rank, rule, action in inner.get("rules", ()):
                if rest.startswith(tail) and (best is None or rank > best[0]):
                    best = (rank, rule, action)
            inner, depth = inner.get("segments", {}).get(rest), depth + 1
    return best and best[1:]


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Id, host, path, rule and verdict of every row.

    Only the two named columns are read, so other columns never clash. Null urls have an empty
    host and path; repeated rows are judged each; an empty table gives an empty result.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(SCHEMA)
    def judged(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for url in urls:
            host, path = split_url(url)
            found = longest_rule(trie.value, host, path)
            rows.append((host, path, *(found or (None, default))))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col), judged(F.col(url_col)).alias("j")).select(id_col, "j.*")
