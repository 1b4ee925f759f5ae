"""Allow and block lists for urls: a trie over reversed host labels, then path segments.

The trie is a nested dict. An edge is a host label (from the right) or, below the key ``PATH``, a path
segment. An entry sits at the node of its last whole segment under the rest of its path (empty when the path ends with
a slash), so an entry fits exactly the urls whose path starts with its own. Of all fitting entries the one
with the most host labels wins, then the longest path; an entry given twice keeps its last verdict.

Rules are given by the caller, so the trie's size is known before it is shipped; more than ``MAX_RULES`` are refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
Rule = tuple[str, str, str]

MAX_RULES = 1_000_000
_PATH, _ENDS = 0, 1  # keys that no label or segment can equal


def build_trie(rules: Sequence[Rule]) -> dict:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes at most {MAX_RULES}")
    root: dict = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} is neither allow nor block")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATH, {})
        *segments, rest = path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        ends, lengths = node.setdefault(_ENDS, ({}, set()))
        ends[rest] = (host + path, verdict)
        lengths.add(len(rest))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The winning (rule, verdict), or None. Every node on the way is visited once."""
    below = []
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if _PATH in node:
            below.append(node[_PATH])
    segments = path.split("/")
    for node in reversed(below):  # most labels first
        best = None
        for segment in segments:
            if _ENDS in node:
                # one probe for each length that occurs, however many entries end here
                ends, lengths = node[_ENDS]
                fits = max((n for n in lengths if n <= len(segment) and segment[:n] in ends), default=None)
                if fits is not None:
                    best = ends[segment[:fits]]
            node = node.get(segment)
            if node is None:
                break
        if best:
            return best
    return None


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"(?s)^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with a struct column ``judged`` of host, path, rule (null if none fits) and verdict.

    Urls that no entry fits, and null or malformed urls, get ``default`` and no rule. Rows are kept one to one, so repeated
    rows and null ids need no care; a column named ``judged`` is replaced.
    """
    trie = build_trie(rules)
    shipped = pages.sparkSession.sparkContext.broadcast(trie)

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tree = shipped.value
        for hosts, paths in batches:
            found = [longest_match(tree, h, p) or (None, default) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
                names=["rule", "verdict"],
            )

    host, path = split_url(F.col(f"`{url}`"))
    hit = match(host, path)
    return pages.withColumn(
        "judged",
        F.struct(host.alias("host"), path.alias("path"), hit["rule"].alias("rule"), hit["verdict"].alias("verdict")),
    )
