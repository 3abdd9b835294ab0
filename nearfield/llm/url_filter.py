"""URL filter: a trie over reversed host labels, then path segments, with the longest match deciding.

A rule is ``host/path``: it fits its host and all subdomains of it where the url's path starts with the rule's path.
Of the rules that fit, the longest (in characters) decides; of equally long ones block goes before allow. No rule: the
default verdict. Null urls and urls without ``://`` have an empty host and path; they get the default.
Rows are kept one for one. The rules are a parameter; their number is checked before the trie is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = ""  # a key that no segment has: segments keep their slash, labels end with a dot


def labels(host: str) -> list[str]:
    return [f"{x}." for x in reversed(host.split("."))]


def segments(path: str) -> list[str]:
    """Pieces that keep their closing slash; the last has none (and is left out where the path ends with one)."""
    out = [f"{x}/" for x in path.split("/")]
    out[-1] = out[-1][:-1]
    return out if out[-1] else out[:-1]


class UrlTrie:
    """Nodes are dicts; a node's entry for whole rules is under LEAF: (path tail, length, verdict, rule)."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        self.n = 0
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            host, slash, rest = rule.partition("/")
            node = self.root
            for x in labels("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)):
                node = node.setdefault(x, {})
            parts = segments(slash + rest)
            tail = parts.pop() if parts and not parts[-1].endswith("/") else ""
            node = node.setdefault("/", {})  # from here on, path segments; no label is a bare slash
            for x in parts:
                node = node.setdefault(x, {})
            node.setdefault(LEAF, []).append((tail, len(rule), verdict == "block", rule))
            self.n += 1

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest match."""
        best, node = None, self.root
        parts = segments(path)
        for x in labels(host):
            node = node.get(x)
            if node is None:
                break
            below, k = node.get("/"), 0
            while below is not None:
                for tail, *rank in below.get(LEAF, ()):
                    if (not tail or (k < len(parts) and parts[k].startswith(tail))) and (best is None or rank > best):
                        best = rank
                if k == len(parts):
                    break
                below = below.get(parts[k])
                k += 1
        return best and (best[2], "block" if best[1] else "allow")


def split_url(url):
    """Columns host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 1_000_000) -> DataFrame:
    """id, host, path, rule, verdict of each row. No shuffle."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast. Give them in blocks, and take the longest of the matches")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            got = [find(h, p) or (None, default) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    host, path = split_url(F.col(url_col))
    return pages.select(id_col, host.alias("host"), path.alias("path")).mapInArrow(run, f"{id_col} {kind}, host string, path string, rule string, verdict string")
