"""URL filters: block and allow entries in a trie over reversed host labels and path segments.

The rules are a small list that a person keeps; ``MAX_RULES`` bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

MAX_RULES = 1_000_000
ALLOW, BLOCK = "allow", "block"
_LOWER = {c: c + 32 for c in range(65, 91)}


class Trie:
    """Labels from the right, then path segments. A rule's last segment may be the beginning of a longer one.

    The rule with the longest host and path together wins; of two as long, the one with the longer host; of two equal
    rules, block.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"over {MAX_RULES} rules")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(("host", label), {})
            paths = node.setdefault("paths", {})
            if path:
                *whole, tail = path.removeprefix("/").split("/")
                for segment in whole:
                    paths = paths.setdefault(("seg", segment), {})
            else:
                tail = None  # fits the empty path too
            tails = paths.setdefault("tails", {})
            if tails.get(tail, (ALLOW,))[0] != BLOCK:
                tails[tail] = (verdict, host + path)
                paths["sizes"] = sorted({len(t) for t in tails if t is not None}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, else None."""
        node, found = self.root, None
        segments = path[1:].split("/") if path.startswith("/") else []
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            best = self._below(node["paths"], segments) if "paths" in node else None
            if best and (found is None or len(best[1]) >= len(found[1])):
                found = best
        return found

    @staticmethod
    def _below(node: dict, segments: list[str]) -> tuple[str, str] | None:
        """The longest path below a host. Only beginnings as long as some rule's last segment are looked up."""
        best = node.get("tails", {}).get(None)
        for segment in segments:
            tails = node.get("tails", {})
            best = next((tails[segment[:n]] for n in node.get("sizes", ()) if n <= len(segment) and segment[:n] in tails), best)
            node = node.get(("seg", segment))
            if node is None:
                break
        return best


def parse(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, A-Z lower-cased) and path; both empty for null or a text without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut].translate(_LOWER), rest[cut:]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host, rest[:cut]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; where no rule fits, rule is null and the verdict ``default``.

    ``rules``: (verdict, host, path); path "" or beginning with "/". Null and malformed urls have neither host nor path
    and fit no rule. Repeated rows are judged each for itself; an empty table gives none; other columns are left out.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(Trie(list(rules)))

    def run(batches):
        trie = shared.value
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parse(url)
                verdict, rule = trie.find(host, path) or (default, None)
                rows.append((host, path, rule, verdict))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict"])

    source = pick(pages, page_id=id_col, url=url_col)
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
