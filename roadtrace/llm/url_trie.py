"""URL filters by a trie over reversed host labels and path text.

The rules form one trie: the host's labels from the right (``com``, ``example``, ``www``), and at each host node
the rule paths that end there. A lookup walks a url's labels once and remembers the deepest node that holds a
fitting path, so the longest match wins between allow and block entries: first more host labels, then the longer path.

The trie is a broadcast variable of at most ``max_rules`` rules. A longer list is taken in parts of that size, one after another, and a
url keeps the longest match of all parts, so any list gives the verdicts of one trie.

Defined cases: a null url, or one without ``://``, has an empty host and path; no rule fits an empty host. Host and
path follow the first ``://`` literally, so a port or user part belongs to the last or first label. Two rules with the
same host and path: block wins. Repeated rows each get their verdict. The ``keys`` columns pass through; one with the name of an output is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the broadcast trie; some 100 bytes a rule.
MAX_RULES = 1_000_000

_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block; ``path`` starts with a slash."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


class HostTrie:
    """Nodes are dicts from label to node; key ``""`` holds the rules that end at the node, longest path first."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in sorted(rules, key=lambda r: (len(r.path), r.path, r.verdict == "block"), reverse=True):
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            # Whole segments lead down a host's own trie; what follows the last slash is kept under its length.
            *segments, part = rule.path.split("/")
            place = node.setdefault("", ({}, {}))
            for segment in segments:
                place = place[0].setdefault(segment, ({}, {}))
            place[1].setdefault(len(part), {}).setdefault(part, (rule.text, rule.verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule text and verdict of the longest match."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            if not label or (node := node.get(label)) is None:
                break
            if "" in node:
                best = self._longest(node[""], path) or best
        return best

    @staticmethod
    def _longest(place: tuple[dict, dict], path: str) -> tuple[str, str] | None:
        """The deepest place on the way along the segments counts; there, the longest beginning of the next segment."""
        found = None
        for segment in path.split("/"):
            # Rules come longest first, so lengths do too.
            found = next((hit for n, parts in place[1].items() if n <= len(segment) and (hit := parts.get(segment[:n]))), found)
            if (place := place[0].get(segment)) is None:
                break
        return found


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


OUTPUTS = ("host", "path", "rule", "verdict")


def rank(found: tuple[str, str]) -> tuple[int, int, bool]:
    """Of two matches of one url: more host labels, then the longer path, then block."""
    host, _, path = found[0].partition("/")
    return host.count("."), len(path), found[1] == "block"


def judge_urls(df: DataFrame, rules: Iterable[Rule], *, keys: list[str], url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """``keys`` columns with host, path, rule (null without a match) and verdict of each row's url."""
    rules = list(rules)
    kept = [k for k in keys if k not in OUTPUTS]
    out = df.select(*[F.col(k) for k in kept], F.col(url).cast("string").alias("__url"))
    schema = T.StructType([*out.schema.fields[:-1], *(T.StructField(n, T.StringType()) for n in ("__url", *OUTPUTS))])
    parts = [rules[at : at + max_rules] for at in range(0, len(rules), max_rules)] or [[]]
    for number, part in enumerate(parts):
        sent = df.sparkSession.sparkContext.broadcast(HostTrie(part))

        def judge(batches: Iterator[pa.RecordBatch], sent=sent, later=number > 0) -> Iterator[pa.RecordBatch]:
            trie = sent.value
            for batch in batches:
                own = batch.columns[: len(kept)]
                earlier = [c.to_pylist() for c in batch.columns[-2:]] if later else [[None] * len(batch), [default] * len(batch)]
                rows = []
                for text, rule, verdict in zip(batch.column(len(kept)).to_pylist(), *earlier, strict=True):
                    host, path = split_url(text)
                    found = trie.match(host, path)
                    if found and (rule is None or rank(found) > rank((rule, verdict))):
                        rule, verdict = found
                    rows.append((text, host, path, rule, verdict))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

        out = out.mapInArrow(judge, schema)
    return out.drop("__url")
