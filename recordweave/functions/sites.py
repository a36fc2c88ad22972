"""The URLs of a text with their hosts and registrable domains, by a trie of public suffixes.

A rule is a suffix, a wildcard (*.ck: every label below) or an exception (!www.ck); what no
rule covers has a suffix of one label.  Rules are a parameter, so that they can come from a
table; the default are those of hosts.SUFFIXES.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from recordweave.functions import hosts
from recordweave.functions.slices import by_slices

_URL = re.compile(r"https?://[^\s;]+", re.I)
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)")
_LABELS = re.compile(r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?")
#: The most rules that are sent to every task.
MOST_RULES = 200_000


class Suffixes:
    def __init__(self, rules: tuple[str, ...]):
        self.trie: dict = {}
        for rule in rules:
            node = self.trie
            for label in reversed(rule.lstrip("!").split(".")):
                node = node.setdefault(label, {})
            node["!" if rule.startswith("!") else ""] = True

    def registrable(self, host: str) -> str:
        """The label before the longest suffix of the rules, and the suffix; empty where no label is before it."""
        labels = host.split(".") if host else []
        node, suffix = self.trie, 1
        for depth, label in enumerate(reversed(labels), 1):
            if "*" in node and "!" not in node.get(label, {}):
                suffix = max(suffix, depth)
            node = node.get(label)
            if node is None:
                break
            if "!" in node:
                suffix = depth - 1
                break
            if "" in node:
                suffix = depth
        return ".".join(labels[-suffix - 1 :]) if len(labels) > suffix else ""


@cache
def _suffixes(rules: tuple[str, ...]) -> Suffixes:
    return Suffixes(rules)


def plain_host(url: str) -> str:
    """The lower-case host without www.; international labels in their ASCII form; empty if it isn't a valid host name."""
    host = _HOST.match(url.strip().lower())
    host = (host[1] if host else "").strip(".")
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return ""
    host = host.removeprefix("www.")
    return host if len(host) <= 253 and _LABELS.fullmatch(host) and not host.rsplit(".", 1)[-1].isdigit() else ""


_SITES = ArrayType(StructType([StructField(c, StringType()) for c in ("url", "host", "domain")]))


def of(text: Column, rules: tuple[str, ...] = hosts.SUFFIXES) -> Column:
    """array<struct<url, host, domain>>: the URLs of a text in order; host and domain are empty where a URL has none."""

    @F.arrow_udf(_SITES)
    def found(texts: pa.Array) -> pa.Array:
        return by_slices(made, texts)

    def made(texts: pa.Array) -> pa.Array:
        suffixes, out = _suffixes(rules), []
        for t in texts.to_pylist():
            row = []
            for url in _URL.findall(t or ""):
                url = url.rstrip(".,:)]}")
                host = plain_host(url)
                row.append({"url": url, "host": host, "domain": suffixes.registrable(host)})
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([(c, pa.string()) for c in ("url", "host", "domain")])))

    return found(text)


def rules_of(table: DataFrame) -> tuple[str, ...]:
    """The rules(rule) of a table, checked to be few enough to be sent to every task."""
    rules = [r.rule for r in table.select("rule").where("rule is not null").distinct().limit(MOST_RULES + 1).collect()]
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(sorted(r.encode("idna").decode() if not r.isascii() else r for r in rules))
