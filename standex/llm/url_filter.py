"""URL filters: the longest rule that fits a URL says whether it is allowed or blocked.

A rule is a host and the beginning of a path. It fits URLs of that host and of its subdomains whose path begins
with the rule's. Rules lie in a trie: first over the labels of the host, from the last to the first, then
over the segments of the path; the last segment of a rule is a beginning, so a node keeps those with
their lengths. The trie is broadcast, and a URL walks it once: of all rules met, the one with more labels wins, then
the one with the longer path, so an entry for a part of a site overrules one for the whole, whichever
allows and whichever blocks. Where no rule fits, the verdict is DEFAULT.

Rules are counted before anything is broadcast. More than BOUND bytes of them stay a table: hosts of URLs are joined
with the rules' by their suffixes (one row a label), then the beginnings of their paths, of the lengths that the
host's rules have, with the rules themselves; the longest is kept. Hosts and rules that many URLs meet are split.

Defined results: in a URL the host goes from after the first :// to the next /, ? or # or the end, with A-Z
lower-cased, and the path from there to the next ? or # or the end; ports and user names are part of the host. A null URL,
and one without ://, has an empty host and path. Rules with a null in host, path or verdict are left out; of
rules with one host (A-Z lower-cased) and path, block wins over allow. URLs of any length are read whole; rows are
independent, so repeated ones get equal results, and nothing is shuffled while the trie fits. Columns named
host, path, rule and verdict must not be among those given. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import split_join, stored, widened

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: The verdict on URLs that no rule fits.
DEFAULT = ALLOW
#: Bytes of rules that are broadcast at most.
BOUND = 32 << 20
RULES = "host string, path string, verdict string"


@dataclass(slots=True)
class Segments:
    """A node of a host's paths. begun: rules whose last segment begins so."""

    under: dict[str, Segments] = field(default_factory=dict)
    begun: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Labels:
    """A node of the hosts."""

    under: dict[str, Labels] = field(default_factory=dict)
    paths: Segments | None = None


class Trie:
    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root = Labels()
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.under.setdefault(label, Labels())
            node.paths = at = node.paths or Segments()
            *whole, last = path.split("/")
            for segment in whole:
                at = at.under.setdefault(segment, Segments())
            if at.begun.get(last, ("", ALLOW))[1] != BLOCK:
                at.begun[last] = (host + path, verdict)
            if len(last) not in at.lengths:
                at.lengths = sorted([*at.lengths, len(last)], reverse=True)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.under.get(label)) is None:
                break
            if node.paths is not None:
                best = self._longest_path(node.paths, segments) or best
        return best

    @staticmethod
    def _longest_path(at: Segments | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if at is None:
                break
            for n in at.lengths:
                if (found := at.begun.get(segment[:n])) is not None and n <= len(segment):
                    best = found
                    break
            at = at.under.get(segment)
        return best


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    _, mark, after = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "?#" if (i := after.find(c)) >= 0), default=len(after))
    host, slash, path = after[:end].partition("/")
    return host.translate(_LOW), slash + path


_LOW = str.maketrans(UPPER, LOWER)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a list."""
    return spark.createDataFrame(rules, RULES)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, bound: int = BOUND) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict, by column url."""
    known = rules.where("host is not null and path is not null").where(F.col("verdict").isin(ALLOW, BLOCK))
    known = known.withColumn("host", F.translate("host", UPPER, LOWER)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    known = stored(known, "rules")
    held = known.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0)).alias("n")).first()
    if held["n"] > bound:
        return judge_by_join(pages, known, default)
    listed = [tuple(r) for r in known.select("host", "path", "verdict").toArrow().to_pandas().itertuples(index=False)]
    trie = pages.sparkSession.sparkContext.broadcast(Trie(listed))
    names = ("host", "path", "rule", "verdict")
    schema = widened(pages.schema, *[(n, T.StringType()) for n in names])
    at = pages.columns.index("url")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, path, *(trie.value.longest(host, path) or (None, default))) for host, path in map(parts, batch.column(at).to_pylist())]
            more = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return pages.mapInArrow(walk, schema)


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The same for a table of rules (each host and path once) that is too large to be broadcast."""
    widened(pages.schema, *[(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])
    after = F.when(F.instr("url", "://") > 0, F.substring_index(F.substring_index(F.expr("substr(url, instr(url, '://') + 3)"), "?", 1), "#", 1))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.substring_index(after, "/", 1), UPPER, LOWER)
    split = pages.withColumns({"host": host, "path": F.substr(after, F.length(F.substring_index(after, "/", 1)) + 1)})
    asked = stored(split.select("host", "path").distinct(), "asked")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = asked.select(F.struct("host", "path").alias("of"), F.explode(suffixes).alias("host"))
    # beginnings of the lengths that a host's rules have, then the rules that are equal to one
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    met = split_join(each, lengths, "host").select("of", "host", F.explode(F.filter("lengths", lambda n: n <= F.length("of.path"))).alias("n"))
    key = lambda path: F.concat(F.length("host").cast("string"), F.lit(":"), "host", path)
    met = met.select("of", F.size(F.split("host", r"\.")).alias("labels"), "n", key(F.substr("of.path", F.lit(1), F.col("n"))).alias("key"))
    fits = split_join(met, rules.select(key(F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict"), "key")
    best = fits.groupBy("of").agg(F.max(F.struct("labels", "n", "rule", "verdict")).alias("m"))
    best = best.select(F.col("of.host").alias("host"), F.col("of.path").alias("path"), "m.rule", "m.verdict")
    out = split.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.select(*pages.columns, "host", "path", "rule", "verdict")
