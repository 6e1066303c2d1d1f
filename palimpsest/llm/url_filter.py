"""URL filter lists, probed in a memory-mapped sorted array of 64-bit digests.

A rule is a host and a path, written as one string (`example.net/en/`). It fits its host and
all subdomains, and every path that starts with its path. The longest fitting rule decides
(then the longer host; a block rule before an allow rule of the same text). Where none fits,
the method's own verdict holds: block without a host (there is nothing to fetch), else allow.

The index is one file: the sorted xxhash64 keys, the place of each rule's text, the texts. The
driver writes it once beside the checkpoints, Spark hands it to every executor, and each Python
worker maps it, so its pages are shared and read on demand. A batch of URLs is answered by one
vectorised binary search over all its (host suffix, path prefix) keys; each hit is confirmed
against the stored text, so a digest collision can't decide anything.

Edge cases: a null URL or one without `://` has an empty host and path, rule null, verdict
block. An empty list gives the method's verdict everywhere. Repeated rules count once. Repeated
rows and extra columns pass through unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import shared_dir

MAGIC = b"PALURL01"
#: Above so many rules the driver doesn't build the file; judge_by_join() answers instead.
MAX_MAPPED_RULES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def build_index(block: Iterable[str], allow: Iterable[str], key=digest) -> bytes:
    """The file's bytes. Path lengths in use come first, so that a probe tries no others."""
    verdicts = {a + b: 0 for a, b in map(split_rule, allow)} | {a + b: 1 for a, b in map(split_rule, block)}
    rules = sorted((key(text), text.encode(), verdict) for text, verdict in verdicts.items())
    lengths = np.array(sorted({len(split_rule(text)[1]) for text in verdicts}), "<u4")
    keys = np.array([k for k, _, _ in rules], "<u8")
    ends = np.cumsum([0, *(len(t) for _, t, _ in rules)]).astype("<u8")
    flags = np.array([v for _, _, v in rules], "u1")
    head = MAGIC + struct.pack("<QQ", len(rules), len(lengths))
    return head + keys.tobytes() + ends.tobytes() + lengths.tobytes() + flags.tobytes() + b"".join(t for _, t, _ in rules)


class MappedIndex:
    """Read side: views over one mapped file, nothing copied."""

    def __init__(self, path: str, key=digest):
        self.key, raw = key, np.memmap(path, mode="r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a URL index")
        n, k = struct.unpack("<QQ", raw[8:24].tobytes())
        at = 24
        self.keys = raw[at : (at := at + 8 * n)].view("<u8")
        self.ends = raw[at : (at := at + 8 * (n + 1))].view("<u8")
        self.lengths = raw[at : (at := at + 4 * k)].view("<u4").tolist()
        self.flags = raw[at : (at := at + n)]
        self.texts = raw[at:]

    def probes(self, host: str, path: str) -> list[tuple[str, int]]:
        """Each (rule text that would fit, length of its host)."""
        suffixes, at = [], 0
        while host and at >= 0:
            suffixes.append(host[at:])
            at = host.find(".", at) + 1 or -1
        return [(s + path[:n], len(s)) for s in suffixes for n in self.lengths if n <= len(path)]

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        rows, probes = [], []
        for row, found in enumerate(map(self.probes, hosts, paths)):
            rows += [row] * len(found)
            probes += found
        wanted = np.fromiter((self.key(t) for t, _ in probes), "<u8", len(probes))
        first = np.searchsorted(self.keys, wanted, "left")
        last = np.searchsorted(self.keys, wanted, "right")
        best: dict[int, tuple] = {}
        for i in np.flatnonzero(last > first):
            text, host_length = probes[i]
            for j in range(first[i], last[i]):
                if self.texts[self.ends[j] : self.ends[j + 1]].tobytes() == text.encode():
                    best[rows[i]] = max(best.get(rows[i], (-1,)), (len(text), host_length, int(self.flags[j]), text))
        rules = [best[i][3] if i in best else None for i in range(len(hosts))]
        blocked = [best[i][2] if i in best else not host for i, host in enumerate(hosts)]
        return rules, ["block" if b else "allow" for b in blocked]


def publish(spark: SparkSession, data: bytes) -> str:
    """Write the index to the shared folder and register it with Spark; the name to look up."""
    name = f"url-index-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for at in range(0, len(data), 1 << 24):
        out.write(bytearray(data[at : at + (1 << 24)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path, both empty for a null URL or one without `://`."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    return df.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        }
    )


def judge(df: DataFrame, block: Iterable[str], allow: Iterable[str], url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict (replacing columns of these names)."""
    block, allow = list(block), list(allow)
    parsed = with_host_and_path(df, url)
    if len(block) + len(allow) > MAX_MAPPED_RULES:
        return judge_by_join(parsed, block, allow)
    name = publish(df.sparkSession, build_index(block, allow))

    @F.pandas_udf("rule string, verdict string")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = MappedIndex(SparkFiles.get(name))
        for hosts, paths in batches:
            rules, verdicts = index.judge(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": pd.Series(rules, dtype=object), "verdict": verdicts})

    return (
        parsed.withColumn("_judged", probe("host", "path"))
        .withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")})
        .drop("_judged")
    )


def judge_by_join(parsed: DataFrame, block: Iterable[str], allow: Iterable[str]) -> DataFrame:
    """The same answers for lists too long for one file: the probes join the rules by text."""
    spark = parsed.sparkSession
    listed = [(a + b, 0, len(b)) for a, b in map(split_rule, allow)] + [(a + b, 1, len(b)) for a, b in map(split_rule, block)]
    rules = spark.createDataFrame(listed, "rule string, blocked int, n int").groupBy("rule").agg(F.max("blocked").alias("blocked"))
    lengths = sorted({n for _, _, n in listed})
    keyed = parsed.drop("rule", "verdict").withColumn("_row", F.xxhash64("host", "path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.expr(f"transform(filter(array({','.join(map(str, lengths)) or '0'}), n -> n <= length(path)), n -> left(path, n))")
    probes = (
        keyed.filter("host <> ''")
        .select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .select("host", "path", F.concat("suffix", "prefix").alias("rule"), F.length("suffix").alias("h"))
    )
    best = (
        probes.join(rules, "rule")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "h", "blocked", "rule")).alias("best"))
    )
    blocked = F.coalesce(F.col("best.blocked") == 1, F.col("host") == "")
    return (
        keyed.drop("_row")
        .join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("best.rule"), "verdict": F.when(blocked, "block").otherwise("allow")})
        .drop("best")
    )
