"""URL filters by a sorted digest array.

The rules' keys are hashed with 64-bit xxhash, sorted and written to one file that the workers
map into memory; the full strings lie in a second mapped file and confirm each hit, so that
hash collisions never decide. A url is looked up by its host suffixes of as many labels as keys have and by the path
prefixes of the lengths that occur in the rules, in one vectorised binary search a batch. Short lists are packed
on the driver; long ones are a table of patterns, which Spark hashes, sorts and writes, and which each
worker lays out as one mapped file.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped, shared_dir

ALLOW, BLOCK = 1, 2


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): native; null or no `://` gives two empty strings. A-Z of the host are lowered."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, locate('://', {u}) + 3)".format(u="_url"))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(key: bytes) -> int:
    """64-bit xxhash of a key, unsigned: the number that Spark's xxhash64 gives for the text."""
    import xxhash

    return xxhash.xxh64_intdigest(key, seed=42)


class DigestArray:
    """Sorted xxhash64 digests, mapped from a file, with their strings and codes."""

    def __init__(self, path: str) -> None:
        head = np.fromfile(path, dtype="<i8", count=2)
        n, size = int(head[0]), int(head[1])
        self.digests = np.memmap(path, dtype="<u8", mode="r", offset=16, shape=(n,)) if n else np.zeros(0, "<u8")
        self.ends = np.memmap(path, dtype="<i8", mode="r", offset=16 + 8 * n, shape=(n,)) if n else np.zeros(0, "<i8")
        self.codes = np.memmap(path, dtype="u1", mode="r", offset=16 + 16 * n, shape=(n,)) if n else np.zeros(0, "u1")
        self.strings = np.memmap(path, dtype="u1", mode="r", offset=16 + 17 * n, shape=(size,)) if size else np.zeros(0, "u1")

    @staticmethod
    def pack(keys: list[tuple[str, int]]) -> bytes:
        rows = sorted((digest(k.encode()), k.encode(), code) for k, code in keys)
        blob = b"".join(k for _, k, _ in rows)
        ends = np.cumsum([len(k) for _, k, _ in rows]) if rows else np.zeros(0)
        return b"".join(
            [
                np.array([len(rows), len(blob)], "<i8").tobytes(),
                np.array([h for h, _, _ in rows], "<u8").tobytes(),
                np.asarray(ends, "<i8").tobytes(),
                np.array([c for _, _, c in rows], "u1").tobytes(),
                blob,
            ]
        )

    def codes_of(self, keys: list[bytes]) -> np.ndarray:
        """Code of each key, 0 where it is not in the array."""
        out = np.zeros(len(keys), "u1")
        if not len(self.digests) or not keys:
            return out
        h = np.fromiter(map(digest, keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(self.digests, h)
        inside = at < len(self.digests)
        hits = np.nonzero(inside & (self.digests[np.minimum(at, len(self.digests) - 1)] == h))[0]
        for i in hits:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == h[i]:  # colliding keys stand side by side
                start = int(self.ends[j - 1]) if j else 0
                if self.strings[start : int(self.ends[j])].tobytes() == keys[i]:
                    out[i] = self.codes[j]
                    break
                j += 1
        return out


def publish(spark: SparkSession, keys: list[tuple[str, int]]) -> str:
    """Write the array to the shared folder and hand it to the executors; gives the file's name there.

    Equal lists share one file, named by its content, however often they are used.
    """
    data = DigestArray.pack(keys)
    name = f"digests-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4().hex}.part")
        out = fs.create(part)
        out.write(bytearray(data))
        out.close()
        fs.rename(part, path)
    if not any(x.endswith(name) for x in sc.listFiles):
        sc.addFile(path.toString())
    return name


def publish_table(patterns: DataFrame, pattern: str = "pattern") -> str:
    """As publish, for a table of patterns to block, of any size: hashed, freed of copies and nulls, sorted and written by Spark.

    Parts hold ranges of digests in order, so a worker lays them out one behind the other. Patterns without a slash go.
    """
    spark = patterns.sparkSession
    k = F.col(f"`{pattern}`")
    # signed digests in the order of unsigned ones
    order = F.xxhash64("k").bitwiseXOR(F.lit(-(1 << 63)))
    d = patterns.where(F.contains(k, F.lit("/"))).select(k.alias("k")).distinct().select(order.alias("o"), F.col("k").cast("binary").alias("k"))
    name = f"patterns-{uuid.uuid4().hex}"
    d.repartitionByRange("o").sortWithinPartitions("o", "k").write.parquet(f"{shared_dir(spark)}/{name}")
    spark.sparkContext.addFile(f"{shared_dir(spark)}/{name}", recursive=True)
    return name


def laid_out(folder: str, path: str) -> None:
    """The packed file of a table of publish_table, a batch at a time; a file that is there is left alone."""
    import pyarrow.parquet as pq

    if os.path.exists(path):
        return
    parts = [pq.ParquetFile(os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]
    # range partitions are written in the order of their numbers
    n = sum(p.metadata.num_rows for p in parts)
    own = f"{path}.{os.getpid()}"
    with open(own, "wb") as f:
        at, end = 0, 0
        f.truncate(16 + 17 * n)
        for p in parts:
            for b in p.iter_batches(1 << 16):
                keys = b.column("k").to_pylist()
                digests = b.column("o").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
                ends = end + np.cumsum([len(x) for x in keys])
                for data, where in ((digests.astype("<u8"), 16 + 8 * at), (ends.astype("<i8"), 16 + 8 * n + 8 * at), (np.full(len(keys), BLOCK, "u1"), 16 + 16 * n + at)):
                    f.seek(where)
                    f.write(data.tobytes())
                f.seek(16 + 17 * n + end)
                f.write(b"".join(keys))
                at, end = at + len(keys), int(ends[-1]) if keys else end
        f.seek(0)
        f.write(np.array([n, end], "<i8").tobytes())
    os.replace(own, path)


_open: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    """A published array, mapped once a worker; the last few stay open."""
    if name not in _open:
        while len(_open) > 3:
            _open.pop(next(iter(_open)))
        path = os.path.join(SparkFiles.getRootDirectory(), name)
        if os.path.isdir(path):
            laid_out(path, path + ".bin")
            path += ".bin"
        _open[name] = DigestArray(path)
    return _open[name]


def suffixes(host: bytes, labels: int) -> list[bytes]:
    """The last 1, 2, ... labels of a host, at most so many."""
    out, at = [], len(host)
    while at >= 0 and len(out) < labels:
        at = host.rfind(b".", 0, at)
        out.append(host[at + 1 :])
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], blocked: list[str] | DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict.

    rules: (pattern, allow or block), a pattern being host + path; a rule fits its host and all
    subdomains where the path starts with the rule's, and the longest fitting rule decides (of
    equally long ones the first by spelling). Without a rule, urls that fit a pattern of
    `blocked` are blocked and all others allowed; a long list is given as a table with a column `pattern`. Null urls and urls without a scheme have an
    empty host and fit nothing. Urls of any length cost what their host's last labels and their path's beginnings of the keys' own sizes do. Equal
    and repeated rows are judged each by itself; an empty table gives an empty one. Columns named like an added one are replaced.
    """
    spark = pages.sparkSession
    code = {"allow": ALLOW, "block": BLOCK}
    by_rule = publish(spark, [(k, code[v]) for k, v in dict(rules).items()])
    sizes = lambda keys: (sorted({len(k.encode()) - len(k[: k.index("/")].encode()) for k in keys}), max([k[: k.index("/")].count(".") + 1 for k in keys], default=0))
    if isinstance(blocked, DataFrame):
        by_list = publish_table(blocked)
        k = blocked.where(F.contains("pattern", F.lit("/"))).select(F.substring_index("pattern", "/", 1).alias("h"), F.octet_length("pattern").alias("n"))
        got = k.agg(F.array_sort(F.collect_set(F.col("n") - F.octet_length("h"))).alias("n"), F.max(F.size(F.split("h", r"\."))).alias("labels")).first()  # one number a path length
        listed = (got["n"], got["labels"] or 0)
    else:
        by_list = publish(spark, [(k, BLOCK) for k in dict.fromkeys(blocked)])
        listed = sizes(blocked)
    lengths = {by_rule: sizes(dict(rules)), by_list: listed}

    def hits(name: str, hosts: list[bytes], paths: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            heads = [path[:n] for n in lengths[name][0] if n <= len(path)]
            if not heads:
                continue
            for tail in suffixes(host, lengths[name][1]):
                for p in heads:
                    keys.append(tail + p)
                    owner.append(i)
        codes = _array(name).codes_of(keys)
        best: list[bytes] = [b""] * len(hosts)
        what = np.zeros(len(hosts), "u1")
        for k in np.nonzero(codes)[0]:
            i = owner[k]
            if (-len(keys[k]), keys[k]) < (-len(best[i]), best[i]):
                best[i], what[i] = keys[k], codes[k]
        return best, what

    def work(given_hosts: list[str], given_paths: list[str]) -> tuple:
        hosts, paths = [x.encode() for x in given_hosts], [x.encode() for x in given_paths]
        best, what = hits(by_rule, hosts, paths)
        _, listed = hits(by_list, hosts, paths)
        verdict = np.where(what > 0, what, np.where(listed > 0, BLOCK, ALLOW))
        return [x.decode() if x else None for x in best], np.where(verdict == BLOCK, "block", "allow").tolist()

    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    p = pages.select(*rest).withColumn("_url", F.col(url))
    host, path = split_url(F.col("_url"))
    p = p.withColumn("host", host).withColumn("path", path).drop("_url")
    fields = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    return mapped(p, p.columns, ["host", "path"], fields, work)
