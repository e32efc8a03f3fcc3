"""URL filters by sorted digest arrays.

A list of rules becomes arrays in files: the 64-bit xxhash keys of its strings in order, and beside
them the full strings. Spark hands the files to every executor, whose tasks map them into memory,
probe a batch of URLs with one binary search over all its candidate strings, and confirm each hit
by its stored string, so that two strings of one key are never taken for one another.
"""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir

#: Lists of more bytes than this are joined instead of mapped.
MAPPED_BYTES = 64 << 20
#: The seed of Spark's own xxhash64, so that keys computed by Spark and by tasks are the same.
SEED = 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: bytes) -> int:
    return xxhash.xxh64_intdigest(value, SEED)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z in lower case; empty for null and where there is no ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


class Digests:
    """Sorted keys with their strings, and for each string a list of numbers: one file's content."""

    def __init__(self, data: np.ndarray, of: Callable[[bytes], int] = digest):
        n, m = data[:16].view(np.int64).tolist()
        ends = 16 + 8 * np.cumsum([n, n + 1, n + 1, m])
        self.keys, self.at, self.numbers_at, self.numbers = (data[a:b].view(np.int64) for a, b in zip([16, *ends], ends, strict=False))
        self.strings, self.of = data[ends[-1] :], of

    @staticmethod
    def pack(keys: list[int], strings: list[bytes], numbers: list[list[int]]) -> bytes:
        """The file of a list whose (signed) keys are in order."""
        ends = lambda parts: np.cumsum([0, *map(len, parts)])
        flat = [x for row in numbers for x in row]
        arrays = [[len(keys), len(flat)], keys, ends(strings), ends(numbers), flat]
        return b"".join(np.asarray(a, np.int64).tobytes() for a in arrays) + b"".join(strings)

    def string(self, i: int) -> bytes:
        return self.strings[self.at[i] : self.at[i + 1]].tobytes()

    def numbers_of(self, i: int) -> list[int]:
        return self.numbers[self.numbers_at[i] : self.numbers_at[i + 1]].tolist()

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The place of each string in the list, or -1."""
        keys = np.fromiter(map(self.of, wanted), np.uint64, len(wanted)).view(np.int64)
        at, out = np.searchsorted(self.keys, keys), np.full(len(wanted), -1)
        left = np.flatnonzero(at < len(self.keys))
        while len(left):  # once for each string of one key, so nearly always once
            left = left[self.keys[at[left]] == keys[left]]
            for i in left.tolist():
                if self.string(at[i]) == wanted[i]:
                    out[i] = at[i]
            left = left[out[left] < 0]
            at[left] += 1
            left = left[at[left] < len(self.keys)]
        return out


def best_rules(hosts: list[bytes], paths: list[bytes], listed: Digests, rules: Digests) -> list[int]:
    """For each pair of host and path the place of its longest rule, or -1.

    Only suffixes and prefixes of listed lengths are tried, so that a URL of any length costs what
    the list's lengths allow."""
    lengths = np.unique(np.diff(listed.at)).tolist()
    suffixes, of = [], []
    for i, host in enumerate(hosts):
        for n in lengths:
            if n == len(host) or n < len(host) and host[len(host) - n - 1] == 46:
                suffixes.append(host[len(host) - n :])
                of.append(i)
    tries, which = [], []
    for place, suffix, i in zip(listed.find(suffixes).tolist(), suffixes, of, strict=True):
        if place >= 0:
            for n in listed.numbers_of(place):
                if n <= len(paths[i]):
                    tries.append(suffix + paths[i][:n])
                    which.append((i, len(suffix)))
    best: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(hosts)
    for place, rule, (i, host_bytes) in zip(rules.find(tries).tolist(), tries, which, strict=True):
        if place >= 0:
            best[i] = max(best[i], (len(rule), host_bytes, place))
    return [b[2] for b in best]


def prepared(rules: DataFrame) -> DataFrame:
    """(host, path, rule, blocks): one row for each rule that a URL can fit; of equal ones a block wins."""
    named = rules.select(F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    able = named.where(r"host rlike '^[^/?#]+$' AND path rlike '^(/[^?#]*)?$' AND verdict IN ('allow', 'block')")
    return able.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks")).withColumn("rule", F.concat("host", "path"))


def _file(spark: SparkSession, rows: DataFrame) -> str:
    """A file of rows (s string, numbers array) in the shared folder, handed to every executor; its name there.
    It stays until the session ends, as executors that join later fetch it too."""
    table = rows.select(F.xxhash64("s").alias("k"), F.encode("s", "utf-8").alias("s"), "numbers").orderBy("k", "s").toArrow()
    content = Digests.pack(*(table.column(c).to_pylist() for c in ("k", "s", "numbers")))
    name = f"digests-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rootgrain/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for i in range(0, len(content), 4 << 20):
        out.write(content[i : i + (4 << 20)])
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", mapped_bytes: int = MAPPED_BYTES) -> DataFrame:
    """urls with the columns host, path, rule and verdict.

    rules has the columns host, path and verdict (allow or block). A rule fits its host and all
    subdomains, if the URL's path starts with the rule's; the longest rule (host and path together)
    gives the verdict, `default` does where none fits. rule is that rule's host and path, else null.

    Null URLs and those without :// have an empty host and path, which no rule fits. Hosts are
    compared with port and user as they stand. Equal URLs get equal verdicts, equal rules are one,
    and of equal rules with both verdicts block holds. Rules with a null or empty host, a path that
    neither is empty nor begins with /, or another verdict fit nothing. A null path is an empty one.
    No rules at all give `default` throughout; an empty table gives an empty one. Columns of the names
    added are replaced, all others pass through.

    The list is mapped by every executor where it has mapped_bytes at most; then no row is shuffled.
    Longer lists are joined on the same keys and strings, with the same result.
    """
    hosts, paths, verdicts = fresh(urls, "_url_host", "_url_path", "_verdict")
    split = urls.withColumns({hosts: host_of(F.col(url)), paths: path_of(F.col(url))})
    usable = prepared(rules)
    held = usable.agg(F.sum(F.octet_length("rule") + F.octet_length("host") + 64)).first()[0] or 0
    judged = _mapped(split, usable, hosts, paths, verdicts) if held <= mapped_bytes else _joined(split, usable, hosts, paths, verdicts)
    found = F.col(verdicts)
    kept = judged.drop(*[c for c in urls.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url])
    named = {"host": F.col(hosts), "path": F.col(paths), "rule": found["rule"], "verdict": F.when(found["rule"].isNull(), F.lit(default)).when(found["blocks"], "block").otherwise("allow")}
    return kept.withColumns(named).drop(hosts, paths, verdicts)


def _mapped(split: DataFrame, usable: DataFrame, host: str, path: str, out: str) -> DataFrame:
    spark = split.sparkSession
    number = lambda c: c.cast("bigint")
    of_rules = _file(spark, usable.select(F.col("rule").alias("s"), F.array(number(F.col("blocks"))).alias("numbers")))
    of_hosts = _file(spark, usable.groupBy(F.col("host").alias("s")).agg(F.collect_set(number(F.octet_length("path"))).alias("numbers")))

    @F.pandas_udf("struct<rule string, blocks boolean>")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        listed, rules = (Digests(np.memmap(SparkFiles.get(name), np.uint8, "r")) for name in (of_hosts, of_rules))
        for h, p in batches:
            code, pairs = pd.factorize(pd.Series(list(zip(h, p, strict=True)), dtype=object))
            best = best_rules([a.encode("utf-8", "surrogatepass") for a, _ in pairs], [b.encode("utf-8", "surrogatepass") for _, b in pairs], listed, rules)
            told = [(rules.string(b).decode("utf-8", "surrogatepass"), bool(rules.numbers_of(b)[0])) if b >= 0 else (None, None) for b in best]
            yield pd.DataFrame({"rule": pd.Series([told[c][0] for c in code], dtype=object), "blocks": pd.Series([told[c][1] for c in code], dtype=object)})

    return split.withColumn(out, probe(host, path))


def _joined(split: DataFrame, usable: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """The same by joins on key and string: distinct pairs of host and path, their candidates, the longest hit."""
    pairs = split.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    lengths = usable.groupBy(F.col("host").alias("listed")).agg(F.collect_set(F.octet_length("path")).alias("lengths"))
    labels = usable.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    parts = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = lambda df, c: df.withColumn("k", F.xxhash64(c))
    hits = keyed(pairs.select("h").distinct().select("h", F.explode(suffixes).alias("listed")), "listed").join(keyed(lengths, "listed"), ["k", "listed"]).select("h", "listed", "lengths")
    prefix = lambda n: F.concat(F.col("listed").cast("binary"), F.substr(F.encode("p", "utf-8"), F.lit(1), n))
    tries = pairs.join(hits, "h").select("h", "p", F.length("listed").alias("n"), F.explode(F.transform(F.filter("lengths", lambda n: n <= F.octet_length("p")), prefix)).alias("s"))
    rules = keyed(usable.select("rule", "blocks", F.encode("rule", "utf-8").alias("s")), "s")
    best = keyed(tries, "s").join(rules, ["k", "s"]).groupBy("h", "p").agg(F.max_by(F.struct("rule", "blocks"), F.struct(F.octet_length("s"), "n")).alias(out))
    return split.join(best.withColumnsRenamed({"h": "_h", "p": "_p"}), (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left").drop("_h", "_p")
