"""URL filter: a blocked Bloom filter in front of an exact hash join. DataFrame operations only.

Rules name a host and a beginning of paths. A URL's possible rules are the
ends of its host at label bounds with the beginnings of its path that have a
length some rule has. Each is a probe: its hash chooses one block of 256 bits,
and eight five-bit pieces of the hash one bit in each of the block's eight
words. The blocks are a table of at most MAX_BLOCKS rows, so its broadcast has
a bound; beyond it the filter only lets more through. Host ends are probed
first, so path beginnings are made for listed hosts alone. What passes is
joined with the rules by (host, path), which removes false positives; that
join is Spark's own, so a long list is shuffled and skewed keys are split.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule, as does any URL with an empty host. Of rules that fit, the
one with the longest string wins, then the one with the longer host; of rules
equal in host and path ``block`` wins. Rules with a null or empty host or
another verdict than allow or block are left out; a null path is empty and
fits every path. URLs without a rule get the default verdict. Every row is
judged, repeated and very long ones too; other columns are carried, clashing
ones replaced; without pages there are no rows, without rules every page gets
the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS_A_KEY = 16
BLOCK_BITS = 256
WORDS = 8
MAX_BLOCKS = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _key(host: Column, path: Column | None = None) -> Column:
    """Hash of a host alone, or of a host with a path."""
    return F.xxhash64(host) if path is None else F.xxhash64(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, WORDS * 5), F.lit(blocks).cast("bigint"))


def _bits(key: Column) -> list[Column]:
    """For each word of a block the word with this key's bit."""
    pieces = [F.shiftright(key, 5 * i).bitwiseAND(31).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1), piece) for piece in pieces]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocks (block, w0 .. w7) in which some bit is set, of a column ``key``."""
    words = [bit.alias(f"w{i}") for i, bit in enumerate(_bits(F.col("key")))]
    return keys.select(_block(F.col("key"), blocks).alias("block"), *words).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def _may_hold(probes: DataFrame, key: Column, filter_: DataFrame, blocks: int) -> DataFrame:
    """Rows of probes whose key the filter may hold; at most MAX_BLOCKS rows of nine numbers are broadcast."""
    passed = F.lit(True)
    for i, bit in enumerate(_bits(F.col("probe"))):
        passed = passed & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    found = (probes.withColumn("probe", key).withColumn("block", _block(F.col("probe"), blocks))
             .join(F.broadcast(filter_), "block").where(passed))
    return found.select(*probes.columns)


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (host and path of the rule that decides; null if none) and verdict.

    rules: (verdict, host, path). key only spreads the work; rows that share it are judged one by one.
    """
    rules = (rules.where("host != '' AND verdict IN ('allow', 'block')")
             .select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    shapes = rules.agg(F.count("*").alias("n"), F.collect_set(_labels(F.col("host"))).alias("labels"),
                       F.collect_set(F.length("path")).alias("lengths")).first()
    # Two keys a rule at most; shapes are a few small numbers.
    wanted = max(1, -(-2 * shapes["n"] * BITS_A_KEY // BLOCK_BITS))
    blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    keys = rules.select(_key(F.col("host")).alias("key")).union(rules.select(_key(F.col("host"), F.col("path"))))
    filter_ = bloom_blocks(keys, blocks)

    parsed = urls.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    labels = F.split("host", r"\.")
    ends = F.transform(F.filter(F.array([F.lit(n) for n in sorted(shapes["labels"])] or [F.lit(0)]), lambda n: (n > 0) & (n <= F.size(labels))),
                       lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)))
    hosts = parsed.where("host != ''").select(F.col(key).alias("key"), "host", "path", F.explode(ends).alias("end"))
    hosts = _may_hold(hosts, _key(F.col("end")), filter_, blocks)
    starts = F.transform(F.filter(F.array([F.lit(n) for n in sorted(shapes["lengths"])] or [F.lit(0)]), lambda n: n <= F.length("path")),
                         lambda n: F.substring("path", F.lit(1), n))
    probes = hosts.select("*", F.explode(starts).alias("begin"))
    probes = _may_hold(probes, _key(F.col("end"), F.col("begin")), filter_, blocks)
    listed = rules.select(F.col("host").alias("end"), F.col("path").alias("begin"), "verdict")
    best = F.max(F.struct(F.length(F.concat("end", "begin")).alias("length"), F.length("end").alias("host_length"),
                          F.concat("end", "begin").alias("rule"), "verdict")).alias("best")
    hits = probes.join(listed, ["end", "begin"]).groupBy("key", "host", "path").agg(best)
    same = (F.col(f"urls.{key}").eqNullSafe(F.col("hits.key")) & (F.col("urls.host") == F.col("hits.host"))
            & (F.col("urls.path") == F.col("hits.path")))
    joined = parsed.alias("urls").join(hits.alias("hits"), same, "left")
    return joined.select("urls.*", F.col("hits.best.rule").alias("rule"),
                         F.coalesce("hits.best.verdict", F.lit(default)).alias("verdict"))
