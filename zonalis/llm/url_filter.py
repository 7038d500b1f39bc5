"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Listed keys are hosts of a block list and rules (a host with a path). The key universe is every key that
the corpus can ask for: each host, and for each shape of rule (labels of its host, characters of its
path) the url's host suffix with its path prefix. Level 1 is a Bloom filter of the listed keys, level 2
of the universe's other keys that pass level 1, level 3 of the listed keys that pass level 2, and so on
until none passes; a key's answer is the parity of the level that stops it, which is exact for every key
of the universe and needs no join. A level is one array of longs, read as a scalar subquery.

Keys are dealt into shards by hash so that no level is over ``max_bits``; each shard has a cascade of its own, and a
row's key asks its shard's. Shards are asked ``at_once`` at a time in one pass over the rows, so what a task holds is bounded
however long the list is; a longer list takes more passes of the same kind.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; empty
tables give empty results; repeated rows and ids are kept; further columns pass through untouched only
where asked for. Of rules that fit, the longest string wins, of equal ones the one with the longer host.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

BITS_PER_KEY, HASHES, MAX_BITS, AT_ONCE, DEPTH = 10, 4, 1 << 28, 8, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: The rules of the query: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards).cast("long")).cast("int")


class Cascade:
    """Exact membership of the universe's keys in a list, for the keys of some shards (``part`` of ``shards``)."""

    def __init__(self, levels: list[tuple[DataFrame, int]], part: range, shards: int):
        self.levels, self.part, self.shards = levels, part, shards

    @staticmethod
    def _bit(key: Column, level: int, j: int, bits: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level * 64 + j)), F.lit(bits).cast("long"))

    @classmethod
    def _passes(cls, key: Column, level: int, bits: int, words: DataFrame, part: range, shards: int) -> Column:
        filled = None
        for s in part:  # a key asks its shard's array
            mine = words.where(F.col("shard") == s).select("words").scalar()
            here = shard_of(key, shards) == s
            filled = F.when(here, mine) if filled is None else filled.when(here, mine)
        filled = words.select("words").scalar() if shards == 1 else filled
        out = F.lit(True)
        for j in range(HASHES):
            at = cls._bit(key, level, j, bits)
            out = out & (F.getbit(F.element_at(filled, (at / 64).cast("int") + 1), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return out

    @classmethod
    def _level(cls, keys: DataFrame, level: int, bits: int, part: range, shards: int) -> DataFrame:
        """One row for each shard: the level's bits as an array of longs."""
        at = keys.select(shard_of(F.col("key"), shards).alias("shard"), F.explode(F.array(*[cls._bit(F.col("key"), level, j, bits) for j in range(HASHES)])).alias("at"))
        put = at.select("shard", (F.col("at") / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")).alias("b"))
        zero = keys.sparkSession.range(bits // 64).select(F.explode(F.array(*[F.lit(s) for s in part])).alias("shard"), F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
        each = put.union(zero).groupBy("shard", "w").agg(F.bit_or("b").alias("b"))
        return each.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, part: range = range(1), shards: int = 1) -> "Cascade":
        """From distinct keys (key) of the shards: listed ones, and all that can be asked for."""
        sides, levels = [listed, universe], []
        for level in range(DEPTH):
            keys = sides[level % 2]
            n = keys.groupBy(shard_of(F.col("key"), shards)).count().agg(F.max("count")).first()[0] or 0
            if n == 0 and level:
                return cls(levels, part, shards)
            bits = -(-max(64, n * BITS_PER_KEY) // 64) * 64
            words = common.materialize(cls._level(keys, level, bits, part, shards))
            levels.append((words, bits))
            rest = sides[1 - level % 2].where(cls._passes(F.col("key"), level, bits, words, part, shards))
            if not level:  # of the universe only what passes is held against the list
                rest = rest.join(listed, "key", "left_anti")
            sides[1 - level % 2] = common.materialize(rest)
        raise RuntimeError("the cascade has not closed")

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            words, bits = self.levels[level]
            out = F.when(~self._passes(key, level, bits, words, self.part, self.shards), F.lit(level % 2 == 1)).otherwise(out)
        return out


def _keys(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> list[tuple[str, Column]]:
    """(tag, key or null) of all that one url can ask for; a tag stands before the key."""
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    out = [("host", F.when(host != "", F.concat(F.lit("host:"), host)))]
    for labels, n in shapes:
        suffix = F.substring_index(host, ".", -labels)
        for verdict in ("allow", "block"):
            out.append((verdict, F.when((host != "") & (F.length(path) >= n), F.concat(F.lit(f"{verdict}:"), suffix, F.substring(path, 1, n)))))
    return out


def judge(pages: DataFrame, listed_hosts: DataFrame, rules=RULES, url_col: str = "url", keep: Iterable[str] = ("page_id",), max_bits: int = MAX_BITS, at_once: int = AT_ONCE) -> DataFrame:
    """keep..., host, path, rule, verdict of every row. ``listed_hosts(host)`` is the block list."""
    spark = pages.sparkSession
    base = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    asked = base.select("host", "path").distinct()
    keys = _keys(F.col("host"), F.col("path"), rules)
    universe = common.materialize(asked.select(F.explode(F.array(*[k for _, k in keys])).alias("key")).where("key is not null").distinct())
    given = spark.createDataFrame([(f"{v}:{h}{p}",) for v, h, p in rules], "key string") if rules else spark.range(0).select(F.lit("").alias("key"))
    listed = common.materialize(given.union(listed_hosts.where("host is not null").select(F.concat(F.lit("host:"), "host"))).distinct())
    shards = 1 + listed.count() * BITS_PER_KEY // max_bits
    named = base.withColumns({f"_k{i}": k for i, (_, k) in enumerate(keys)}).withColumns({f"_in{i}": F.lit(False) for i in range(len(keys))})
    for first in range(0, shards, at_once):
        part = range(first, min(shards, first + at_once))
        mine = lambda df, part=part: df.where(shard_of(F.col("key"), shards).between(part.start, part.stop - 1))
        cascade = Cascade.build(mine(listed), mine(universe), part, shards)
        here = lambda key, part=part: shard_of(key, shards).between(part.start, part.stop - 1)
        found = {f"_in{i}": F.when(F.col(f"_k{i}").isNotNull() & here(F.col(f"_k{i}")), cascade.has(F.col(f"_k{i}"))).otherwise(F.col(f"_in{i}")) for i in range(len(keys))}
        named = named.withColumns(found)
        if part.stop < shards:
            named = common.materialize(named)
    fits = []
    for i, (tag, _) in enumerate(keys):
        if tag != "host":
            rule = F.substring(F.col(f"_k{i}"), len(tag) + 2, 1 << 30)
            fits.append(F.when(F.col(f"_in{i}"), F.struct(F.length(rule).alias("n"), F.length(F.substring_index(rule, "/", 1)).alias("h"), rule.alias("rule"), F.lit(tag).alias("verdict"))))
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,h:int,rule:string,verdict:string>")
    return named.withColumn("_best", best).select(
        *keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.when(F.col("_in0"), "block").otherwise("allow")).alias("verdict")
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """The data come without a block list: hosts whose MD5 starts with 0 stand for one."""
    pages = common.table(spark, sf_dir, "pages")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct().where(F.md5("host").startswith("0") & (F.col("host") != ""))
    return judge(pages, hosts)


OP1_SQL = f"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(url, '{URL}', 2), '') as path
  from pages),
rules(verdict, h, p) as (values {", ".join(str(r) for r in RULES)}),
fits as (
  select u.host, u.path, h || p as rule, verdict, row_number() over (partition by u.host, u.path order by length(h || p) desc, length(h) desc) as k
  from (select distinct host, path from u) u join rules on (u.host = h or ends_with(u.host, '.' || h)) and starts_with(u.path, p))
select page_id, u.host, u.path, rule,
       coalesce(verdict, case when u.host <> '' and starts_with(md5(u.host), '0') then 'block' else 'allow' end) as verdict
from u left join fits on fits.host = u.host and fits.path = u.path and k = 1
"""
