"""URL filtering by a sort-merge range join of urls with host and path rules.

A host is keyed by its labels in reverse order, each with a full stop behind it
(``www.example.com`` -> ``com.example.www.``).  All keys that begin with a rule's
key are next to each other in sorted order, so a rule is an interval of keys.
Urls and rules are sorted together and swept once; a stack holds the rules whose
intervals are open, outermost first.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(at > 0, F.translate(host, upper, lower)).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


_OUT = "id long, host string, path string, rule string, verdict string"


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """The longest rule that fits each url, and its action.

    ``rules`` has host, path, action (``allow`` or ``block``).  A rule fits its
    host and all subdomains if the url's path starts with the rule's; the rule
    whose host + path is longest wins, at equal length the longer host, for a
    rule given with both actions ``block``.  No rule: null and ``default``.  A
    null url, or one without ``://``, has empty host and path and fits no rule.
    Rules with a null or empty host are ignored; a null path is empty.  One row
    per input row, repeated rows included; an empty table gives an empty result.

    Rows are dealt by splitters of (host key, hash of the row), taken from a
    sample of 40 rows per partition, which bears on balance alone: a host that
    makes up a third of the rows spans many partitions.  A rule goes to each
    partition that its interval meets, at most once per partition and nesting
    depth beyond the first, so rules are not broadcast.
    """
    spark = pages.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    url = F.col(url_col)
    urls = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(host_of(url), F.lit("")).alias("host"),
        F.coalesce(path_of(url), F.lit("")).alias("path"),
        F.xxhash64(F.col(id_col), url).alias("salt"),
    ).withColumn("key", host_key(F.col("host")))
    known = (
        rules.where("host IS NOT NULL AND host <> ''")
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))  # block sorts after allow
        .withColumn("key", host_key(F.col("host")))
    )
    n = pages.select(url_col).count()
    share = min(1.0, 40 * parts / max(n, 1))
    sample = urls.select("key", "salt").sample(share, seed=7) if share < 1 else urls.select("key", "salt")
    seen = sorted((r.key.encode(), r.salt) for r in sample.collect())
    splitters = [seen[len(seen) * k // parts] for k in range(1, parts)] if seen else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, salt = batch.column("key").to_pylist(), batch.column("salt").to_pylist()
            part = [bisect_right(splitters, (k.encode(), s)) for k, s in zip(key, salt, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"]
            )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            met = []
            for row in rows:
                low = row["key"].encode()
                first = bisect_right(splitters, (low, -(2**63)))
                last = bisect_right(splitters, (low + b"\xff", 2**63))
                met += [row | {"part": p} for p in range(first, last + 1)]
            names = [*batch.schema.names, "part"]
            kinds = [*batch.schema.types, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in met], k) for c, k in zip(names, kinds, strict=True)], names=names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # open rules: key; of each path (length, host length, path, rule, action); the paths' lengths, longest first
        stack: list[tuple[str, dict, list]] = []
        for batch in batches:
            out = []
            for id_, host, path, key, action in zip(*(batch.column(c).to_pylist() for c in ("id", "host", "path", "key", "action")), strict=True):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if action is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, held, sizes = stack[-1]
                    held[path] = (len(host) + len(path), len(host), path, host + path, action)
                    if len(path) not in sizes:
                        insort(sizes, len(path), key=lambda n: -n)
                    continue
                # of one host's rules the longest path that the url's begins with: a look-up for each length
                fits = [next((held[p] for n in sizes if (p := path[:n]) in held), None) for _, held, sizes in stack]
                rule, verdict = max((f for f in fits if f), default=(0, 0, "", None, default))[3:]
                out.append((id_, host, path, rule, verdict))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])],
                names=["id", "host", "path", "rule", "verdict"],
            )

    form = "id long, host string, path string, key string, action string, part int"
    dealt = urls.mapInArrow(deal, "id long, host string, path string, salt long, key string, part int")
    dealt = dealt.select("id", "host", "path", "key", F.lit(None).cast("string").alias("action"), "part")
    given = known.select(F.lit(None).cast("long").alias("id"), "host", "path", "key", "action").mapInArrow(spread, form)
    both = dealt.unionByName(given).repartitionById(parts, F.col("part"))
    swept = both.sortWithinPartitions("key", F.col("action").isNull()).select("id", "host", "path", "key", "action")
    return swept.mapInArrow(sweep, _OUT).withColumnRenamed("id", id_col)


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rhost, rpath, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT h.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(action, length(rhost || rpath)) AS action
  FROM h JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)
  GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id
"""
