"""Queries over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import dims
from .dims import BLOCK_HEADER_SIZE, Options, preset
from .functions import layout, scalars
from .operators import archives, parity
from .plans import blocks

EXP = 10  # a small block exponent, for plans only; archives need 16 or more
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_files(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


FILE_IDS = 1000  # documents a file: no language or source makes one file grow with the table


def files_by_lang(spark, sf_dir) -> DataFrame:
    """Files of the texts of a language and source whose ids share their thousands, in the order of doc_id; several blocks each.

    Dealt out by a number, which adaptive execution leaves: by their bytes it would make
    little more tasks than there are cores, and coding takes longer than bytes tell.
    """
    keys, width = ["lang", "source", "part"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    rows = read(spark, sf_dir, "documents").withColumn("part", scalars.idiv(F.col("doc_id"), FILE_IDS)).repartition(width, *keys)
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda t: t["text"]), "")
    return rows.select(F.concat_ws("/", "lang", "source", "part").alias("file_id"), text.cast("binary").alias("content"))


_BY_LANG = f"""
SELECT lang || '/' || source || '/' || (doc_id // {FILE_IDS}) AS file_id, string_agg(text, '' ORDER BY doc_id) AS content FROM documents GROUP BY lang, source, doc_id // {FILE_IDS}
"""
_PLAN = f"""
d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range((n + {(1 << EXP) - 1}) // {1 << EXP})) AS block_idx FROM d),
plan AS (SELECT doc_id, block_idx, block_idx * {1 << EXP} AS block_offset, least({1 << EXP}, n - block_idx * {1 << EXP}) AS size,
  block_idx = (n + {(1 << EXP) - 1}) // {1 << EXP} - 1 AS is_last, least({1 << EXP}, n - block_idx * {1 << EXP}) < {1 << EXP} AS is_partial FROM p)
"""


def _plan(spark, sf_dir) -> DataFrame:
    return blocks.block_plan(read(spark, sf_dir, "documents"), F.octet_length("text"), EXP, ["doc_id"])


@query(f"WITH {_PLAN} SELECT doc_id, block_idx::BIGINT AS block_idx, block_offset::BIGINT AS block_offset, size::BIGINT AS size, is_last, is_partial FROM plan")
def block_plan_documents(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"""SELECT lang, sum((octet_length(encode(text)) + {(1 << EXP) - 1}) // {1 << EXP})::BIGINT AS n_blocks, sum(octet_length(encode(text)))::BIGINT AS bytes
FROM documents GROUP BY lang""")
def block_count_by_lang(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    n = scalars.ceil_div(F.octet_length("text").cast("long"), 1 << EXP)
    return docs.groupBy("lang").agg(F.sum(n).alias("n_blocks"), F.sum(F.octet_length("text")).alias("bytes"))


_RAW = "(CASE WHEN abs(size - 65536) <= 8191 THEN 2 ELSE 3 END)"


@query(f"""WITH {_PLAN}, q AS (SELECT *, size + {_RAW} + 1 AS physical_size FROM plan)
SELECT doc_id, block_idx::BIGINT AS block_idx, physical_size::BIGINT AS physical_size,
 (32 + coalesce(sum(physical_size + 64) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS header_off FROM q""")
def block_offsets_prefix(spark, sf_dir):
    plan = _plan(spark, sf_dir).withColumn("physical_size", scalars.raw_payload_size(F.col("size")))
    return blocks.physical_offsets(plan, ["doc_id"]).select("doc_id", "block_idx", "physical_size", "header_off")


@query(f"""WITH {_PLAN} SELECT doc_id, block_idx::BIGINT AS block_idx, lead(block_idx) OVER (PARTITION BY doc_id ORDER BY block_idx) IS NULL AS last_flag FROM plan""")
def block_last_flag(spark, sf_dir):
    return _plan(spark, sf_dir).select("doc_id", "block_idx", F.col("is_last").alias("last_flag"))


@query("""WITH b AS (SELECT user_id, event_id, event_id % 7 = 0 AS is_partial FROM events),
l AS (SELECT *, lag(is_partial) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM b) SELECT user_id, event_id AS block_idx, is_partial FROM l WHERE before""")
def partial_order_check(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("block_idx"), (F.col("event_id") % 7 == 0).alias("is_partial"))
    return blocks.partial_order(rows, ["user_id"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN c = 0 THEN 0 WHEN each <= 65536 THEN 16 ELSE least(length(ltrim(bin(each - 1), '0')), 62) END::INT AS block_exp
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS c, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE (l_orderkey * 12345 + l_partkey % 5 - 1) // (l_partkey % 5) END AS each FROM lineitem)""")
def block_exponent_from_count(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    count = F.col("l_partkey") % 5
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(scalars.block_exponent_from_count(F.col("l_orderkey") * 12345, F.when(count > 0, count)), F.lit(0)).cast("int").alias("block_exp"))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_orderkey * 54321 > 268435456 THEN least(19 + l_linenumber % 10 + 1, 30) ELSE 19 + l_linenumber % 10 END)::INT AS block_exp FROM lineitem""")
def default_block_exponent(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", scalars.default_block_exponent(F.col("l_orderkey") * 54321, F.col("l_linenumber") % 10 + 19).cast("int").alias("block_exp"))


@query("""SELECT p::INT AS preset, CASE WHEN p < 4 THEN 'fast' ELSE 'normal' END AS mode, CASE WHEN p < 4 THEN 'hc4' ELSE 'bt4' END AS finder,
(19 + p)::INT AS dict_exp, (19 + p)::INT AS block_exp, 3::INT AS lc, 0::INT AS lp, 2::INT AS pb, nice::INT AS nice, depth::INT AS depth,
(CASE WHEN depth > 0 THEN depth WHEN p < 4 THEN 4 + nice // 4 ELSE 16 + nice // 2 END)::INT AS real_depth
FROM (VALUES (0,128,4),(1,128,8),(2,273,24),(3,273,48),(4,16,0),(5,32,0),(6,64,0),(7,64,0),(8,64,0),(9,64,0)) t(p, nice, depth)""")
def preset_table(spark, sf_dir):
    return dims.preset_table(spark)


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least(8, l_partkey % 20 - 5))::INT AS lc, greatest(0, least(4, l_partkey % 9 - 2))::INT AS lp,
greatest(0, least(4, l_suppkey % 9 - 2))::INT AS pb, greatest(16, least(31, l_partkey % 50))::INT AS dict_exp, greatest(16, least(62, l_suppkey % 100))::INT AS block_exp FROM lineitem""")
def option_clamp(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    c = scalars.clamp
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", c(part % 20 - 5, 0, 8).cast("int").alias("lc"), c(part % 9 - 2, 0, 4).cast("int").alias("lp"),
        c(supp % 9 - 2, 0, 4).cast("int").alias("pb"), c(part % 50, 16, 31).cast("int").alias("dict_exp"), c(supp % 100, 16, 62).cast("int").alias("block_exp"),
    )


@query("""SELECT b::INT AS props, (b % 9)::INT AS lc, (b // 9 % 5)::INT AS lp, (b // 45)::INT AS pb, (((b // 45) * 5 + b // 9 % 5) * 9 + b % 9)::INT AS again FROM range(225) t(b)""")
def props_roundtrip(spark, sf_dir):
    rows = spark.range(225).select(F.col("id").cast("int").alias("props"))
    lc, lp, pb = scalars.props_parts(F.col("props"))
    rows = rows.select("props", lc.cast("int").alias("lc"), lp.cast("int").alias("lp"), pb.cast("int").alias("pb"))
    return rows.withColumn("again", scalars.props_byte(F.col("lc"), F.col("lp"), F.col("pb")))


@query(f"""WITH {_PLAN} SELECT doc_id, block_idx::BIGINT AS block_idx,
CASE WHEN is_partial THEN '40000000' ELSE '00000000' END || lpad(lower(hex(size + {_RAW} + 1)), 8, '0') AS field, is_partial AS partial, (size + {_RAW} + 1)::BIGINT AS physical FROM plan""")
def block_header_flags(spark, sf_dir):
    plan = _plan(spark, sf_dir).withColumn("field", layout.block_size_hex(scalars.raw_payload_size(F.col("size")), F.col("is_partial")))
    _, second, size = layout.flagged_size(F.unhex("field"))
    return plan.select("doc_id", "block_idx", "field", (second == 1).alias("partial"), size.alias("physical"))


_HEADERS = """SELECT p.p AS preset, e.e AS ecc, f.f AS prefilter, 'fedcba9801' || lpad(lower(hex(e.e)), 2, '0') || lpad(lower(hex(f.f)), 2, '0')
|| lpad(lower(hex(19 + p.p)), 2, '0') || lpad(lower(hex((2 * 5 + 0) * 9 + 3)), 2, '0') || lpad(lower(hex(19 + p.p)), 2, '0') AS bytes
FROM range(10) p(p), range(4) e(e), range(9) f(f)"""


def _headers(spark) -> DataFrame:
    presets, levels = dims.preset_table(spark), dims.ecc_table(spark).select(F.col("bits").alias("ecc"))
    # 10 x 4 x 9 rows of the format's own tables
    rows = presets.join(F.broadcast(levels)).join(F.broadcast(dims.prefilter_table(spark).select(F.col("code").alias("prefilter"))))
    return rows.withColumn("bytes", layout.header_hex({c: F.col(c) for c in ("ecc", "prefilter", "block_exp", "lc", "lp", "pb", "dict_exp")}))


@query(f"SELECT preset::INT AS preset, ecc::INT AS ecc, prefilter::INT AS prefilter, bytes FROM ({_HEADERS})")
def header_bytes_hex(spark, sf_dir):
    return _headers(spark).select("preset", "ecc", "prefilter", "bytes")


_BREAKS = [("none", 0, ""), ("magic", 0, "00"), ("version", 4, "02"), ("reserved", 5, "04"), ("prefilter", 6, "09"), ("block_exp", 7, "0f"), ("props", 8, "ff"), ("dict_exp", 9, "20")]


@query(f"""WITH h AS ({_HEADERS}), b(rule, spot, x) AS (VALUES {', '.join(f"('{r}', {a}, '{x}')" for r, a, x in _BREAKS)}),
m AS (SELECT preset, ecc, prefilter, rule, CASE WHEN x = '' THEN bytes ELSE substr(bytes, 1, 2 * spot) || x || substr(bytes, 2 * spot + 3) END AS bytes FROM h, b)
SELECT preset::INT AS preset, ecc::INT AS ecc, prefilter::INT AS prefilter, rule, CASE WHEN substr(bytes, 1, 8) <> 'fedcba98' THEN 'magic' WHEN substr(bytes, 9, 2) <> '01' THEN 'version'
 WHEN substr(bytes, 11, 2) NOT IN ('00','01','02','03') THEN 'reserved' WHEN substr(bytes, 13, 2) > '08' THEN 'prefilter'
 WHEN substr(bytes, 15, 2) NOT BETWEEN '10' AND '3e' THEN 'block_exp' WHEN substr(bytes, 17, 2) > 'e0' THEN 'props' WHEN substr(bytes, 19, 2) NOT BETWEEN '10' AND '1f' THEN 'dict_exp' ELSE 'ok' END AS status FROM m""")
def header_parse_validate(spark, sf_dir):
    breaks = spark.createDataFrame(_BREAKS, "rule string, at int, x string")
    rows = _headers(spark).join(F.broadcast(breaks))
    cut = F.concat(F.substr("bytes", F.lit(1), F.col("at") * 2), F.col("x"), F.substr("bytes", F.col("at") * 2 + 3))
    record = F.unhex(F.when(F.col("x") == "", F.col("bytes")).otherwise(cut))
    return rows.select("preset", "ecc", "prefilter", "rule", layout.header_status(record).alias("status"))


@query("""SELECT doc_id, '80000000' || lpad(lower(hex(octet_length(encode(text)))), 8, '0') AS field, octet_length(encode(text))::BIGINT AS size FROM documents""")
def trailer_flag_hex(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", layout.trailer_size_hex(F.octet_length("text").cast("long")).alias("field"))
    return rows.select("doc_id", "field", layout.flagged_size(F.unhex("field"))[2].alias("size"))


@query("""SELECT doc_id, level, CASE bits WHEN 0 THEN n ELSE (n + k - 1) // k * 255 END::BIGINT AS stored FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents),
(VALUES ('none', 0, 1), ('standard', 1, 239), ('paranoid', 2, 223), ('extreme', 3, 191)) e(level, bits, k)""")
def ecc_expanded_size(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    rows = rows.join(F.broadcast(dims.ecc_table(spark)))
    return rows.select("doc_id", "level", scalars.ecc_expanded(F.col("n"), F.col("bits")).alias("stored"))


@query(f"""WITH {_PLAN} SELECT lang, sum(a)::BIGINT AS bytes, count(*) AS archives FROM (SELECT d.doc_id, 32 + 64 + coalesce(sum(64 + size + {_RAW} + 1), 0) AS a FROM d LEFT JOIN plan USING (doc_id) GROUP BY d.doc_id)
JOIN documents USING (doc_id) GROUP BY lang""")
def archive_size_raw(spark, sf_dir):
    plan = _plan(spark, sf_dir).groupBy("doc_id").agg(F.sum(scalars.raw_payload_size(F.col("size")) + 64).alias("b"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang").join(plan, "doc_id", "left")
    return docs.groupBy("lang").agg(F.sum(F.coalesce("b", F.lit(0)) + 96).alias("bytes"), F.count(F.lit(1)).alias("archives"))


@query("""SELECT CASE WHEN n = 0 THEN 'none' WHEN abs(n - 65536) <= 8191 THEN 'delta' ELSE 'plain' END AS kind, count(*) AS chunks, sum(n)::BIGINT AS bytes
FROM (SELECT octet_length(encode(coalesce(text, ''))) AS n FROM documents UNION ALL SELECT octet_length(encode(coalesce(html, ''))) FROM pages) GROUP BY 1""")
def raw_chunk_kind(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("text").alias("t")).unionAll(read(spark, sf_dir, "pages").select("html"))
    rows = docs.select(F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n"))
    kind = F.when(F.col("n") == 0, "none").when(scalars.raw_header_size(F.col("n")) == 2, "delta").otherwise("plain")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_partkey * 37 % 65536 + 1 > 65280 THEN 4 ELSE 5 END)::INT AS header FROM lineitem")
def lzma_chunk_hdr_len(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.coded_header_size(F.col("l_partkey") * 37 % 65536 + 1).alias("header"))


@query("""SELECT user_id, event_id, coalesce(lag(event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id), true) AS reset FROM events""")
def chunk_state_reset(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return blocks.state_resets(rows, ["user_id"], "event_id", F.col("event_type") == "click").drop("event_type")


@query(f"""WITH {_PLAN} SELECT doc_id, block_idx::BIGINT AS block_idx, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_off,
size = {1 << EXP} AS full, size = 0 AS empty FROM plan""")
def data_offsets(spark, sf_dir):
    room = blocks.block_room(F.col("size"), EXP)
    rows = blocks.data_offsets(_plan(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", "block_idx", "data_off", room["full"].alias("full"), room["empty"].alias("empty"))


@query("""SELECT lang, source, n, bit_count(n)::INT AS stack, bit_count((n & -n) - 1)::INT AS last_merges, n - 1 AS merges FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)""")
def tree_shape(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    shape = blocks.tree_shape(F.col("n"))
    return rows.select("lang", "source", "n", shape["stack"].alias("stack"), shape["last_merges"].alias("last_merges"), shape["merges"].alias("merges"))


def _sized(unit: str, one: int) -> str:
    parts = []
    for bound, d in ((100, 0), (10, 1), (1, 2)):
        q, r = f"(b * {10**d} // {one})", f"(b * {10**d} % {one})"
        v = f"({q} + CASE WHEN {r} * 2 > {one} OR ({r} * 2 = {one} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
        text = f"{v}::VARCHAR" if d == 0 else f"({v} // {10**d})::VARCHAR || '.' || lpad(({v} % {10**d})::VARCHAR, {d}, '0')"
        parts.append(f"WHEN b >= {bound * one} THEN {text} || ' {unit}'")
    return " ".join(parts)


@query(f"""SELECT l_orderkey, l_linenumber, CASE {' '.join(_sized(u, 1 << 10 * k) for u, k in (('PiB', 5), ('TiB', 4), ('GiB', 3), ('MiB', 2), ('KiB', 1)))} ELSE b::VARCHAR || ' B' END AS size
FROM (SELECT l_orderkey, l_linenumber, (l_partkey * CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 13 WHEN 3 THEN 1024 WHEN 4 THEN 70001 WHEN 5 THEN 9000001 ELSE 987654321 END)::HUGEINT AS b FROM lineitem)""")
def format_size(spark, sf_dir):
    by = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 2, 13).when(F.col("l_linenumber") == 3, 1024).when(F.col("l_linenumber") == 4, 70001).when(F.col("l_linenumber") == 5, 9000001).otherwise(987654321)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.format_size(F.col("l_partkey") * by.cast("long")).alias("size"))


@query("""SELECT doc_id, CASE WHEN n > 0 THEN p::DOUBLE * 100.0 / n::DOUBLE ELSE 0.0 END AS ratio, CASE WHEN p <= n THEN 'saved' ELSE 'overhead' END AS label, CASE WHEN doc_id % 3 > 0 THEN n::DOUBLE / 1048576.0 / (doc_id % 3) ELSE 0.0 END AS mib_s
FROM (SELECT doc_id, octet_length(encode(text)) AS n, octet_length(encode(text)) * (50 + doc_id % 70) // 100 AS p FROM documents)""")
def ratio_saved(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    rows = rows.withColumn("p", scalars.idiv(F.col("n") * (F.col("doc_id") % 70 + 50), 100))
    return rows.select("doc_id", scalars.ratio_percent(F.col("p"), F.col("n")).alias("ratio"), scalars.space_label(F.col("p"), F.col("n")).alias("label"), scalars.mib_per_second(F.col("n"), F.col("doc_id") % 3).alias("mib_s"))


_GF = """RECURSIVE orbit(i, x) AS (SELECT 0, 1 UNION ALL SELECT i + 1, CASE WHEN xor(x, x * 2) > 255 THEN xor(xor(x, x * 2), 283) ELSE xor(x, x * 2) END FROM orbit WHERE i < 254),
prod AS (SELECT a.x AS a, b.x AS b, c.x AS p FROM orbit a, orbit b, orbit c WHERE c.i = (a.i + b.i) % 255)"""


def _parity_sql(n: int, k: int, rows: str) -> str:
    """Parity as the value of the interpolation that the roots demand: a remainder by long division, in SQL."""
    p = n - k
    return f"""WITH {_GF},
g0 AS (SELECT 0 AS step, 0 AS j, 1 AS c), {', '.join(f"g{s} AS (SELECT {s} AS step, j, bit_xor(c)::INT AS c FROM (SELECT j + 1 AS j, c FROM g{s - 1} UNION ALL SELECT g.j, p FROM g{s - 1} g JOIN prod ON a = g.c AND b = (SELECT x FROM orbit WHERE i = {s})) GROUP BY j)" for s in range(1, p + 1))},
r0 AS (SELECT 0 AS i, j, c FROM g{p} WHERE j < {p} AND c > 0), {', '.join(f"r{i} AS (SELECT {i} AS i, j, bit_xor(c)::INT AS c FROM (SELECT j + 1 AS j, c FROM r{i - 1} WHERE j < {p - 1} UNION ALL SELECT g.j, p FROM r{i - 1} t JOIN g{p} g ON g.j < {p} JOIN prod ON a = t.c AND b = g.c WHERE t.j = {p - 1}) GROUP BY j)" for i in range(1, k))},
gen AS ({' UNION ALL '.join(f'SELECT * FROM r{i}' for i in range(k))}),
d AS ({rows}), b AS (SELECT key, i, ('0x' || substr(hexed, 2 * i + 1, 2))::INT AS v FROM d, range({k}) t(i)),
q AS (SELECT b.key, gen.j, bit_xor(p)::INT AS x FROM b JOIN gen ON gen.i = b.i JOIN prod ON a = b.v AND prod.b = gen.c GROUP BY b.key, gen.j)
SELECT key, string_agg(lpad(lower(hex(coalesce(x, 0))), 2, '0'), '' ORDER BY j) AS parity FROM (SELECT d.key, t.j FROM d, range({p}) t(j)) LEFT JOIN q USING (key, j) GROUP BY key"""


# every 40 bytes of a text, of an empty one 40 zeros; a word's key has its place in the last six figures
_WORDS_40 = """SELECT doc_id * 1000000 + i AS key, rpad(substr(hexed, 80 * i + 1, 80), 80, '0') AS hexed FROM
(SELECT doc_id, hex(encode(coalesce(text, ''))) AS hexed, unnest(range(greatest(1, (octet_length(encode(coalesce(text, ''))) + 39) // 40))) AS i FROM documents)"""


@query(f"SELECT key // 1000000 AS key, key % 1000000 AS word_idx, parity FROM ({_parity_sql(64, 40, _WORDS_40)})")
def rs_parity_64_40(spark, sf_dir):
    """Parity of every 40 bytes of every text; of an empty or null one as of one word of zeros."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.encode("text", "UTF-8").alias("data"))
    return parity.word_parity(rows, "key", "data", 64, 40)


@query(_parity_sql(32, 10, f"SELECT preset * 100 + ecc * 10 + prefilter AS key, bytes AS hexed FROM ({_HEADERS})"))
def rs_parity_32_10(spark, sf_dir):
    rows = _headers(spark).select((F.col("preset") * 100 + F.col("ecc") * 10 + F.col("prefilter")).cast("long").alias("key"), F.unhex("bytes").alias("data"))
    return parity.parity(rows, ["key"], "data", 32, 10)


@query("SELECT preset * 100 + ecc * 10 + prefilter AS key, CASE WHEN preset % 2 = 1 THEN 22 ELSE 0 END::BIGINT AS nonzero FROM (" + _HEADERS + ")")
def rs_syndrome_zero(spark, sf_dir):
    """Codewords have no syndrome; one changed byte makes all of them differ from zero."""
    rows = _headers(spark).select((F.col("preset") * 100 + F.col("ecc") * 10 + F.col("prefilter")).cast("long").alias("key"), "preset", F.unhex("bytes").alias("data"))
    words = rows.join(parity.parity(rows, ["key"], "data", 32, 10), "key")
    broken = F.concat(F.unhex(F.lit("ff")), F.substring("data", 2, 9))
    words = words.select("key", F.concat(F.when(F.col("preset") % 2 == 1, broken).otherwise(F.col("data")), F.unhex("parity")).alias("w"))
    return parity.dirty_codewords(words, ["key"], "w", 32, 10)


@query(f"WITH {_GF} SELECT x::INT AS a, y::INT AS b, coalesce(p, 0)::INT AS product FROM (SELECT t.x, u.y FROM range(256) t(x), range(256) u(y)) LEFT JOIN prod ON prod.a = x AND prod.b = y")
def gf_mul_table(spark, sf_dir):
    rows = spark.range(65536).select(scalars.idiv(F.col("id"), 256).cast("int").alias("a"), (F.col("id") % 256).cast("int").alias("b"))
    return rows.withColumn("product", parity.gf_multiply(F.col("a"), F.col("b")))


_WORDS = {
    "arm": ("w // 16777216 = 235", "3942645760 + ((w * 4 % 4294967296 + place + 8) // 4) % 16777216"),
    "powerpc": ("w // 67108864 = 18 AND w % 4 = 1", "1207959552 + (w % 67108864 - 1 + place) % 67108864 + 1"),
    "sparc": (
        "w // 4194304 IN (256, 511)",
        "1073741824 + ((w * 4 % 4294967296 + place) % 4294967296 // 4) // 4194304 % 2 * 1069547520 + ((w * 4 % 4294967296 + place) % 4294967296 // 4) % 4194304",
    ),
    "arm64": ("w // 67108864 = 37", "2483027968 + (w + place // 4) % 67108864"),
    # ADRP: an address of pages, if it is within 512 MiB
    "arm64_page": (
        "(w & 2667577344) = 2415919104 AND (((((w >> 29) & 3) | ((w >> 3) & 2097148)) + 131072) & 1835008) = 0",
        "2415919104 | (w & 31) | ((moved & 3) << 29) | ((moved & 262140) << 3) | ((0 - (moved & 131072)) & 14680064)",
    ),
}
_PREFILTER = {"arm": 2, "arm64": 4, "sparc": 5, "powerpc": 6}


def _word_sql(name: str) -> str:
    rules = [_WORDS[name]] + ([_WORDS["arm64_page"]] if name == "arm64" else [])
    cases = " ".join(f"WHEN {hit} THEN {value}" for hit, value in rules)
    top = {
        "sparc": "CASE WHEN i % 4 = 0 THEN 1073741824 ELSE 2143289344 END + i * 40503 % 4194304",
        "arm64": "CASE WHEN l_linenumber % 4 = 0 THEN 2483027968 + i * 40503 % 67108864 ELSE 2415919104 + i * 40503 % 4 * 536870912 + (i * 7919 % 131072 + 458752) % 524288 * 32 + i % 32 END",
        "arm": "3942645760 + i * 40503 % 16777216", "powerpc": "1207959552 + i * 40503 % 16777216 * 4 + 1",
    }[name]
    return f"""SELECT i AS word, place, w AS before, (CASE {cases} ELSE w END)::BIGINT AS after FROM (SELECT *, (((w >> 29) & 3) | ((w >> 3) & 2097148)) + (place >> 12) AS moved FROM
(SELECT i, i * 4 AS place, (CASE WHEN l_linenumber % 2 = 0 THEN {top} ELSE l_partkey * 2654435 % 4294967296 END)::BIGINT AS w FROM (SELECT *, l_orderkey * 8 + l_linenumber AS i FROM lineitem)))"""


def _encoded_words(spark, sf_dir, name: str, top) -> DataFrame:
    """Words of lineitem, every other one a branch, through the library's filter."""
    _functions(spark)
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    word = F.when(F.col("l_linenumber") % 2 == 0, top(i)).otherwise(F.col("l_partkey") * 2654435 % 4294967296)
    rows = read(spark, sf_dir, "lineitem").select(i.alias("word"), (i * 4).alias("place"), word.alias("before"))
    return rows.withColumn("after", F.call_function("bcj_words", "before", "place", F.lit(_PREFILTER[name])))


@query(_word_sql("arm"))
def bcj_arm_words(spark, sf_dir):
    return _encoded_words(spark, sf_dir, "arm", lambda i: F.lit(235 << 24) + i * 40503 % (1 << 24))


@query(_word_sql("powerpc"))
def bcj_powerpc_words(spark, sf_dir):
    return _encoded_words(spark, sf_dir, "powerpc", lambda i: F.lit(18 << 26) + i * 40503 % (1 << 24) * 4 + 1)


@query(_word_sql("sparc"))
def bcj_sparc_words(spark, sf_dir):
    return _encoded_words(spark, sf_dir, "sparc", lambda i: F.when(i % 4 == 0, 1 << 30).otherwise(511 << 22) + i * 40503 % (1 << 22))


@query(_word_sql("arm64"))
def bcj_arm64_words(spark, sf_dir):
    branch = lambda i: F.lit(37 << 26) + i * 40503 % (1 << 26)
    page = lambda i: F.lit(0x90000000) + i * 40503 % 4 * (1 << 29) + (i * 7919 % (1 << 17) + 458752) % (1 << 19) * 32 + i % 32
    return _encoded_words(spark, sf_dir, "arm64", lambda i: F.when(F.col("l_linenumber") % 4 == 0, branch(i)).otherwise(page(i)))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 3 = 0 THEN 16 + l_suppkey % 10 WHEN l_linenumber % 3 = 1 THEN CASE WHEN each <= 65536 THEN 16 ELSE least(length(ltrim(bin(each - 1), '0')), 62) END
WHEN size > 268435456 THEN least(19 + l_partkey % 10 + 1, 30) ELSE 19 + l_partkey % 10 END)::INT AS block_exp, (19 + l_partkey % 10)::INT AS dict_exp, (l_suppkey % 4)::INT AS ecc, 3::INT AS lc, 2::INT AS pb
FROM (SELECT *, l_orderkey * 77777 + 1 AS size, (l_orderkey * 77777 + 1 + l_linenumber - 1) // l_linenumber AS each FROM lineitem)""")
def option_precedence(spark, sf_dir):
    """What a preset, a block exponent, a block count, the data's size and an ECC level lead to."""
    _functions(spark)
    line = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.call_function(
            "pack_options", F.col("l_partkey") % 10, F.col("l_orderkey") * 77777 + 1, F.when(line % 3 == 0, F.col("l_suppkey") % 10 + 16),
            F.when(line % 3 < 2, line), F.col("l_suppkey") % 4,
        ).alias("o"),
    )
    return rows.select("l_orderkey", "l_linenumber", "o.block_exp", "o.dict_exp", "o.ecc", "o.lc", "o.pb")


@query("SELECT doc_id AS file_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(repeat('z', octet_length(encode(coalesce(text, ''))))) AS digest, 'ok' AS status FROM documents")
def replace_roundtrip(spark, sf_dir):
    """The only block of each archive replaced by as many other bytes; archives without blocks stay."""
    files = documents_as_files(spark, sf_dir)
    index = F.when(F.octet_length("content") > 0, F.lit(0).cast("long"))
    other = files.select("file_id", index.alias("block_idx"), F.encode(F.expr("repeat('z', octet_length(content))"), "UTF-8").alias("data"))
    packed = archives.pack(files, Options(block_exp=30, dict_exp=16), raw=True).join(other, "file_id")
    return _told(archives.unpack(archives.replace_block(packed)))


@query(f"""SELECT file_id, octet_length(encode(content))::BIGINT AS bytes, md5(CASE WHEN n < 2 THEN hexed ELSE substr(hexed, 1, 131072) || repeat('7A', least(65536, octet_length(encode(content)) - 65536)::INT) || substr(hexed, 262145) END) AS digest, 'ok' AS status
FROM (SELECT *, hex(encode(content)) AS hexed, (octet_length(encode(content)) + 65535) // 65536 AS n FROM ({_BY_LANG}))""")
def replace_middle(spark, sf_dir):
    """The second block of archives of several, replaced by as many other bytes; the others keep theirs."""
    files = files_by_lang(spark, sf_dir)
    rest = F.least(F.octet_length("content") - 65536, F.lit(65536))
    other = files.select("file_id", F.when(rest > 0, F.lit(1).cast("long")).alias("block_idx"), rest.alias("_n"))
    other = other.select("file_id", "block_idx", F.encode(F.expr("repeat('z', _n)"), "UTF-8").alias("data"))
    options = preset(1).with_(ecc=1, block_exp=16)
    packed = archives.pack(files, options).join(other, "file_id")
    out = archives.unpack(archives.replace_block(packed, options=options))
    return out.select("file_id", F.octet_length("content").cast("long").alias("bytes"), F.md5(F.hex("content").cast("binary")).alias("digest"), "status")


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 6 = 1 THEN 'truncated' WHEN doc_id % 6 = 2 THEN 'root' WHEN doc_id % 6 = 3 THEN 'size'
WHEN doc_id % 6 = 4 AND n > 0 THEN 'hash' WHEN doc_id % 6 = 5 THEN 'magic' ELSE 'ok' END AS status, (doc_id % 6 = 4 AND n > 0)::BIGINT AS bad_blocks
FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)""")
def verify_broken(spark, sf_dir):
    """Archives cut short, with another root hash, size or magic, or with a changed byte that no parity covers."""
    return archives.verify(_broken(spark, sf_dir)).select("file_id", "status", "bad_blocks")


def _broken(spark, sf_dir) -> DataFrame:
    """An archive for each document, of which five in six are wrong."""
    packed = archives.pack(documents_as_files(spark, sf_dir), Options(block_exp=16, dict_exp=16), raw=True)
    # the trailer's data: the size behind a flag, 8 bytes, and the root hash; an archive without blocks has two records alone
    packed = packed.withColumn("size", F.expr("cast(conv(hex(substring(archive, octet_length(archive) - 62, 7)), 16, 10) AS long)"))
    packed = packed.withColumn("root_hash", F.expr("substring(archive, octet_length(archive) - 55, 32)"))
    kind, n = F.col("file_id") % 6, F.octet_length("archive")
    ends = F.pandas_udf(archives._trailers, "binary")
    other = F.when(kind == 2, F.unhex(F.sha2(F.col("root_hash"), 256))).otherwise(F.col("root_hash"))
    end = ends(F.col("size") + F.when(kind == 3, 1).otherwise(0), other)
    body = F.expr("substring(archive, 1, octet_length(archive) - 64)")
    # the first data byte stands behind the header, the block's header and the chunk's (two or three bytes)
    changed = F.expr("overlay(archive PLACING unhex(hex(255 - conv(hex(substring(archive, 101, 1)), 16, 10))) FROM 101 FOR 1)")
    # header parity is made for the wrong magic, or it would be corrected
    head = F.lit(archives.records._with_parity(b"\xfe\xdc\xba\x97" + archives.records.header(Options(block_exp=16, dict_exp=16))[4:10], 32))
    broken = (
        F.when(kind == 1, F.expr("substring(archive, 1, octet_length(archive) - 10)")).when(kind.isin(2, 3), F.concat(body, end))
        .when((kind == 4) & (n > 96), changed).when(kind == 5, F.concat(head, F.expr("substring(archive, 33)"))).otherwise(F.col("archive"))
    )
    return packed.select("file_id", broken.alias("archive"))


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 6 = 1 THEN 'truncated' WHEN doc_id % 6 = 2 THEN 'root' WHEN doc_id % 6 = 3 THEN 'size'
WHEN doc_id % 6 = 4 AND n > 0 THEN 'hash' WHEN doc_id % 6 = 5 THEN 'magic' ELSE 'ok' END AS status,
CASE WHEN doc_id % 6 = 5 OR n = 0 OR (doc_id % 6 = 4 AND n <= 65536) THEN 0 ELSE (n + 65535) // 65536 - (doc_id % 6 = 4)::INT END::BIGINT AS good
FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)""")
def source_broken(spark, sf_dir):
    """The same archives as files, read by the source: an archive that is wrong says so, and gives the blocks that are right."""
    from .sources.archive import register
    from .sources.scratch import scratch

    register(spark)
    folder = scratch(spark, "broken")
    files = _broken(spark, sf_dir).select("file_id", "archive")
    _store_files(files, folder)
    rows = spark.read.format("strongbox").load(folder)
    own = F.regexp_extract("path", r"(\d+)\.sba$", 1).cast("long").alias("file_id")
    wrong = F.min(F.when(F.col("status") != "ok", F.struct(F.col("block_idx").isNull(), "status")))["status"]
    found = rows.groupBy(own).agg(wrong.alias("status"), F.count_if((F.col("status") == "ok") & F.col("block_idx").isNotNull()).alias("good"))
    names = documents_as_files(spark, sf_dir).select("file_id")
    return names.join(found, "file_id", "left").select("file_id", F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("good", F.lit(0)).alias("good"))


def _store_files(files: DataFrame, folder: str) -> None:
    """Each row's bytes as they are in a file of its own, ``<file_id>.sba``."""
    import pyarrow.fs

    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)

    def put(batches):
        to, path = pyarrow.fs.FileSystem.from_uri(folder)
        for part in archives._few(batches, 1):
            for name, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                with to.open_output_stream(f"{path}/{name}.sba") as out:
                    out.write(data)
            yield part.select(["file_id"])

    files.select("file_id", "archive").mapInArrow(put, "file_id long").write.format("noop").mode("overwrite").save()


def pages_as_files(spark, sf_dir) -> DataFrame:
    """Pages for the sink, dealt out by a number: a table of few files or row groups would give few tasks, and coding takes longer than reading."""
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return rows.repartition(width, "name")


@query("SELECT page_id, (octet_length(encode(coalesce(html, ''))) + 65535) // 65536 AS blocks, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes FROM pages WHERE html <> ''")
def stream_source(spark, sf_dir):
    """Pages written through the sink, then read as a stream, some archives a batch; pages without bytes have no block."""
    from .sources.archive import register
    from .sources.scratch import scratch

    register(spark)
    folder = scratch(spark, "arriving")
    pages_as_files(spark, sf_dir).write.format("strongbox").option("path", f"{folder}/in").option("preset", 0).option("blockExponent", 16).mode("append").save()
    stream = spark.readStream.format("strongbox").option("logPath", f"{folder}/log").option("maxFilesPerTrigger", 1000).load(f"{folder}/in")
    slim = stream.select(F.regexp_extract("path", r"(\d+)\.sba$", 1).cast("long").alias("page_id"), "block_idx", F.octet_length("data").alias("n"))
    running = slim.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    found = spark.read.schema("page_id long, block_idx long, n int").parquet(f"{folder}/out")
    return found.groupBy("page_id").agg(F.count("block_idx").alias("blocks"), F.sum("n").alias("bytes"))


@query("""SELECT conv_id::VARCHAR AS stream_id, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS digest, 'ok' AS status FROM conversations GROUP BY conv_id""")
def stream_decode(spark, sf_dir):
    """Archives of conversations, damaged and cut into pieces, decoded by the stateful stream."""
    import uuid

    from .sources.scratch import scratch
    from .streaming.decode import OUTPUT, decode_stream

    name, folder = f"blocks_{uuid.uuid4().hex}", scratch(spark, "decode")
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("file_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda t: t["text"]), "")
    packed = archives.damage(archives.pack(turns.agg(F.encode(text, "UTF-8").alias("content")), preset(1).with_(ecc=1, block_exp=16)), 5)
    pieces = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(octet_length(archive) - 1) div 700"))).alias("seq"))
    pieces.select(F.col("file_id").alias("stream_id"), "seq", F.expr("substring(archive, cast(seq * 700 + 1 AS int), 700)").alias("data")).write.parquet(f"{folder}/in")
    rows = spark.readStream.schema("stream_id string, seq long, data binary").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    running = decode_stream(rows).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    found = spark.read.schema(OUTPUT).parquet(f"{folder}/{name}")
    data = F.array_sort(F.collect_list(F.when(F.col("kind") == "block", F.struct("block_idx", F.hex("data").alias("x")))))
    whole = F.unhex(F.array_join(F.transform(data, lambda b: b["x"]), ""))
    wrong = F.min(F.when(F.col("status") != "ok", F.col("status")))
    ended = F.count_if(F.col("kind") == "trailer") == 1
    per = found.groupBy("stream_id").agg(whole.alias("content"), wrong.alias("wrong"), ended.alias("ended"))
    status = F.coalesce("wrong", F.when(F.col("ended"), "ok").otherwise("open"))
    return per.select("stream_id", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"), status.alias("status"))


@query("SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes, md5(coalesce(html, '')) AS digest FROM pages")
def source_roundtrip(spark, sf_dir):
    """Pages written through the sink and read back block by block through the source."""
    from .sources.archive import register
    from .sources.scratch import scratch

    register(spark)
    folder = scratch(spark, "archives")
    pages_as_files(spark, sf_dir).write.format("strongbox").option("path", folder).option("preset", 1).option("blockExponent", 16).mode("append").save()
    page = F.regexp_extract("path", r"(\d+)\.sba$", 1).cast("long").alias("page_id")
    blocks_ = spark.read.format("strongbox").load(folder).select(page, "block_idx", "data")
    names = spark.read.format("strongbox").option("mode", "meta").load(folder).select(page, "size")
    data = blocks_.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "data"))).alias("b"))
    whole = F.unhex(F.coalesce(F.array_join(F.transform("b", lambda b: F.hex(b["data"])), ""), F.lit("")))
    return names.join(data, "page_id", "left").select("page_id", F.col("size").alias("bytes"), F.md5(whole).alias("digest"))


@query("""SELECT conv_id::VARCHAR AS stream_id, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS digest, 'ok' AS status FROM conversations GROUP BY conv_id""")
def stream_roundtrip(spark, sf_dir):
    """Conversations encoded turn by turn by the stateful stream; the archives unpacked."""
    import uuid

    from .sources.scratch import scratch
    from .streaming.encode import encode_stream

    name, folder = f"segments_{uuid.uuid4().hex}", scratch(spark, "stream")
    order = Window.partitionBy("conv_id").orderBy("turn")
    places = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.lead("turn").over(order).isNull().alias("eos"))
    rows = spark.readStream.schema(read(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parque*").join(places, ["conv_id", "turn"])
    chunks = rows.select(F.col("conv_id").cast("string").alias("stream_id"), "seq", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), "eos")
    query_ = encode_stream(chunks, preset(1).with_(ecc=1, block_exp=16)).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    parts = spark.read.schema("stream_id string, ord long, kind string, bytes binary").parquet(f"{folder}/{name}").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.hex("bytes").alias("x")))).alias("p"))
    packed = parts.select(F.col("stream_id").alias("file_id"), F.unhex(F.array_join(F.transform("p", lambda p: p["x"]), "")).alias("archive"))
    return _told(archives.unpack(packed)).withColumnRenamed("file_id", "stream_id")


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_partkey < 4 THEN l_partkey ELSE (length(ltrim(bin(l_partkey), '0')) - 1) * 2 + ((l_partkey >> (length(ltrim(bin(l_partkey), '0')) - 2)) & 1) END)::BIGINT AS slot,
(CASE WHEN l_linenumber + 1 < 6 THEN l_linenumber - 1 ELSE 3 END)::INT AS state FROM lineitem""")
def dist_slot(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.dist_slot(F.col("l_partkey")).cast("long").alias("slot"), scalars.dist_state(F.col("l_linenumber") + 1).cast("int").alias("state"))


@query("""SELECT e::INT AS dict_exp, least((1::BIGINT << e), 4294967280)::BIGINT AS bytes, ((1::BIGINT << e) + 7 + 15) // 16 * 16 AS rounded,
(least((1::BIGINT << e), 4294967280) + 4096 + 273 + 273 + least(least((1::BIGINT << e), 4294967280) // 2 + 524288, 536870912))::BIGINT AS buffer FROM range(16, 32) t(e)""")
def dict_sizes(spark, sf_dir):
    e = F.col("id").cast("int")
    size = scalars.dict_size(e)
    power = F.call_function("shiftleft", F.lit(1).cast("long"), e)
    return spark.range(16, 32).select(e.alias("dict_exp"), size.alias("bytes"), scalars.round_up_16(power + 7).alias("rounded"), scalars.window_buffer_size(size, 4096, 273, 273).alias("buffer"))


@query("""SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY md5('7:' || doc_id || ':' || pos), pos) AS r FROM documents, range(255) t(pos)) WHERE r <= 8""")
def corrupt_topk_positions(spark, sf_dir):
    """Each row's first places come from its own array; ids that are repeated meet with eight places a row."""
    digest = lambda p: F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"), F.lit(":"), p.cast("string")).cast("binary"))
    key = lambda p: F.named_struct(F.lit("k"), digest(p), F.lit("pos"), p)
    places = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(254).cast("long")), key)), 1, 8)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.inline(places))
    order = Window.partitionBy("doc_id").orderBy("k", "pos")
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 8").select("doc_id", "pos")


@query(f"WITH {_PLAN} SELECT doc_id, block_idx::BIGINT AS block_idx FROM plan p WHERE NOT EXISTS (SELECT 1 FROM plan q WHERE q.doc_id = p.doc_id AND q.block_idx = p.block_idx AND (q.doc_id + q.block_idx) % 5 > 0)")
def verify_join_missing(spark, sf_dir):
    plan = _plan(spark, sf_dir).select("doc_id", "block_idx")
    return plan.join(plan.where((F.col("doc_id") + F.col("block_idx")) % 5 > 0), ["doc_id", "block_idx"], "left_anti")


@query("""SELECT l_orderkey, l_linenumber, level, name FROM lineitem JOIN (VALUES (0, 'none'), (1, 'standard'), (2, 'paranoid'), (3, 'extreme')) e(b, level) ON l_partkey % 4 = b
JOIN (VALUES (0, 'none'), (1, 'x86'), (2, 'arm'), (3, 'arm_thumb'), (4, 'arm64'), (5, 'sparc'), (6, 'powerpc'), (7, 'ia64'), (8, 'riscv')) f(c, name) ON l_suppkey % 9 = c""")
def dim_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4).cast("int").alias("bits"), (F.col("l_suppkey") % 9).cast("int").alias("code"))
    rows = rows.join(F.broadcast(dims.ecc_table(spark)), "bits").join(F.broadcast(dims.prefilter_table(spark)), "code")
    return rows.select("l_orderkey", "l_linenumber", "level", "name")


@query(f"""WITH {_PLAN}, s AS (SELECT doc_id, -1 AS ord, 32 AS n FROM documents UNION ALL SELECT doc_id, block_idx, 64 + size + {_RAW} + 1 FROM plan UNION ALL SELECT doc_id, 4611686018427387904, 64 FROM documents)
SELECT doc_id, ord::BIGINT AS ord, n::BIGINT AS n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM s""")
def segment_union_layout(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    long_ = lambda n: F.lit(n).cast("long")
    middle = _plan(spark, sf_dir).select("doc_id", F.col("block_idx").alias("ord"), (scalars.raw_payload_size(F.col("size")) + 64).cast("long").alias("n"))
    s = docs.select("doc_id", long_(-1).alias("ord"), long_(32).alias("n")).unionByName(middle).unionByName(docs.select("doc_id", long_(2**62).alias("ord"), long_(64).alias("n")))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query("""SELECT page_id, url || '.sba' AS packed, CASE WHEN ends_with(n, '.sba') THEN substr(n, 1, length(n) - 4) ELSE n || '.extracted' END AS unpacked FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN url || '.sba' ELSE url END AS n FROM pages)""")
def output_name(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".sba"))).otherwise(F.col("url")).alias("n"))
    return rows.select("page_id", scalars.output_name(F.col("url"), False).alias("packed"), scalars.output_name(F.col("n"), True).alias("unpacked"))


_SAME = "SELECT doc_id AS file_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(coalesce(text, '')) AS digest, 'ok' AS status FROM documents"


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"), "status")


@query(_SAME)
def pack_unpack_roundtrip(spark, sf_dir):
    packed = archives.pack(documents_as_files(spark, sf_dir), preset(3).with_(ecc=1, block_exp=16))
    return _told(archives.unpack(packed))


@query(_SAME)
def repair_roundtrip(spark, sf_dir):
    """Every protected stretch damaged as far as it can be corrected, repaired, and read without validation."""
    packed = archives.pack(documents_as_files(spark, sf_dir), preset(1).with_(ecc=2, block_exp=16), raw=True)
    return _told(archives.unpack(archives.repair(archives.damage(packed, 11)), validate=False))


@query(f"SELECT file_id, octet_length(encode(content))::BIGINT AS bytes, md5(content) AS digest, 'ok' AS status FROM ({_BY_LANG})")
def damaged_read_roundtrip(spark, sf_dir):
    """Multi-block archives, damaged, corrected while they are read."""
    packed = archives.pack(files_by_lang(spark, sf_dir), preset(2).with_(ecc=1, block_exp=16, prefilter=1))
    return _told(archives.unpack(archives.damage(packed, 3)))


@query("SELECT doc_id AS file_id, octet_length(encode(coalesce(text, '')))::BIGINT * 2 AS bytes, md5(coalesce(text, '') || coalesce(text, '')) AS digest, 'ok' AS status FROM documents")
def append_roundtrip(spark, sf_dir):
    files = documents_as_files(spark, sf_dir)
    options = preset(1).with_(ecc=0, block_exp=16)
    packed = archives.pack(files, options).join(files.withColumnRenamed("content", "extra"), "file_id")
    return _told(archives.unpack(archives.append(packed, options=options)))


_LISTED = f"""SELECT file_id, 'ok' AS status, n_blocks::BIGINT AS n_blocks, size::BIGINT AS size, (96 + n_blocks * 64 + stored)::BIGINT AS file_size, CASE WHEN n_blocks > 0 THEN stored // n_blocks END::BIGINT AS average_block
FROM (SELECT *, n_blocks + size + 2 * (size // 65536) + CASE WHEN size % 65536 > 0 THEN CASE WHEN abs(size % 65536 - 65536) <= 8191 THEN 2 ELSE 3 END ELSE 0 END AS stored
FROM (SELECT file_id, octet_length(encode(content)) AS size, (octet_length(encode(content)) + 65535) // 65536 AS n_blocks FROM ({_BY_LANG})))"""


def _listed(spark, sf_dir, validate: bool) -> DataFrame:
    packed = archives.pack(files_by_lang(spark, sf_dir), Options(block_exp=16, dict_exp=16), raw=True)
    return archives.list_archives(packed, validate=validate).select("file_id", "status", "n_blocks", "size", "file_size", "average_block")


@query(_LISTED)
def list_raw_archives(spark, sf_dir):
    return _listed(spark, sf_dir, True)


@query(_LISTED)
def list_unchecked(spark, sf_dir):
    """The same by the records as they are, without a look at their parity."""
    return _listed(spark, sf_dir, False)


# the header's 11 bytes, 12 of each block's header and of the trailer, 16 of each codeword of 223
@query("""SELECT file_id, (23 + coalesce(sum(12 + 16 * ((phys + 222) // 223)), 0))::BIGINT AS changed FROM (SELECT doc_id AS file_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents) d
LEFT JOIN (SELECT doc_id, size + 1 + CASE WHEN abs(size - 65536) <= 8191 THEN 2 ELSE 3 END AS phys FROM
 (SELECT doc_id, unnest(range((n + 65535) // 65536)) AS b, n, least(65536, n - b * 65536) AS size FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents))) p ON p.doc_id = d.file_id GROUP BY file_id""")
def damage_counts(spark, sf_dir):
    """How many bytes are changed where every protected stretch is damaged as far as it can be corrected."""
    packed = archives.pack(documents_as_files(spark, sf_dir), Options(ecc=2, block_exp=16, dict_exp=16), raw=True)
    return archives.damage(packed, 7).select("file_id", "changed")


@query(f"SELECT file_id, 'ok' AS status, ((octet_length(encode(content)) + 65535) // 65536)::BIGINT AS n_blocks, 0::BIGINT AS bad_blocks, 0::BIGINT AS corrected FROM ({_BY_LANG})")
def verify_archives(spark, sf_dir):
    return archives.verify(archives.pack(files_by_lang(spark, sf_dir), preset(4).with_(ecc=1, block_exp=16)))


@query(f"""SELECT file_id, b::BIGINT AS block_idx, 'ok' AS status, md5(substr(hex(encode(content)), 1 + b * 131072, 131072)) AS digest FROM ({_BY_LANG}) f, range(1, 3) t(b) WHERE b < (octet_length(encode(content)) + 65535) // 65536""")
def verify_range(spark, sf_dir):
    """Only blocks 1 and 2 are decoded."""
    packed = archives.pack(files_by_lang(spark, sf_dir), preset(1).with_(ecc=1, block_exp=16))
    found = archives.decode_blocks(packed, where=F.col("block_idx").between(1, 2))
    return found.select("file_id", "block_idx", "status", F.md5(F.hex("data").cast("binary")).alias("digest"))


@query(f"""SELECT file_id, b::BIGINT AS block_idx, (b % 2)::INT AS copy, md5(substr(hex(encode(content)), 1 + b * 131072, 131072)) AS digest FROM (SELECT *, unnest(range((octet_length(encode(content)) + 65535) // 65536)) AS b FROM ({_BY_LANG}))""")
def multi_copy_repair(spark, sf_dir):
    """Two copies, each with every other block's payload overwritten: each block comes from the copy that has it whole.

    Zeros go over a payload from its first byte and no further than its last: so it ends at
    once, whatever it held, however short it is.
    """
    packed = archives.pack(files_by_lang(spark, sf_dir), Options(block_exp=16, dict_exp=16), raw=True)
    where = archives.block_directory(packed, payloads=False)
    places = where.groupBy("file_id").agg(F.collect_list(F.struct("block_idx", "header_off", "physical_size")).alias("at"))
    copies = packed.join(places, "file_id").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))  # behind the join: an archive is shuffled once
    zeros = "substring(X'000000000000', 1, cast(least(6, x.physical_size) AS int))"
    hit = F.expr(f"aggregate(filter(at, x -> x.block_idx % 2 <> copy), archive, (a, x) -> overlay(a PLACING {zeros} FROM cast(x.header_off + {BLOCK_HEADER_SIZE + 1} AS int)))")
    best = archives.best_copies(copies.select("file_id", "copy", hit.alias("archive")))
    return best.select("file_id", "block_idx", "copy", F.md5(F.hex("data").cast("binary")).alias("digest"))


# fixed values: fill byte, KiB and root hash of published constant inputs
_PUBLISHED = [
    (0x42, 32, "848eb396076028fdfe1133c3078e4541817f76461d27163adbfc82a55363aee1"),
    (0x43, 128, "2abdf8fb89c3df201cc4c4d33bdf58a094126177f5820ac9f9b40000468d2d09"),
    (0x44, 192, "0b6310de56f0483e8175e9b4d30e14123e526959b56b55ba3d803d46a0a7f72e"),
    (0x45, 256, "999251bdbb729527f92296cd57309ee8548f5bdeb85952f970e55e7573e49c91"),
    (0x46, 320, "6dc0f6e4fe1c61290891ff698bdb4fecd4b7138f7dba6587daf93a717e35f830"),
    (0x47, 512, "303af5f1fb59ac7b2f654d87544b6b7ffd40b1b269916bcfe310ac25977d5b5c"),
    (0x48, 1024, "544f851259a35e14f6db263bec303018931571071820a691207189ec537288e2"),
    (0x49, 200, "11d18712ed9237e3492805542aa2600d6ad339d14c3095ec136ce0c2c884473d"),
    (0x4A, 260, "e35d464de3144ea508a4944dbb89b3017d41efa76ff840dee6fa117be46e615a"),
    (0x4B, 128, "15741f4c1583214c8dc575bc7e2849c6d3728583f81f67c7524d4fdc5ec18f87"),
]


@query(f"SELECT fill::BIGINT AS file_id, (kib // 64 + (kib % 64 > 0)::INT)::BIGINT AS n_blocks, kib * 1024::BIGINT AS size, root AS root_hash FROM (VALUES {', '.join(map(str, _PUBLISHED))}) t(fill, kib, root)")
def published_roots(spark, sf_dir):
    """Root hashes of inputs whose hashes are published, from blocks of 64 KiB hashed side by side."""
    rows = spark.createDataFrame([(f, k) for f, k, _ in _PUBLISHED], "file_id long, kib int")
    files = rows.select("file_id", F.encode(F.expr("repeat(char(file_id), kib * 1024)"), "UTF-8").alias("content"))
    encoded = archives.encode_blocks(files, Options(block_exp=16, dict_exp=16), raw=True)
    return archives.file_roots(encoded).select("file_id", "n_blocks", "size", F.lower(F.hex("root_hash")).alias("root_hash"))


@query()
def root_hashes(spark, sf_dir):
    encoded = archives.encode_blocks(files_by_lang(spark, sf_dir), Options(block_exp=16, dict_exp=16), raw=True)
    return archives.file_roots(encoded).select("file_id", "n_blocks", "size", F.lower(F.hex("root_hash")).alias("root_hash"))


@query()
def cv_per_block(spark, sf_dir):
    encoded = archives.encode_blocks(documents_as_files(spark, sf_dir), Options(block_exp=16, dict_exp=16), raw=True)
    return encoded.select("file_id", "block_idx", F.lower(F.hex("cv")).alias("cv"))


def _functions(spark) -> None:
    from .functions.udfs import register

    register(spark)


@query("SELECT doc_id, f::INT AS prefilter, md5(coalesce(text, '')) AS digest FROM documents, range(9) t(f)")
def bcj_roundtrip(spark, sf_dir):
    _functions(spark)
    rows = documents_as_files(spark, sf_dir).select(F.col("file_id").alias("doc_id"), "content", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("prefilter"))
    return rows.selectExpr("doc_id", "prefilter", "md5(bcj_decode(bcj_encode(content, prefilter), prefilter)) AS digest")


@query("SELECT page_id, CASE WHEN html <> '' THEN 0 ELSE -1 END::INT AS code, CASE WHEN html <> '' THEN md5(html) END AS digest FROM pages")
def buffer_functions(spark, sf_dir):
    """pack and unpack as SQL functions of a column."""
    _functions(spark)
    rows = read(spark, sf_dir, "pages").selectExpr("page_id", "pack(encode(html, 'UTF-8'), 3) AS p")
    return rows.selectExpr("page_id", "p.code AS code", "md5(unpack(p.data).data) AS digest")


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS usize FROM documents")
def chunk_walk(spark, sf_dir):
    """Chunk headers of coded payloads add up to the data; a row for each document, also of no bytes or of an id that others have."""
    _functions(spark)
    documents_as_files(spark, sf_dir).selectExpr("monotonically_increasing_id() AS row", "file_id", "lz_encode(content, 2) AS payload").createOrReplaceTempView("_payloads")
    return spark.sql("SELECT file_id AS doc_id, coalesce(sum(usize), 0L) AS usize FROM _payloads, LATERAL lz_chunks_outer(payload) GROUP BY row, file_id")


@query("SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 238) // 239 AS codewords FROM documents")
def codeword_rows(spark, sf_dir):
    """A row for each document, also of no bytes or of an id that others have."""
    _functions(spark)
    documents_as_files(spark, sf_dir).selectExpr("monotonically_increasing_id() AS row", "file_id", "rs_encode(content, 1) AS stored").createOrReplaceTempView("_stored")
    return spark.sql("SELECT file_id AS doc_id, count(cw_idx) AS codewords FROM _stored, LATERAL codewords_outer(stored, 1) GROUP BY row, file_id")


@query("SELECT doc_id, md5(coalesce(text, '')) AS decoded, md5(coalesce(text, '')) AS corrected, 0::BIGINT AS changed, 0::BIGINT AS lost FROM documents")
def coded_functions(spark, sf_dir):
    """Coding and the strongest parity (three) there and back as SQL functions."""
    _functions(spark)
    rows = documents_as_files(spark, sf_dir).selectExpr("file_id AS doc_id", "content", "lz_decode(lz_encode(content, 2), 2) AS plain", "rs_decode(rs_encode(content, 3), 3) AS p")
    return rows.selectExpr("doc_id", "md5(plain) AS decoded", "md5(substring(p.data, 1, octet_length(content))) AS corrected", "p.corrected AS changed", "p.lost AS lost")


@query("SELECT doc_id AS file_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(coalesce(text, '')) AS digest, 'ok' AS status FROM documents")
def extreme_roundtrip(spark, sf_dir):
    """The strongest parity, every stretch damaged as far as it can be corrected, read with validation."""
    packed = archives.pack(documents_as_files(spark, sf_dir), preset(1).with_(ecc=3, block_exp=16), raw=True)
    return _told(archives.unpack(archives.damage(packed, 13)))


@query(f"""SELECT file_id, ((octet_length(encode(content)) + 65535) // 65536)::BIGINT AS blocks, true AS same FROM ({_BY_LANG})""")
def tree_functions(spark, sf_dir):
    """The root from block values as SQL functions compute them, and as the archives' own records and trailer have it."""
    _functions(spark)
    files = files_by_lang(spark, sf_dir)
    packed = archives.pack(files, Options(block_exp=16, dict_exp=16), raw=True)
    packed.createOrReplaceTempView("_archives")
    one = "CASE WHEN block_idx IS NOT NULL THEN struct(block_idx, cv) END"  # a file of no bytes has no block
    listed = spark.sql(f"SELECT file_id, array_sort(collect_list({one})) AS v FROM _archives, LATERAL archive_blocks_outer(archive) GROUP BY file_id")
    listed = listed.selectExpr("file_id", "tree_root(transform(v, x -> x.cv)) AS by_records")
    plan = blocks.block_plan(files, F.octet_length("content"), 16, ["file_id", "content"])
    own = plan.selectExpr("file_id", "block_idx", "block_cv(substring(content, cast(block_offset + 1 AS int), cast(size AS int)), block_offset, block_offset = 0 AND is_last) AS cv")
    own = own.groupBy("file_id").agg(F.count(F.lit(1)).alias("blocks"), F.array_sort(F.collect_list(F.struct("block_idx", "cv"))).alias("v"))
    ends = archives.list_archives(packed).select("file_id", "root_hash")
    met = ends.join(listed, "file_id").join(own, "file_id", "left").selectExpr("*", "tree_root(coalesce(transform(v, x -> x.cv), array())) AS by_values")
    return met.selectExpr("file_id", "coalesce(blocks, 0L) AS blocks", "by_records = root_hash AND by_values = root_hash AS same")


@query("SELECT conv_id, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) AS segments FROM conversations GROUP BY conv_id")
def copied_bytes(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("text").alias("segments"))
