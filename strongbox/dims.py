"""Enumerations and presets of the archive format as small tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# fixed values: the format's magic number, record sizes and code parameters
MAGIC = bytes.fromhex("FEDCBA98")
VERSION = 1
HEADER_SIZE, BLOCK_HEADER_SIZE, TRAILER_SIZE, CODEWORD = 32, 64, 64, 255
ECC_LEVELS = [("none", 0, None, None), ("standard", 1, 239, 16), ("paranoid", 2, 223, 32), ("extreme", 3, 191, 64)]
PREFILTERS = ["none", "x86", "arm", "arm_thumb", "arm64", "sparc", "powerpc", "ia64", "riscv"]
RS_CODES = [("standard", 255, 239), ("paranoid", 255, 223), ("extreme", 255, 191), ("record", 64, 40), ("header", 32, 10)]
BLOCK_EXPONENTS, DICT_EXPONENTS = (16, 62), (16, 31)
SINGLE_BLOCK = 62
DICT_LIMIT = 0xFFFFFFF0
# fixed values: nice length and search depth of presets 0 to 9 (depth 0: chosen by the match finder)
_NICE = (128, 128, 273, 273, 16, 32, 64, 64, 64, 64)
_DEPTH = (4, 8, 24, 48, 0, 0, 0, 0, 0, 0)


@dataclass(frozen=True)
class Options:
    """How to pack: an immutable record; ``with_`` gives a changed copy with values clamped."""

    ecc: int = 0
    prefilter: int = 0
    block_exp: int = SINGLE_BLOCK
    lc: int = 3
    lp: int = 0
    pb: int = 2
    dict_exp: int = 26
    fast: bool = False
    nice: int = 64
    depth: int = 0

    def with_(self, **values) -> Options:
        bounds = {"lc": (0, 8), "lp": (0, 4), "pb": (0, 4), "dict_exp": DICT_EXPONENTS, "block_exp": BLOCK_EXPONENTS, "ecc": (0, 3), "prefilter": (0, 8)}
        clamped = {k: max(bounds[k][0], min(bounds[k][1], v)) if k in bounds else v for k, v in values.items()}
        return Options(**{**self.__dict__, **clamped})


def preset(level: int) -> Options:
    """Options of preset 0 to 9; higher levels count as 9."""
    n = max(0, min(level, 9))
    return Options(block_exp=19 + n, dict_exp=19 + n, fast=n < 4, nice=_NICE[n], depth=_DEPTH[n])


def auto_depth(options: Options) -> int:
    """The search depth that depth 0 stands for: of hash chains (fast) or binary trees."""
    if options.depth:
        return options.depth
    return 4 + options.nice // 4 if options.fast else 16 + options.nice // 2


def ecc_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ECC_LEVELS, "level string, bits int, data_bytes int, parity_bytes int")


def prefilter_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PREFILTERS)), "code int, name string")


def preset_table(spark: SparkSession) -> DataFrame:
    rows = []
    for n in range(10):
        o = preset(n)
        rows.append((n, "fast" if o.fast else "normal", "hc4" if o.fast else "bt4", o.dict_exp, o.block_exp, o.lc, o.lp, o.pb, o.nice, o.depth, auto_depth(o)))
    return spark.createDataFrame(rows, "preset int, mode string, finder string, dict_exp int, block_exp int, lc int, lp int, pb int, nice int, depth int, real_depth int")


def rs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, k, n - k, (n - k) // 2) for c, n, k in RS_CODES], "code string, n int, k int, parity int, t int")
