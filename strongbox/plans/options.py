"""How a command's settings become packing options, in their order of precedence."""

from __future__ import annotations

from ..dims import PREFILTERS, Options, preset

LARGE = 256 << 20


def block_exponent(size: int, count: int) -> int | None:
    """Exponent of the block size with which ``size`` bytes make about ``count`` blocks; None for count 0."""
    if count == 0:
        return None
    each = -(-size // count)
    return 16 if each <= 1 << 16 else min((each - 1).bit_length(), 62)


def resolve(
    level: int = 6,
    size: int | None = None,
    prefilter: int | None = None,
    lc: int | None = None,
    lp: int | None = None,
    pb: int | None = None,
    dict_exp: int | None = None,
    block_exp: int | None = None,
    block_count: int | None = None,
    ecc: int = 1,
) -> Options:
    """Options of a preset, then single settings over it, then the block size, then ECC.

    A block exponent goes before a block count; 0 of either means one block.
    With neither the block is as large as the dictionary, and twice that, up to
    1 GiB, for data of more than 256 MiB.
    """
    given = {k: v for k, v in (("prefilter", prefilter), ("lc", lc), ("lp", lp), ("pb", pb), ("dict_exp", dict_exp)) if v is not None}
    o = preset(level).with_(**given)
    if block_exp is not None:
        exponent = block_exp or 62
    elif block_count is not None and size is not None:
        exponent = block_exponent(size, block_count) or 62
    else:
        exponent = min(o.dict_exp + 1, 30) if size is not None and size > LARGE else o.dict_exp
    return o.with_(block_exp=exponent, ecc=ecc)


def one_prefilter(given: list[str]) -> int:
    """The code of the only prefilter that is asked for, 0 for none; more than one is an error."""
    codes = [PREFILTERS.index(name) for name in given]
    if len(codes) > 1:
        raise ValueError(f"one prefilter at a time, not {', '.join(given)}")
    return codes[0] if codes else 0


def output_of(inputs: list[str], output: str | None) -> str | None:
    """The name given for the output, which only a single input can have."""
    if output is not None and len(inputs) != 1:
        raise ValueError(f"one output for {len(inputs)} inputs")
    return output
