"""Predicates over instruction mnemonics and the flags register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the flags register.
FLAG_BITS = {"C": 0x1, "P": 0x4, "A": 0x10, "Z": 0x40, "S": 0x80, "T": 0x100, "I": 0x200, "D": 0x400, "O": 0x800}


def ends_block(mnemonic: Column) -> Column:
    """Calls, returns and jumps end a basic block."""
    m = F.lower(mnemonic)
    return m.startswith("j") | m.isin("call", "ret")


def is_branch(mnemonic: Column) -> Column:
    m = F.lower(mnemonic)
    return m.startswith("j") & (m != "jmp")


def is_guaranteed_jump(mnemonic: Column) -> Column:
    return F.lower(mnemonic).isin("jmp", "call", "ret")


def would_branch(mnemonic: Column, flags: Column, strict: bool = True) -> Column:
    """Whether a conditional jump is taken under these flags.

    strict leaves jnb/jae/jnc, jle/jng and jg/jnle at false, as the traced tool did; otherwise they follow the processor.
    """
    m = F.lower(mnemonic)
    on = {k: flags.bitwiseAND(F.lit(b)) != 0 for k, b in FLAG_BITS.items()}
    less = on["S"] != on["O"]
    rules: list[tuple[tuple[str, ...], Column]] = [
        (("jo",), on["O"]),
        (("jno",), ~on["O"]),
        (("js",), on["S"]),
        (("jns",), ~on["S"]),
        (("je", "jz"), on["Z"]),
        (("jne", "jnz"), ~on["Z"]),
        (("jb", "jnae", "jc"), on["C"]),
        (("jbe", "jna"), on["C"] | on["Z"]),
        (("ja", "jnbe"), ~on["C"] & ~on["Z"]),
        (("jl", "jnge"), less),
        (("jge", "jnl"), ~less),
        (("jp", "jpe"), on["P"]),
        (("jnp", "jpo"), ~on["P"]),
    ]
    if not strict:
        rules += [(("jnb", "jae", "jnc"), ~on["C"]), (("jle", "jng"), on["Z"] | less), (("jg", "jnle"), ~on["Z"] & ~less)]
    names, test = rules[0]
    return reduce(lambda c, r: c.when(m.isin(*r[0]), r[1]), rules[1:], F.when(m.isin(*names), test)).otherwise(F.lit(False))


def flag_letters(flags: Column) -> Column:
    """Letters of the set flags, in the order of their bits."""
    return F.concat(*[F.when(flags.bitwiseAND(F.lit(b)) != 0, F.lit(k)).otherwise(F.lit("")) for k, b in FLAG_BITS.items()])


def flags_of_letters(letters: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.contains(letters, F.lit(k)), F.lit(b)).otherwise(F.lit(0)) for k, b in FLAG_BITS.items()])
