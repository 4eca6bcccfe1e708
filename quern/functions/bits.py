"""Bit functions on 32-bit words held in bigint columns: field decode, immediates, arithmetic, branches, memory lanes.

Every result is masked to 32 bits, so nothing overflows under ANSI rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def word(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def signed(c: Column) -> Column:
    """A 32-bit word as a number with sign."""
    return word(c) - F.when(word(c) >= 2**31, F.lit(2**32)).otherwise(F.lit(0))


def bits(w: Column, high: int, low: int) -> Column:
    return F.shiftright(word(w), low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1))


def extend(c: Column, n: int) -> Column:
    """n bits with sign, as a 32-bit word."""
    return word(c.bitwiseXOR(F.lit(1 << (n - 1))) - F.lit(1 << (n - 1)))


def to_binary(c: Column, width: int | Column) -> Column:
    """A fixed width of binary digits; a wider value keeps all of its own."""
    b = F.bin(c)
    return F.lpad(b, F.greatest(F.length(b), width if isinstance(width, Column) else F.lit(width)), F.lit("0"))


def min_bits(n: Column) -> Column:
    """Bits that tell n values apart, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int"))


def source_a(c: Column) -> Column:
    """Code of the first operand's source: rs1 00, pc 01, zero 10; others 00."""
    return F.when(c == "pc", "01").when(c == "zero", "10").otherwise("00")


def fields(w: Column) -> dict[str, Column]:
    return {"opcode": to_binary(bits(w, 6, 0), 7), "funct3": to_binary(bits(w, 14, 12), 3), "funct7b5": bits(w, 30, 30).cast("int")}


def immediate(w: Column, form: str) -> Column:
    """The immediate of a word in format I, S, B, U or J, as a 32-bit word."""
    up = lambda c, n: F.shiftleft(c, n)
    if form == "I":
        return extend(bits(w, 31, 20), 12)
    if form == "S":
        return extend(up(bits(w, 31, 25), 5) + bits(w, 11, 7), 12)
    if form == "B":
        return extend(up(bits(w, 31, 31), 12) + up(bits(w, 7, 7), 11) + up(bits(w, 30, 25), 5) + up(bits(w, 11, 8), 1), 13)
    if form == "U":
        return up(bits(w, 31, 12), 12)
    if form == "J":
        return extend(up(bits(w, 31, 31), 20) + up(bits(w, 19, 12), 12) + up(bits(w, 20, 20), 11) + up(bits(w, 30, 21), 1), 21)
    raise ValueError(f"no immediate of format {form}")


def alu(op: Column, a: Column, b: Column) -> Column:
    """ADD SUB AND OR XOR SLL SRL SRA SLT SLTU modulo 2^32; shifts take the low five bits; SLT compares with sign."""
    a, b = word(a), word(b)
    n = b.bitwiseAND(F.lit(31)).cast("int")
    by = lambda f, x: F.call_function(f, x, n)
    return (
        F.when(op == "ADD", word(a + b)).when(op == "SUB", word(a - b)).when(op == "AND", a.bitwiseAND(b)).when(op == "OR", a.bitwiseOR(b)).when(op == "XOR", a.bitwiseXOR(b))
        .when(op == "SLL", word(by("shiftleft", a))).when(op == "SRL", by("shiftright", a)).when(op == "SRA", word(by("shiftright", signed(a))))
        .when(op == "SLT", (signed(a) < signed(b)).cast("bigint")).when(op == "SLTU", (a < b).cast("bigint"))
    )


def branch_taken(funct3: Column, a: Column, b: Column) -> Column:
    """000 equal, 001 not, 100 less, 101 not less (with sign), 110 less, 111 not less (without); others false."""
    return (
        F.when(funct3 == "000", word(a) == word(b)).when(funct3 == "001", word(a) != word(b)).when(funct3 == "100", signed(a) < signed(b)).when(funct3 == "101", signed(a) >= signed(b))
        .when(funct3 == "110", word(a) < word(b)).when(funct3 == "111", word(a) >= word(b)).otherwise(False)
    )


def lanes(addr: Column, size: Column, data: Column, unsigned: Column) -> dict[str, Column]:
    """Memory lanes of an access of size 0 byte, 1 half, 2 word: the word's address, the byte strobe, data shifted into
    its lane, and data read back out of it, extended."""
    off = addr.bitwiseAND(F.lit(3))
    off = F.when(size == 2, F.lit(0)).when(size == 1, off.bitwiseAND(F.lit(2))).otherwise(off).cast("int")
    sh = lambda f, x, n: F.call_function(f, x, n.cast("int"))
    full = F.when(size == 0, F.lit(0xFF)).when(size == 1, F.lit(0xFFFF)).otherwise(F.lit(MASK))
    got = sh("shiftright", word(data), off * 8).bitwiseAND(full)
    top = F.when(size == 0, F.lit(0x80)).when(size == 1, F.lit(0x8000)).otherwise(F.lit(0x80000000))
    return {
        "word_addr": word(addr).bitwiseAND(F.lit(0xFFFFFFFC)),
        "strobe": sh("shiftleft", F.when(size == 0, F.lit(1)).when(size == 1, F.lit(3)).otherwise(F.lit(15)), off).cast("int"),
        "stored": word(sh("shiftleft", word(data).bitwiseAND(full), off * 8)),
        "loaded": F.when(unsigned, got).otherwise(word(got.bitwiseXOR(top) - top)),
    }


def next_pc(pc: Column, imm: Column, rs1: Column, taken: Column, jump: Column, register_jump: Column) -> Column:
    """A jump through a register clears the lowest bit; jumps and taken branches add the immediate; else four on."""
    return F.when(jump & register_jump, word(rs1 + imm).bitwiseAND(F.lit(0xFFFFFFFE))).when(jump | taken, word(pc + imm)).otherwise(word(pc + 4))


def hex_word(c: Column) -> Column:
    """The low 32 bits of a hexadecimal literal of up to 64 bits, or of a decimal one with sign."""
    h = F.regexp_extract(c, r"^0[xX]([0-9a-fA-F]+)", 1)
    return F.when(h != "", F.conv(F.right(h, F.lit(8)), 16, 10).cast("bigint")).otherwise(word(F.try_to_number(c, F.lit("S999999999999")).cast("bigint")))
