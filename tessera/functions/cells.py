"""Cell index algebra as native expressions.

A cell is a signed 64-bit integer: bits 59-62 hold the mode (1), 52-55 the resolution, 45-51 the base
cell, and digit i (1-15) bits 3*(15-i) and up; digits finer than the resolution are 7.  Everything here
is bit arithmetic that stays inside generated code; the same text is registered as SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_RESOLUTION = 15
#: Base cells that are pentagons.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
CELL_COLUMN = "h3index"

_DIGITS = (1 << 45) - 1
_RES = 15 << 52


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _col(cell: Column | str) -> Column:
    return F.col(cell) if isinstance(cell, str) else cell


def _shift(value: Column | int, bits: Column | int) -> Column:
    value = F.lit(value).cast("long") if isinstance(value, int) else value
    return F.call_function("shiftleft", value, F.lit(bits).cast("int") if isinstance(bits, int) else bits.cast("int"))


def resolution(cell: Column | str) -> Column:
    return F.shiftright(_col(cell), 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell(cell: Column | str) -> Column:
    return F.shiftright(_col(cell), 45).bitwiseAND(F.lit(127)).cast("int")


def to_parent(cell: Column | str, res: int | Column) -> Column:
    """The ancestor at ``res`` (the cell itself at its own resolution); finer digits are blanked with 7s."""
    h = _col(cell)
    if isinstance(res, int):
        return h.bitwiseAND(F.lit(_signed(~_RES))).bitwiseOR(F.lit((res << 52) | ((1 << 3 * (15 - res)) - 1)))
    blank = _shift(1, (F.lit(15) - res) * 3) - 1
    return h.bitwiseAND(F.lit(_signed(~_RES))).bitwiseOR(_shift(res.cast("long"), 52)).bitwiseOR(blank)


def _own_digits(h: Column) -> Column:
    """The digits down to the cell's resolution, as a number."""
    return F.call_function("shiftright", h.bitwiseAND(F.lit(_DIGITS)), (F.lit(15) - resolution(h)) * 3)


def is_pentagon(cell: Column | str) -> Column:
    h = _col(cell)
    return base_cell(h).isin(*PENTAGONS) & (_own_digits(h) == 0)


def center_child(cell: Column | str, res: int) -> Column:
    h = _col(cell)
    used = _shift(1, (F.lit(15) - resolution(h)) * 3) - F.lit(1 << 3 * (15 - res)).cast("long")
    return h.bitwiseAND(F.lit(_signed(~_RES))).bitwiseAND(F.bitwise_not(used)).bitwiseOR(F.lit(res << 52))


def _powers_of_7(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(7**i).cast("long") for i in range(MAX_RESOLUTION + 1)]), d + 1)


def child_count(cell: Column | str, res: int | Column) -> Column:
    """Number of descendants at ``res``: 7^d, or 1 + 5 (7^d - 1) / 6 below a pentagon."""
    h = _col(cell)
    r = F.lit(res) if isinstance(res, int) else res
    n = _powers_of_7(r - resolution(h))
    return F.when(is_pentagon(h), F.lit(1).cast("long") + F.expr("5L") * F.call_function("div", n - 1, F.lit(6).cast("long"))).otherwise(n)


def children(cell: Column | str, res: int) -> Column:
    """Array of the descendants at ``res``; below a pentagon those whose first non-zero digit is 1 do not exist."""
    h = _col(cell)
    start, n = center_child(h, res), _powers_of_7(F.lit(res) - resolution(h))
    five = is_pentagon(h)

    def child(j: Column) -> Column:
        out = start
        for m in range(res):
            digit = F.call_function("div", j, F.lit(7**m).cast("long")) % 7
            out = out + _shift(digit, 3 * (15 - res + m))
        return out

    gone = lambda j: F.lit(False)
    for m in range(res):
        gone = (lambda before, m: lambda j: before(j) | ((j >= 7**m) & (j < 2 * 7**m)))(gone, m)
    numbers = F.sequence(F.lit(0).cast("long"), n - 1)
    numbers = F.when(five, F.filter(numbers, lambda j: ~gone(j))).otherwise(numbers)
    return F.when(resolution(h) <= res, F.transform(numbers, child))


def expand(df, res: int, cell: str = CELL_COLUMN):
    """``df`` with each row repeated for the descendants of its cell at ``res``; three resolutions a step, so no row
    ever holds more than 343 cells.  Rows that are finer already stay as they are."""
    for step in range(3, res + 3, 3):
        step = min(step, res)
        df = df.withColumn(cell, F.explode(F.coalesce(children(cell, step), F.array(cell))))
    return df


def is_valid(cell: Column | str) -> Column:
    """Mode 1, no reserved bits, base cell up to 121, digits 0-6 down to the resolution and 7 below, no deleted pentagon branch."""
    h = _col(cell)
    r = resolution(h)
    ok = (F.shiftright(h, 56) == 8) & (base_cell(h) <= 121)
    deleted = F.lit(False)
    for i in range(1, MAX_RESOLUTION + 1):
        shift = 3 * (15 - i)
        digit = F.shiftright(h, shift).bitwiseAND(F.lit(7))
        ok = ok & ((digit == 7) == (r < i))
        deleted = deleted | ((F.shiftright(h.bitwiseAND(F.lit(_DIGITS)), shift) == 1) & (r >= i))  # the first non-zero digit is 1
    return F.coalesce(ok & ~(base_cell(h).isin(*PENTAGONS) & deleted), F.lit(False))


def change_resolution(df, res: int, cell: str = CELL_COLUMN, keys: list[str] | None = None):
    """Distinct cells of ``df`` moved to ``res``: ancestors of finer ones, descendants of coarser ones; with ``keys``,
    distinct beside these columns, which come along."""
    keys = keys or []
    up = df.where(resolution(cell) >= res).select(*keys, to_parent(cell, res).alias(cell))
    down = expand(df.where(resolution(cell) < res).select(*keys, cell), res, cell)
    return up.unionByName(down).distinct()


# --- plain integers, for arguments the driver holds -----------------------------


def py_resolution(h: int) -> int:
    return (h >> 52) & 15


def py_base_cell(h: int) -> int:
    return (h >> 45) & 127


def py_to_parent(h: int, res: int) -> int:
    return (h & ~_RES) | (res << 52) | ((1 << 3 * (15 - res)) - 1)


def py_is_valid(h: int) -> bool:
    if h >> 56 != 8 or py_base_cell(h) > 121:
        return False
    r, lead = py_resolution(h), 0
    for i in range(1, 16):
        d = (h >> 3 * (15 - i)) & 7
        if (d == 7) != (i > r):
            return False
        lead = lead or (d if i <= r else 0)
    return not (py_base_cell(h) in PENTAGONS and lead == 1)


def py_children(h: int, res: int) -> list[int]:
    r = py_resolution(h)
    if r == res:
        return [h]
    five = py_base_cell(h) in PENTAGONS and (h & _DIGITS) >> 3 * (15 - r) == 0
    out = []
    for d in range(7):
        if five and d == 1:
            continue
        low = (h & ~_RES & ~(7 << 3 * (14 - r))) | ((r + 1) << 52) | (d << 3 * (14 - r))
        out += py_children(low, res)
    return out


# --- SQL ------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Temporary SQL functions with the same meaning; they are SQL text too, so Catalyst inlines them."""
    own = "shiftright(h & 35184372088831L, (15 - (shiftright(h, 52) & 15)) * 3)"
    pentagons = ", ".join(map(str, PENTAGONS))
    seven = "element_at(array(" + ", ".join(f"{7**i}L" for i in range(16)) + "), d + 1)"
    digits = " + ".join(f"shiftleft((j div {7**m}L) % 7, 3 * (15 - r + {m}))" for m in range(15))
    gone = " OR ".join(f"(j >= {7**m}L AND j < {2 * 7**m}L)" for m in range(15))
    keep = _signed(~_RES)
    bodies = {
        "h3_resolution(h BIGINT) RETURNS INT": "CAST(shiftright(h, 52) & 15 AS INT)",
        "h3_base_cell(h BIGINT) RETURNS INT": "CAST(shiftright(h, 45) & 127 AS INT)",
        "h3_to_parent(h BIGINT, r INT) RETURNS BIGINT": f"(h & {keep}L) | shiftleft(CAST(r AS BIGINT), 52) | (shiftleft(1L, (15 - r) * 3) - 1)",
        "h3_is_pentagon(h BIGINT) RETURNS BOOLEAN": f"CAST(shiftright(h, 45) & 127 AS INT) IN ({pentagons}) AND {own} = 0",
        "h3_power_of_7(d INT) RETURNS BIGINT": seven,
        "h3_child_count(h BIGINT, r INT) RETURNS BIGINT": "IF(h3_is_pentagon(h), 1 + 5 * ((h3_power_of_7(r - h3_resolution(h)) - 1) div 6), h3_power_of_7(r - h3_resolution(h)))",
        "h3_center_child(h BIGINT, r INT) RETURNS BIGINT": f"(h & {keep}L & ~(shiftleft(1L, (15 - h3_resolution(h)) * 3) - shiftleft(1L, (15 - r) * 3))) | shiftleft(CAST(r AS BIGINT), 52)",
        "h3_to_children(h BIGINT, r INT) RETURNS ARRAY<BIGINT>": f"transform(filter(sequence(0L, h3_power_of_7(r - h3_resolution(h)) - 1), j -> NOT (h3_is_pentagon(h) AND ({gone}))), j -> h3_center_child(h, r) + {digits})",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
