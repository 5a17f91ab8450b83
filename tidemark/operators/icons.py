"""F-13: icon containers, parsed from their bytes by expressions: no worker sees the content.

An icon has a directory of 16-byte records after six bytes of header. All its images must be valid on their own, and lie
one after the other from the directory's end to the file's end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# PNG's first bytes with its header chunk, its last chunk, and the sizes of bitmap headers.
PNG, PNG_HEADER, PNG_END = "89504E470D0A1A0A", "0000000D49484452", "0000000049454E44AE426082"
BITMAP_HEADERS = (40, 108, 124)
MOST_IMAGES = 256


def number(hexadecimal: str, at: int, n: int, big: bool = False) -> str:
    """The unsigned integer of n bytes from byte `at` of hexadecimal text."""
    order = range(at, at + n) if big else range(at + n - 1, at - 1, -1)
    return f"cast(conv(concat({', '.join(f'substr({hexadecimal}, {2 * k + 1}, 2)' for k in order)}), 16, 10) as bigint)"


def bytes_of(content: str, start: str, n: str) -> str:
    """n bytes from a 0-based place, as hexadecimal text."""
    return f"hex(substring({content}, cast({start} + 1 as int), cast({n} as int)))"


def image(content: str) -> str:
    """Whether record e's range is a PNG image of its size, or a whole uncompressed bitmap with its mask."""
    bits, colors = number("e.head", 14, 2), number("e.head", 32, 4)
    shifts = f"cast(pow(2, {bits}) as bigint)"
    palette = f"case when {bits} <= 8 then case when {colors} = 0 then {shifts} else {colors} end * 4 else 0 end"
    rows = lambda per_row: f"cast(floor(({per_row} + 31) / 32) as bigint) * 4 * e.height"
    png = (
        f"e.size >= 33 and substr(e.head, 17, 16) = '{PNG_HEADER}' and {number('e.head', 16, 4, True)} = e.width and {number('e.head', 20, 4, True)} = e.height"
        f" and {bytes_of(content, 'e.start + e.size - 12', '12')} = '{PNG_END}'"
    )
    bitmap = (
        f"e.size >= 40 and {number('e.head', 0, 4)} in {BITMAP_HEADERS} and e.size >= {number('e.head', 0, 4)} and {number('e.head', 4, 4)} = e.width and {number('e.head', 8, 4)} = e.height * 2"
        f" and substr(e.head, 25, 4) = '0100' and {bits} in (1, 4, 8, 16, 24, 32) and substr(e.head, 33, 8) = '00000000' and {colors} <= case when {bits} <= 8 then {shifts} else 0 end"
        f" and e.size = {number('e.head', 0, 4)} + {palette} + {rows(f'e.width * {bits}')} + {rows('e.width')}"
    )
    return f"case when substr(e.head, 1, 16) = '{PNG}' then {png} else {bitmap} end"


def icon(content: str = "content") -> Column:
    """Whether a BINARY column is a complete icon container; false for null."""
    length, first = f"cast(octet_length({content}) as bigint)", f"hex(substring({content}, 1, 6))"
    count = number("d.first", 4, 2)
    record = bytes_of(content, "6 + 16 * i", "16")
    records = f"""transform(transform(sequence(0, cast({count} as int) - 1), i -> {record}), r -> named_struct('spare', substr(r, 7, 2), 'size', {number("r", 8, 4)}, 'start', {number("r", 12, 4)},
      'width', case when {number("r", 0, 1)} = 0 then 256 else {number("r", 0, 1)} end, 'height', case when {number("r", 1, 1)} = 0 then 256 else {number("r", 1, 1)} end))"""
    inside = f"e.spare = '00' and e.size > 0 and e.start >= 6 + 16 * {count} and e.start + e.size <= d.n"
    headed = f"""transform({records}, e -> named_struct('ok', {inside}, 'start', e.start, 'size', e.size, 'width', e.width, 'height', e.height,
      'head', case when {inside} then {bytes_of(content, 'e.start', 'least(e.size, 40)')} end))"""
    sound = f"transform({headed}, e -> named_struct('start', e.start, 'end', e.start + e.size, 'ok', e.ok and {image(content)}))"
    joined = f"aggregate(array_sort({sound}), cast(6 + 16 * {count} as bigint), (at, e) -> case when e.ok and e.start = at then e.end else cast(-1 as bigint) end)"
    whole = f"case when d.n < 22 or not startswith(d.first, '00000100') or {count} not between 1 and {MOST_IMAGES} or 6 + 16 * {count} > d.n then false else {joined} = d.n end"
    return F.expr(f"coalesce(element_at(transform(array(named_struct('n', {length}, 'first', {first})), d -> {whole}), 1), false)")
