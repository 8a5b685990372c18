"""Spans of pattern matches, in SQL functions only: shared by the secret and PII scans.

Functions here take and give SQL expressions as text. A span is
struct<s: int, e: int, v: string>, code point offsets with exclusive end. Texts
are split and matched by the same pattern, so pieces and matches alternate and
their running lengths are the offsets. Whatever runs over the spans of a text
goes by ``running``, whose work grows little more than with their number.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

SPAN = "array<struct<s:int,e:int,v:string>>"
NONE = f"cast(array() as {SPAN})"
#: Longer arrays are folded by chunks of so many elements, and chunks by chunks of chunks.
CHUNK = 64
FAR = 1 << 30
_names = count()


def name() -> str:
    """A variable name not used before."""
    return f"x{next(_names)}"


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def each(array: str, body: Callable[[str], str]) -> str:
    x = name()
    return f"transform({array}, {x} -> {body(x)})"


def only(array: str, test: Callable[[str], str]) -> str:
    x = name()
    return f"filter({array}, {x} -> {test(x)})"


def zipped(**arrays: str) -> str:
    """Structs of the elements of several arrays, by name."""
    (first, out), *more = arrays.items()
    out, seen = each(out, lambda x: f"struct({x} as {first})"), [first]
    for key, array in more:
        a, b = name(), name()
        out = f"zip_with({out}, {array}, ({a}, {b}) -> struct({', '.join(f'{a}.{k} as {k}' for k in seen)}, {b} as {key}))"
        seen.append(key)
    return out


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of ``value``, which is evaluated once."""
    return f"element_at({each(f'array({value})', body)}, 1)"


def running(values: str, op: Callable[[str, str], str], zero: int, levels: int = 2) -> str:
    """For each of an array of ints, ``op`` (associative, with ``zero`` as neutral) over all before it."""

    def simple(a: str) -> str:
        acc, x, end = name(), name(), name()
        return f"aggregate({a}, struct({zero} as at, cast(array() as array<int>) as out), ({acc}, {x}) -> struct({op(f'{acc}.at', x)} as at, concat({acc}.out, array({acc}.at)) as out), {end} -> {end}.out)"

    def deep(a: str, level: int) -> str:
        if not level:
            return simple(a)

        def by_chunk(chunks: str) -> str:
            acc, x, c, b = name(), name(), name(), name()
            totals = each(chunks, lambda part: f"aggregate({part}, {zero}, ({acc}, {x}) -> {op(acc, x)})")
            before = let(totals, lambda t: deep(t, level - 1))
            return f"flatten(zip_with({chunks}, {before}, ({c}, {b}) -> {each(simple(c), lambda v: op(b, v))}))"

        return let(each(f"sequence(0, cast(floor(size({a}) / {CHUNK}) as int))", lambda k: f"slice({a}, {k} * {CHUNK} + 1, {CHUNK})"), by_chunk)

    return let(values, lambda a: deep(a, levels))


def running_max(values: str, least: int = -FAR) -> str:
    return running(values, lambda a, b: f"greatest({a}, {b})", least)


def later_min(values: str) -> str:
    """For each of an array of ints, the least of all after it."""
    return each(f"reverse({running_max(each(f'reverse({values})', lambda x: f'-{x}'))})", lambda x: f"-{x}")


def matches(text: str, pattern: str, group: int = 0) -> str:
    """All leftmost non-overlapping matches of a pattern that matches no empty text; v is what ``group`` matched."""
    p = quoted(pattern)

    def spans(found: str, pieces: str, before: str) -> str:
        values = f"regexp_extract_all({text}, {p}, {group})" if group else found
        some = only(zipped(m=found, v=values, p=pieces, b=before), lambda x: f"{x}.m is not null")  # there is a piece after the last match
        return each(some, lambda x: f"struct({x}.b + {x}.p as s, {x}.b + {x}.p + length({x}.m) as e, {x}.v as v)")

    def placed(found: str) -> str:
        a, m = name(), name()
        sizes = lambda pieces: f"zip_with({pieces}, {found}, ({a}, {m}) -> {a} + coalesce(length({m}), 0))"
        sized = let(each(f"split({text}, {p}, -1)", lambda x: f"length({x})"), lambda pieces: let(running(sizes(pieces), lambda i, j: f"{i} + {j}", 0), lambda before: spans(found, pieces, before)))
        return f"if(size({found}) = 0, {NONE}, {sized})"

    return let(f"regexp_extract_all({text}, {p}, 0)", placed)


def placed_near(text: str, spans: str, around: int, body: Callable[[str, str], str]) -> str:
    """struct(x, f) of each of sorted spans: the span, and ``body`` of a stretch of the text that holds it and ``around``
    code points on either side, and of the span within that stretch. Stretches are cut once for each chunk of spans."""

    def chunk(c: str) -> str:
        start = f"greatest(0, element_at({c}, 1).s - {around})"
        part = lambda at: f"substring({text}, {at} + 1, array_max({each(c, lambda x: f'{x}.e')}) + {around} - {at})"
        moved = lambda x, at: f"struct({x}.s - {at} as s, {x}.e - {at} as e, {x}.v as v)"
        one = lambda x, at, t: f"struct({x} as x, {let(moved(x, at), lambda y: body(t, y))} as f)"
        return let(start, lambda at: let(part(at), lambda t: each(c, lambda x: one(x, at, t))))

    chunks = lambda all_: only(each(f"sequence(0, cast(floor(size({all_}) / {CHUNK}) as int))", lambda k: f"slice({all_}, {k} * {CHUNK} + 1, {CHUNK})"), lambda c: f"size({c}) > 0")
    return let(spans, lambda all_: f"flatten({each(chunks(all_), chunk)})")


def apart(spans: str, others: str) -> str:
    """Those of ``spans`` that overlap none of ``others``, by start."""
    marked = lambda a, rank: each(a, lambda x: f"struct({x}.s as s, {rank} as rank, {x}.e as e, {x}.v as v)")

    def kept(both: str) -> str:
        before = running_max(each(both, lambda x: f"if({x}.rank = 0, {x}.e, {-FAR})"))
        after = later_min(each(both, lambda x: f"if({x}.rank = 0, {x}.s, {FAR})"))
        free = only(zipped(x=both, b=before, a=after), lambda y: f"{y}.x.rank = 1 and {y}.b <= {y}.x.s and {y}.a >= {y}.x.e")
        return each(free, lambda y: f"struct({y}.x.s as s, {y}.x.e as e, {y}.x.v as v)")

    return f"if(size({spans}) = 0 or size({others}) = 0, {spans}, {let(f'array_sort(concat({marked(others, 0)}, {marked(spans, 1)}))', kept)})"


def named(spans: str, kind: str, rank: int) -> str:
    """Spans as struct<s, rank, kind, e, v>: sorting puts them by start, then rank."""
    return each(spans, lambda x: f"struct({x}.s as s, {rank} as rank, '{kind}' as kind, {x}.e as e, {x}.v as v)")


def listed(spans: str) -> str:
    """kind:start:end, comma-joined."""
    return f"array_join({each(spans, lambda x: f'''concat_ws(':', {x}.kind, cast({x}.s as string), cast({x}.e as string))''')}, ',')"


def replaced(text: str, spans: str) -> str:
    """``text`` with each stretch that sorted named spans cover replaced by ``[kind]``, the kind that begins first.

    Texts of many spans are cut into blocks, so that no piece is looked for from the start of a long text."""

    def gaps(ends: str) -> str:
        free = only(zipped(x=spans, at=ends), lambda y: f"{y}.x.s >= {y}.at")
        stretches = each(free, lambda y: f"struct({y}.at as a, {y}.x.s as b, concat('[', {y}.x.kind, ']') as mark)")
        last = f"struct(array_max({each(spans, lambda x: f'{x}.e')}) as a, {FAR} as b, '' as mark)"
        return f"concat({stretches}, array({last}))"

    def block(all_: str, n: str, k: str) -> str:
        mine = only(all_, lambda g: f"{g}.a < ({k} + 1) * {n} and {g}.b >= {k} * {n}")

        def piece(part: str, g: str) -> str:
            a = f"(greatest({g}.a, {k} * {n}) - {k} * {n})"
            plain = f"substring({part}, {a} + 1, greatest(0, least({g}.b, ({k} + 1) * {n}) - {k} * {n} - {a}))"
            return f"concat({plain}, if({g}.b < ({k} + 1) * {n}, {g}.mark, ''))"

        return let(f"substring({text}, {k} * {n} + 1, {n})", lambda part: f"array_join({each(mine, lambda g: piece(part, g))}, '')")

    size = f"if(size({spans}) <= {CHUNK}, length({text}) + 1, 32768)"
    blocks = lambda n: f"sequence(0, cast(floor(length({text}) / {n}) as int))"
    cut = let(gaps(running_max(each(spans, lambda x: f"{x}.e"), 0)), lambda all_: let(size, lambda n: f"array_join({each(blocks(n), lambda k: block(all_, n, k))}, '')"))
    return f"if(size({spans}) = 0, {text}, {cut})"
