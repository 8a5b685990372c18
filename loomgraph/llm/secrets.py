"""Secret scans (operator 7), in SQL functions only.

Strong patterns (assignments, access identifiers, long hex runs) are reported as
they are. Weak parts are reported only where the parts of a credential co-occur:
within a scope of ``SCOPE`` code points,
  bare      a long token of mixed letters and digits, if an identifier is near;
  ident     a temporary or role identifier, if a secret part is near;
  endpoint  a URL host, if both an identifier and a secret part are near.
Running maxima of ends and minima of starts over the sorted parts join each
part's interval with the nearest ones of each role on both sides; a document's
parts never leave its row, so nothing is shuffled and no pairs are made,
whatever the number of documents or of parts in one.

Cases: a null text is an empty text and has no spans; weak parts inside a strong
span are not reported again; a span may touch any other; one row comes out for
each that goes in; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import FAR, NONE, each, later_min, let, listed, matches, named, only, quoted, replaced, running_max, zipped

SCOPE = 400
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
IDENT = r"(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}"
BARE = r"(?:(?<![A-Za-z0-9+/_-])|\G)[A-Za-z0-9+/_-]{32,}+"
ENDPOINT = r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]++(?::[0-9]++)?"
KINDS = ("assign", "access", "hex", "bare", "ident", "endpoint")


def strong(text: str) -> dict[str, str]:
    """The base spans by kind. Only texts with a character that a kind needs are matched."""
    assign = only(matches(text, ASSIGN, 2), lambda x: f"length({x}.v) >= 12")
    access = only(matches(text, ACCESS), lambda x: f"length({x}.v) >= 18")
    return {
        "assign": f"if(contains({text}, '=') or contains({text}, ':'), {assign}, {NONE})",
        "access": f"if(contains({text}, 'AKIA'), {access}, {NONE})",
        "hex": matches(text, HEX),
    }


def weak(text: str, any_identifier: str) -> dict[str, str]:
    """Candidates that count only together."""
    mixed = only(matches(text, BARE), lambda x: f"{x}.v rlike '[0-9]' and {x}.v rlike '[A-Za-z]'")
    temporary = "(" + " or ".join(f"contains({text}, '{w}')" for w in ("ASIA", "AROA", "AIDA")) + ")"
    return {
        "bare": f"if({any_identifier} or {temporary}, {mixed}, {NONE})",
        "ident": f"if({temporary}, {matches(text, IDENT)}, {NONE})",
        "endpoint": f"if(({any_identifier} or {temporary}) and contains({text}, '://'), {matches(text, ENDPOINT)}, {NONE})",
    }


def linked(parts: str, scope: int = SCOPE) -> str:
    """Of sorted parts (see spans.named), the strong ones, and the weak ones whose complements lie within ``scope``."""
    roles = {"a": ("access", "ident"), "k": ("assign", "hex", "bare"), "b": ("assign", "access", "hex")}
    one_of = lambda x, role: f"{x}.kind in ({', '.join(map(quoted, roles[role]))})"

    def swept(all_: str) -> str:
        ends = lambda role: running_max(each(all_, lambda x: f"if({one_of(x, role)}, {x}.e, {-FAR})"))
        starts = lambda role: later_min(each(all_, lambda x: f"if({one_of(x, role)}, {x}.s, {FAR})"))

        def stays(y: str) -> str:
            near = lambda role: f"({y}.x.s - {y}.{role} <= {scope} or {y}.next_{role} - {y}.x.e <= {scope})"
            together = f"case {y}.x.kind when 'bare' then {near('a')} when 'ident' then {near('k')} else {near('a')} and {near('k')} end"
            return f"{one_of(f'{y}.x', 'b')} or ({y}.b < {y}.x.e and {together})"

        seen = zipped(x=all_, a=ends("a"), k=ends("k"), b=ends("b"), next_a=starts("a"), next_k=starts("k"))
        return each(only(seen, stays), lambda y: f"{y}.x")

    return let(parts, swept)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans[, kept]) of each row: base and spans are arrays sorted by start, then kind."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] * bool(keep)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *kept)
    kept = ["kept"] * bool(keep)
    rows = rows.selectExpr("doc_id", "text", *kept, *[f"{c} as {k}" for k, c in strong("text").items()])
    rows = rows.selectExpr("doc_id", *kept, "assign", "access", "hex", *[f"{c} as {k}" for k, c in weak("text", "size(access) > 0").items()])
    base = f"array_sort(concat({', '.join(named(k, k, i) for i, k in enumerate(KINDS[:3]))})) as base"
    more = f"concat({', '.join(named(k, k, i + 3) for i, k in enumerate(KINDS[3:]))}) as more"
    rows = rows.selectExpr("doc_id", *kept, *[f"cast(size({k}) as long) as n_{k}" for k in KINDS[:3]], base, more)
    spans = f"if(size(more) = 0, base, {linked('array_sort(concat(base, more))', scope)}) as spans"
    return rows.selectExpr("doc_id", *kept, *[f"n_{k}" for k in KINDS[:3]], "base", spans)


def report(df: DataFrame, **columns) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) with digests and text in place of arrays."""
    return scan(df, **columns).selectExpr("doc_id", "n_assign", "n_access", "n_hex", f"sha2({listed('base')}, 256) as base_sha256", f"{listed('spans')} as spans")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``df`` with each stretch of its text that spans cover replaced by ``[kind]`` (the kind that begins first). A null text stays null."""
    names = tuple(df.columns)
    got = scan(df, id_col, text_col, scope, keep=names).select("kept", "spans", F.col("kept")[text_col].alias("text"))
    got = got.selectExpr("kept", f"{replaced('text', 'spans')} as text")
    return got.select(*[F.col("text").alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in names])
