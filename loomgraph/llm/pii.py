"""Personal data (operator 9), in SQL functions only on the data's path.

Base patterns (email, ip, card, phone) are reported as they are. Besides,
generators of high recall propose further spans, which may overlap: long runs of
digits and separators (``number``), two to five short groups of digits
(``grouped``) and spelled-out addresses (``address``). Boosted trees score a
proposal by its format (digits, groups, separators) and context (words and
characters about it); those at or above a calibrated threshold are reported too.

Trees are fitted on the driver. What they are to find is personal data that base
patterns miss, so positives are base spans of a bounded sample of documents with
the sign that gives them away taken off, in their own context: phone numbers
without ``+``, cards with a digit changed, addresses with their ``@`` and last
dot spelled out. What else the sample holds isn't known to be personal or not, so
of its other proposals only those are negatives that are part of a longer token
of letters and digits. To both come planted ones, every pairing of the formats
and contexts below with drawn digits, so that there are always two classes,
whatever the sample holds. The threshold is the least score, at least even odds,
that at most ``FALSE`` of the negatives of a held-out third reach. Scoring is a
sum of CASEs.

Cases: a null text is an empty text and has no spans; proposals that overlap a
base span are dropped, those that overlap each other are judged each by itself;
repeated rows are scanned each by itself; an empty table trains on the planted
alone; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .quality import Trees, fit
from .spans import NONE, apart, each, let, listed, matches, named, only, placed_near, quoted

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?:(?<![0-9])|\G)\(?[0-9][0-9().\x20-]{5,40}[0-9]"
GROUPED = r"(?<![0-9])[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){1,4}(?![0-9])"
ADDRESS = r"(?i)[a-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,64}+(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z0-9-]{1,64}+|\.[a-z0-9-]{1,64}+)++"
BASE = ("email", "ip", "card", "phone")
MORE = ("number", "grouped", "address")
AROUND = 24
WORDS = r"(?i)(call|phone|tel|mobile|fax|contact|card|visa|account|iban|ssn|passport|licen[cs]e)"
NEXT = r"(?i)(order|invoice|version|page|year|total|isbn|figure|chapter)"
TRAIN_DOCS = 2000
TRAIN_SPANS = 3000
TREES = 30
FALSE = 0.01
FEATURES = ("digits", "length", "groups", "spaces", "dashes", "dots", "brackets", "longest", "shortest", "first", "last", "zero_first", "year", "zeros", "luhn", "word_near", "other_word_near", "letter_before", "letter_after")
#: Planted examples: contexts and formats of either class, # for a drawn digit (fixed values).
PLANTED = {
    1: (
        ("call ", "phone: ", "my number is ", "contact me at ", "card ", "", "and then "),
        ("(###) ###-####", "###-###-####", "### ### ####", "0## #######", "0###-###-#####", "0# ## ## ## ##", "00## ### #######", "4### #### #### ####", "5###-####-####-####", "################", "3### ###### #####", "###-##-####", "someone (at) example (dot) org", "a.person [at] mail [dot] example.com"),
    ),
    0: (
        ("order ", "version ", "page ", "in ", "total ", "", "and then "),
        ("20##-##-##", "19##-##-##", "##.##.20##", "##.##.19##", "#.##.###.####", "##.##.##.####", "#######", "20######", "## ### ###", "### ### 000", "# ### 000 000", "## ### ###.##", "#.########", "19##-20## 20##", "20## 20## 20##", "978-#-##-######-#", "15########", "17########", "0000000", "00000000"),
    ),
}
DRAWN = 4


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """Whether the check digit of a string of digits holds."""
    return f"aggregate(transform(regexp_extract_all(reverse({d}), '[0-9]', 0), (c, i) -> cast(c as int) * if(i % 2 = 1, 2, 1)), 0, (t, x) -> t + x - if(x > 9, 9, 0)) % 10 = 0"


def base_spans(text: str) -> dict[str, str]:
    small = lambda v: f"forall(split({v}, '[.]'), p -> ltrim('0', p) rlike '^([0-9]{{0,2}}|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])$')"
    size = lambda x: f"length({digits(f'{x}.v')})"
    # gates are whole-text tests that any match needs; a card takes two digits in a row or about a space or hyphen
    return {
        "email": f"if(contains({text}, '@'), {matches(text, EMAIL)}, {NONE})",
        "ip": f"if(contains({text}, '.'), {only(matches(text, IP), lambda x: small(f'{x}.v'))}, {NONE})",
        "card": only(matches(text, CARD), lambda x: f"{size(x)} between 16 and 19 and {luhn(digits(f'{x}.v'))}"),
        "phone": f"if(contains({text}, '+'), {only(matches(text, PHONE), lambda x: f'{size(x)} between 8 and 15')}, {NONE})",
    }


def proposals(text: str) -> dict[str, str]:
    enough = lambda x: f"length({digits(f'{x}.v')}) between 7 and 19"
    return {
        "number": only(matches(text, NUMBER), enough),
        "grouped": only(matches(text, GROUPED), enough),
        "address": f"if(contains({text}, '(') or contains({text}, '['), {matches(text, ADDRESS)}, {NONE})",
    }


def features(text: str, x: str) -> str:
    """Format and context of a proposal ``x`` as a struct; signs that base patterns need are left out."""
    v = f"{x}.v"
    before = f"substring({text}, greatest(1, {x}.s + 1 - {AROUND}), least({x}.s, {AROUND}))"
    after = f"substring({text}, {x}.e + 1, {AROUND})"
    count = lambda p: f"regexp_count({v}, {quoted(p)})"

    def made(runs: str, context: str) -> str:
        got = (
            f"length({digits(v)})", f"length({v})", f"size({runs})", count(r"\x20"), count("-"), count(r"\."), count(r"[()\[\]]"),
            f"coalesce(array_max({runs}), 0)", f"coalesce(array_min({runs}), 0)", f"coalesce(try_element_at({runs}, 1), 0)", f"coalesce(try_element_at({runs}, -1), 0)",
            f"cast({v} rlike '^[(]?0' as int)", f"cast({v} rlike '(^|[^0-9])(19|20)[0-9][0-9]([^0-9]|$)' as int)", f"length(regexp_extract({digits(v)}, '0*$', 0))",
            f"cast(length({digits(v)}) >= 13 and {luhn(digits(v))} as int)",
            f"cast(concat({context}.a, ' ', {context}.b) rlike {quoted(WORDS)} as int)", f"cast(concat({context}.a, ' ', {context}.b) rlike {quoted(NEXT)} as int)",
            f"cast({context}.a rlike {quoted(chr(92) + 'p{L}$')} as int)", f"cast({context}.b rlike {quoted('^' + chr(92) + 'p{L}')} as int)",
        )
        return "struct(" + ", ".join(f"cast({c} as double) as {k}" for k, c in zip(FEATURES, got, strict=True)) + ")"

    runs = each(f"regexp_extract_all({v}, '[0-9]+', 0)", lambda r: f"length({r})")
    return let(runs, lambda r: let(f"struct({before} as a, {after} as b)", lambda c: made(r, c)))


def tree_sum(model: Trees, f: str) -> str:
    """The model's log-odds as nested CASE expressions over a struct of features."""

    def node(t: int, i: int) -> str:
        if model.left[t, i] == i:
            return f"{float(model.value[t, i])!r}D"
        return f"if({f}.{FEATURES[model.feature[t, i]]} <= {float(model.cut[t, i])!r}D, {node(t, int(model.left[t, i]))}, {node(t, int(model.right[t, i]))})"

    return " + ".join([f"{float(model.base)!r}D", *(node(t, 0) for t in range(len(model.feature)))])


def disguised(kind: str, v: str) -> str:
    """A base span's text without what base patterns know it by."""
    if kind == "phone":
        return f"substring({v}, 2)"
    if kind == "card":
        return f"concat(left({v}, length({v}) - 1), cast((cast(right({v}, 1) as int) + 1) % 10 as string))"
    return f"regexp_replace(replace({v}, '@', ' (at) '), '[.]([A-Za-z0-9-]+)$', ' (dot) $1')"


def drawn(planted: dict[int, tuple[tuple[str, ...], tuple[str, ...]]], times: int = DRAWN, seed: int = 5) -> list[tuple[int, tuple[str, str, str]]]:
    """(class, (before, text, after)) for every pairing of contexts and formats, ``times`` over, digits drawn."""
    rng = np.random.default_rng(seed)
    fill = lambda v: "".join(str(rng.integers(0, 10)) if c == "#" else c for c in v)
    return [(y, (a, fill(v), ". That is all")) for y, (contexts, formats) in planted.items() for a in contexts for v in formats for _ in range(times if "#" in v else 1)]


def examples(df: DataFrame, id_col: str, text_col: str, docs: int) -> DataFrame:
    """(h, y, features) of the planted proposals and those of the ``docs`` documents whose ids hash lowest."""
    spark = df.sparkSession
    one = df.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(docs)
    some = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(one), "_id", "left_semi").where("text is not null")
    # written first, or tests on what is made of the text would be tried on every row
    rows = materialise(some).selectExpr("text", *[f"{c} as {k}" for k, c in base_spans("text").items()], *[f"{c} as {k}" for k, c in proposals("text").items()])
    free = rows.selectExpr("text", f"explode({apart(f'concat({", ".join(MORE)})', f'concat({", ".join(BASE)})')}) as x").selectExpr("text", "x", "0 as y")
    # of what no base span meets, pieces of longer tokens: the rest may be personal or not
    free = free.where("substring(text, x.s, 1) rlike '[\\\\p{L}]' and x.s > 0 or substring(text, x.e + 1, 1) rlike '[\\\\p{L}]'")
    near = lambda kind: each(kind, lambda x: f"struct(substring(text, greatest(1, {x}.s + 1 - {AROUND}), least({x}.s, {AROUND})) as a, {disguised(kind, f'{x}.v')} as v, substring(text, {x}.e + 1, {AROUND}) as b)")
    hidden = rows.selectExpr(f"explode(concat({', '.join(near(k) for k in ('email', 'card', 'phone'))})) as p")
    planted = spark.createDataFrame(drawn(PLANTED), "y int, p struct<a:string,v:string,b:string>")
    snippets = hidden.selectExpr("1 as y", "p").unionAll(planted)
    found = snippets.selectExpr("concat(p.a, p.v, p.b) as text", "struct(length(p.a) as s, length(p.a) + length(p.v) as e, p.v as v) as x", "y")
    return free.unionAll(found).selectExpr("xxhash64(text, x) as h", "y", f"{features('text', 'x')} as f").distinct()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = TRAIN_DOCS, spans: int = TRAIN_SPANS) -> tuple[Trees, float]:
    """(trees, least log-odds to report), from at most ``spans`` proposals of either class (see ``examples``)."""
    got = materialise(examples(df, id_col, text_col, docs))
    order = ["h", *[f"f.{k}" for k in FEATURES]]
    rows = [r for y in (0, 1) for r in got.where(F.col("y") == y).orderBy(*order).limit(spans).collect()]
    x, y = np.array([tuple(r.f) for r in rows]), np.array([r.y for r in rows])
    held = np.array([r.h % 3 == 0 for r in rows], bool)
    model = fit(x[~held], y[~held], [0] * len(FEATURES), TREES)
    wrong = np.sort(model.score(x[held & (y == 0)]))
    allowed = int(FALSE * len(wrong))
    return model, max(0.0, float(np.nextafter(wrong[-1 - allowed], np.inf))) if len(wrong) else 0.0


def scan(df: DataFrame, model: tuple[Trees, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of each row: arrays by kind as listed, then start. Without a model, base spans only."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.selectExpr("doc_id", "text", *[f"{c} as {k}" for k, c in base_spans("text").items()], *[f"{c} as {k}" for k, c in proposals("text").items()])
    base = f"concat({', '.join(named(k, k, i) for i, k in enumerate(BASE))})"

    def chosen(kind: str) -> str:
        if model is None:
            return NONE
        # features are one struct, made once for each proposal
        held = placed_near("text", apart(kind, f"concat({', '.join(BASE)})"), AROUND, features)
        good = only(held, lambda p: f"{tree_sum(model[0], f'{p}.f')} >= {model[1]!r}D")
        return f"if(size({kind}) > 0, {each(good, lambda p: f'{p}.x')}, {NONE})"

    more = [named(chosen(k), k, len(BASE) + i) for i, k in enumerate(MORE)]
    rows = rows.selectExpr("doc_id", *[f"cast(size({k}) as long) as n_{k}" for k in BASE], f"{base} as base", f"concat({', '.join(more)}) as more")
    return rows.selectExpr("doc_id", *[f"n_{k}" for k in BASE], "base", "concat(base, more) as spans")


def report(df: DataFrame, model: tuple[Trees, float] | None, **columns) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) with digests and text in place of arrays."""
    return scan(df, model, **columns).selectExpr("doc_id", *[f"n_{k}" for k in BASE], f"sha2({listed('base')}, 256) as base_sha256", f"{listed('spans')} as spans")
