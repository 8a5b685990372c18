"""Language identification by compression (operator 3).

For each language a raw-content zstandard dictionary is filled with training
text. A text is cut into chunks of words; every chunk is compressed with each
language's dictionary, and the language with the fewest bytes over the whole
text wins. ``score`` is 0.5 for a tie and rises to 1 with the relative saving
over the runner-up; a saving below ``margin`` is a rejection.

Cases: a null text, or one without letters, is ``und`` with score 0 and is
rejected; ties go to the language first by code point; with no training rows
everything is ``und``; whole texts are read, whatever their length; one row
comes out for each that goes in, and other columns are not looked at.

Training reads a bounded sample: for each language at most ``docs_per_lang``
rows, those whose id hashes lowest, of each the first ``4 * dict_bytes //
docs_per_lang`` code points, and of all ``dict_bytes`` of letters. What is
predicted is read whole.
Texts of under ``LEAST_CHARS`` code points are read only for languages that have
no longer ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, table, texts

DOCS_PER_LANG = 100
DICT_BYTES = 48 * 1024
LEAST_CHARS = 40
CHUNK_BYTES = 8192
LEVEL = 5
MARGIN = 0.01


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's decimal text leaves 2 on division by 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Bytes of each language's dictionary, from rows of ``df`` with text and a label.

    Row limits are applied inside each task before the shuffle (window group
    limit), so that a language with any number of rows sends few. Languages are
    equally represented: each gets an equal share of bytes, texts in hash order.
    """
    r = df.select(F.col(id_col).cast("long").alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    r = r.where("l is not null and t is not null").select("l", (F.length("t") < LEAST_CHARS).alias("short"), F.xxhash64("i").alias("h"), F.substring("t", 1, 4 * dict_bytes // docs_per_lang).alias("t"))
    w = Window.partitionBy("l").orderBy("short", "h", "t")
    got: dict[str, list[bytes]] = {}
    long: set[str] = set()
    for row in r.withColumn("n", F.row_number().over(w)).where(F.col("n") <= docs_per_lang).orderBy("l", "n").collect():
        if not row.short:
            long.add(row.l)
        if (not row.short or row.l not in long) and (letters := plain(row.t)):
            got.setdefault(row.l, []).append(letters)
    return {k: b" ".join(v)[:dict_bytes] for k, v in sorted(got.items())}


LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case runs of letters, parted by single spaces: what is compressed."""
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


class Compressors:
    """Bytes that texts need with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        made = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        self.compress = made

    @staticmethod
    def chunks(text: str, most: int = CHUNK_BYTES) -> Iterator[bytes]:
        """All of the text's letters, lower case, in pieces of about ``most`` bytes, cut after a space where there is one."""
        raw, at = plain(text), 0
        while at < len(raw):
            end = at + most
            if end < len(raw):
                space = raw.rfind(b" ", at + most // 2, end)
                end = space + 1 if space > 0 else end
            yield raw[at:end]
            at = end

    def sizes(self, text: str) -> list[int]:
        total = [0] * len(self.compress)
        for c in self.chunks(text):
            for i, f in enumerate(self.compress):
                total[i] += len(f(c))
        return total

    def verdict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        size = self.sizes(text)
        if len(size) == 1:
            return self.langs[0], 1.0, False
        order = sorted(range(len(size)), key=lambda i: (size[i], i))
        best, second = size[order[0]], size[order[1]]
        saved = (second - best) / second
        return self.langs[order[0]], 0.5 + 0.5 * min(1.0, saved / 0.2), saved < margin


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row."""
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES a language
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(sent.value)
        for ids, values in texts(batches):
            got = [model.verdict(t, margin) for t in values]
            yield table(schema, ids, *map(list, zip(*got, strict=True)))

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``df`` that identification doesn't reject, with their own columns."""
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(sent.value)
        for batch in batches:
            keep = [not model.verdict(t.as_py(), margin)[2] for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
