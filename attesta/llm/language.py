"""Language of a text by compression against per-language zstandard dictionaries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bounds of the training sample, for each language: documents, and bytes of the dictionary.
SAMPLE_DOCUMENTS = 200
DICTIONARY_BYTES = 96 * 1024
#: A sampled text gives a slice of at most this many bytes, so that no single one fills a dictionary.
SAMPLE_BYTES = 2048
CHUNK_BYTES = 4096
LEVEL = 6
#: Bytes of difference, at 4 KB of text, that make a rival half as likely; and the margin below which a verdict is unsure.
HALF_BYTES = 4.0
MARGIN = 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_compressors: dict[tuple, list] = {}


def dictionaries(
    docs: DataFrame, lang: str = "lang", text: str = "text", documents: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES
) -> dict[str, bytes]:
    """Raw dictionary content for each language of the training rows.

    A bounded sample: for each language a slice of bounded size, at a hashed place, of each of the
    `documents` texts of the smallest hash, up to `size` bytes in all. Rows with a null language or a text without letters are
    left out. The result is as large as the number of languages times `size`.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    hashed = F.xxhash64(text)
    start = 1 + F.pmod(hashed, F.greatest(F.lit(1), F.length(text) - SAMPLE_BYTES + 1).cast("long"))
    narrow = usable.select(
        F.col(lang).cast("string").alias("lang"), hashed.alias("place"), F.col(text).substr(start.cast("int"), F.lit(SAMPLE_BYTES)).alias("text")
    )
    order = Window.partitionBy("lang").orderBy("place", "text")
    picked = narrow.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= documents).select("lang", "n", "text")
    found: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", "n").collect():  # bounded: languages times `documents` rows
        found.setdefault(row["lang"], []).append(letters(row["text"]).encode("utf-8", "replace")[:SAMPLE_BYTES])
    return {k: b" ".join(v)[:size] for k, v in sorted(found.items())}


def letters(text: str) -> str:
    """Lower-case words with single blanks between them: case and signs tell layouts apart, not languages."""
    return _OTHER.sub(" ", text.lower())


def _encoders(contents: tuple[tuple[str, bytes], ...], level: int) -> list:
    """Compressors of this process, made once for a set of dictionaries."""
    import zstandard

    key = (tuple((k, hash(v)) for k, v in contents), level)
    if key not in _compressors:
        _compressors.clear()
        made = []
        for _, content in contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False))
        _compressors[key] = made
    return _compressors[key]


def sizes(text: str, contents: tuple[tuple[str, bytes], ...], level: int = LEVEL, chunk: int = CHUNK_BYTES) -> list[int]:
    """Compressed size of the whole text under each dictionary, summed over chunks.

    Chunks keep the dictionary in reach: in one long frame the text itself would soon outweigh it.
    """
    raw = letters(text).encode("utf-8", "replace")
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
    return [sum(len(c.compress(p)) for p in parts) for c in _encoders(contents, level)]


def decide(text: str | None, contents: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language, score, sure). `und` for null texts, texts without letters, and where nothing was learned."""
    if not text or not contents or not _LETTER.search(text):
        return UNKNOWN, 0.0, False
    found = sizes(text, contents)
    best = min(range(len(found)), key=lambda i: (found[i], contents[i][0]))
    unit = HALF_BYTES * max(1.0, len(text) / CHUNK_BYTES)
    score = 1 / sum(2.0 ** -min(1000.0, (s - found[best]) / unit) for s in found)
    second = min((s for i, s in enumerate(found) if i != best), default=None)
    sure = second is None or (second - found[best]) / max(1, second) >= MARGIN
    return contents[best][0], score, sure


def predict(docs: DataFrame, learned: dict[str, bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, sure) for every row, from whole texts.

    `sure` is false where the second language is closer than the margin; the nearest is still named.
    Ties go to the first language by name. Repeated rows each come back; other columns are not read.
    """
    contents = tuple(learned.items())

    @pandas_udf("lang_pred string, score double, sure boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decide(t, contents) for t in texts], columns=["lang_pred", "score", "sure"])

    return docs.select(F.col(id_col).alias("doc_id"), judged(docs[text]).alias("j")).select("doc_id", "j.*")
