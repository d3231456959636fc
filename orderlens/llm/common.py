"""What the document operators share: columns, written tables, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.plans.storage import fresh_path

#: The characters that separate words, as in ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
CODE_BITS = 60


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    Later plans start from these files, so the loss of an executor costs no
    more than the tasks that read them, and Spark knows their size.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it can have any name.

    ``select("row.*")`` gives the columns back.
    """
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def row_order(df: DataFrame) -> Column:
    """A hash of all columns that Spark can hash, to choose one of several rows alike."""
    hashed = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*hashed)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("bigint")


def code_of(*names: str) -> Column:
    """A row's place in hash order: 60 bits of the MD5 of its values."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, CODE_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


#: An odd base and its inverse modulo 2**64 make hashes of substrings cheap.
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)


#: Bytes of text that a Python worker holds unpacked at a time.
SLICE_BYTES = 4 << 20


def slices(
    batches: Iterator[pa.RecordBatch], *texts: int, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text columns together have about ``size`` bytes,
    one row at least."""
    for batch in batches:
        lengths = sum(
            pc.fill_null(pc.binary_length(batch.column(text)), 0)
            .cast(pa.int64())
            .to_numpy(zero_copy_only=False)
            for text in texts
        )
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        for i, j in blocks(starts, size):
            yield batch.slice(i, j - i)


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def is_blank() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in BLANKS]] = True
    return table


_LOWER, _BLANK = lower_ascii(), is_blank()


def joined_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, a newline after each, and where each starts.

    ``starts`` has one entry more than ``texts``.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(b) + 1 for b in encoded), np.int64, len(encoded))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer(b"\n".join([*encoded, b""]), np.uint8), starts


_TABLES = {"n": 0}
#: Bytes hashed at a time, few enough for a processor's cache.
_BLOCK = 1 << 17


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _TABLES["n"] < n:
        _TABLES.update(n=n, up=powers(BASE, n), down=powers(INVERSE, n))
    return _TABLES["up"][:n], _TABLES["down"][:n]


def blocks(starts: np.ndarray, size: int = _BLOCK) -> list[tuple[int, int]]:
    """Cut texts into runs of about ``size`` bytes, one text at least: (from, to)."""
    out, i, n = [], 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def word_hashes(
    texts: list[str | None], blank_bytes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts, ASCII case aside, in order.

    ``blank_bytes`` marks the bytes that separate words, the newline among them.

    Returns the hashes and, per text, where its words begin among them (one
    entry more than texts).
    """
    every, starts = joined_bytes(texts)
    hashes, first, n = [], [np.zeros(1, np.int64)], 0
    for i, j in blocks(starts):
        data = _LOWER[every[starts[i] : starts[j]]]
        up, down = _power_tables(len(data))
        blank = (_BLANK if blank_bytes is None else blank_bytes)[data]
        # a word begins after a blank and ends before one; each text ends in one
        change = np.flatnonzero(np.diff(blank, prepend=True))
        begin, end = change[::2], change[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up, out=total[1:])
        hashes.append(mixed((total[end] - total[begin]) * down[begin]))
        first.append(n + np.searchsorted(begin, starts[i + 1 : j + 1] - starts[i]))
        n += len(begin)
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate(first)


def shingle_hashes(
    words: np.ndarray, first: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and the text each belongs to.

    A text of fewer words, but one at least, is a single shingle.
    """
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(words)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0x9FB21C651E98DF25)
        shifted = np.zeros(n, np.uint64)
        if i < n:
            shifted[: n - i] = words[i:]
        if i:  # words beyond the end of the text do not count
            same = np.zeros(n, bool)
            same[: n - i] = owner[i:] == owner[: n - i]
            shifted[~same] = 0
        out += shifted
    left = first[1:][owner] - np.arange(n) if n else np.zeros(0, np.int64)
    keep = (left >= size) | (np.arange(n) == first[:-1][owner])
    return mixed(out[keep]), owner[keep]
