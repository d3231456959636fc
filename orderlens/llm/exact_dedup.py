"""Exact dedup: an extendible-hash index on shared files, read by owner tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm import extendible
from orderlens.llm.common import (
    BLANKS,
    CODE_BITS,
    row_order,
    text_or_empty,
    whole_row,
    written,
)

#: Bytes of text in one bucket of the index.
BUCKET_BYTES = 32 << 20

_ROWS = "row_doc_id {id}, n_chars bigint, code bigint, sha string, bytes bigint"
_ENTRIES = "code bigint, sha string, body binary, n bigint, n_chars bigint, best_id {id}"
_INDEX = "code bigint, sha string, n bigint, n_chars bigint, best_id {id}"


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANKS.encode())


def _code(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - CODE_BITS)


def _better(chars: int, doc_id, than: tuple) -> bool:
    if chars != than[0]:
        return chars > than[0]
    return doc_id is not None and (than[1] is None or doc_id < than[1])


def _row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars, codes, shas, sizes = [], [], [], []
        for text in batch.column(1).to_pylist():
            body = _normal(text)
            digest = hashlib.sha256(body)
            chars.append(len(text or ""))
            codes.append(_code(digest.digest()))
            shas.append(digest.hexdigest())
            sizes.append(len(body))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(chars, pa.int64()),
                pa.array(codes, pa.int64()),
                pa.array(shas, pa.string()),
                pa.array(sizes, pa.int64()),
            ],
            ["row_doc_id", "n_chars", "code", "sha", "bytes"],
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each different text of a batch, copies counted."""
    for batch in batches:
        found: dict[bytes, list] = {}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chars, body = len(text or ""), _normal(text)
            entry = found.get(body)
            if entry is None:
                found[body] = [chars, doc_id, 1]
            else:
                entry[2] += 1
                if _better(chars, doc_id, (entry[0], entry[1])):
                    entry[:2] = chars, doc_id
        digests = [hashlib.sha256(body) for body in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_code(d.digest()) for d in digests], pa.int64()),
                pa.array([d.hexdigest() for d in digests], pa.string()),
                pa.array(list(found), pa.binary()),
                pa.array([e[2] for e in found.values()], pa.int64()),
                pa.array([e[0] for e in found.values()], pa.int64()),
                pa.array([e[1] for e in found.values()], batch.column(0).type),
            ],
            ["code", "sha", "body", "n", "n_chars", "best_id"],
        )


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk a key range in order of hash; per hash a chain of different texts.

    Memory holds the texts of one hash at a time.
    """
    at: int | None = None
    chain: list[list] = []

    def flush(id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([at] * len(done), pa.int64()),
                pa.array([e[1] for e in done], pa.string()),
                pa.array([e[2] for e in done], pa.int64()),
                pa.array([e[3] for e in done], pa.int64()),
                pa.array([e[4] for e in done], id_type),
            ],
            ["code", "sha", "n", "n_chars", "best_id"],
        ).set_column(0, "code", pa.array([e[5] for e in done], pa.int64()))

    done: list[list] = []
    id_type = pa.int64()
    for batch in batches:
        id_type = batch.column(5).type
        columns = [c.to_pylist() for c in batch.columns[:6]]
        for code, sha, body, n, chars, doc_id in zip(*columns):
            if code != at:
                done += chain
                at, chain = code, []
            for entry in chain:
                if entry[0] == body:
                    entry[2] += n
                    if _better(chars, doc_id, (entry[3], entry[4])):
                        entry[3:5] = chars, doc_id
                    break
            else:
                chain.append([body, sha, n, chars, doc_id, code])
        if len(done) > 10_000:
            yield flush(id_type)
            done = []
    done += chain
    yield flush(id_type)


def text_index(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Row keys, and the index: one entry per different text.

    Texts are entered with their blanks deleted; null counts as empty. A
    directory of hash prefixes is doubled where a bucket holds more than
    ``bucket_bytes``. Each bucket is owned by one task, which walks it in
    order of hash, chains texts of one hash and compares their bytes. Copies
    are counted before the shuffle, so a text that a third of all rows hold
    arrives once per batch of rows. The index lies in the shared folder.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = docs.select("doc_id", "text")
    rows = written(pairs.mapInArrow(_row_keys, _ROWS.format(id=kind)), "row-keys")
    sizes = rows.groupBy("code").agg(F.max("bytes").alias("size"))
    directory = extendible.build(sizes, bucket_bytes)
    entries = directory.find(pairs.mapInArrow(_entries, _ENTRIES.format(id=kind)))
    owned = (
        entries.repartition("depth", "prefix")
        .sortWithinPartitions("depth", "prefix", "code")
        .select("code", "sha", "body", "n", "n_chars", "best_id")
        .mapInArrow(_owner, _INDEX.format(id=kind))
    )
    return rows, written(owned, "text-index")


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For each document the one of its copies that stays.

    Texts are equal when identical without the characters of ``BLANKS``. The
    row with the most code points stays, then the smallest id (null last). Of
    rows that agree in all of these one stays. An empty table gives no rows;
    columns other than ``doc_id`` and ``text`` are not read.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    rows, index = text_index(docs, bucket_bytes)
    same = rows.groupBy("row_doc_id", "n_chars", "code", "sha").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    best = index.select(
        "code", "sha", F.col("n").alias("group_size"), F.col("n_chars").alias("_most"), "best_id"
    )
    wins = F.col("row_doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("_most"))
    return (
        same.join(best, ["code", "sha"])
        .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))))
        .select(
            F.col("row_doc_id").alias("doc_id"),
            F.col("best_id").alias("keep_id"),
            "group_size",
            (wins & (F.col("_nth") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def without_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents that stay, with all their columns.

    Of rows that also agree in id and length the one of the smallest hash of all
    columns stays. A text is moved once; rows meet the index by text, length and
    id, so copies of one text are spread and meet no more than their id does.
    An empty table gives no rows.
    """
    _, index = text_index(docs, bucket_bytes)
    keys = ["sha", "chars", "id"]

    def id_key(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null")).alias("id")

    best = index.select("sha", F.col("n_chars").alias("chars"), id_key("best_id"))
    normal = F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", "")
    rows = docs.select(
        whole_row(docs),
        F.sha2(normal.cast("binary"), 256).alias("sha"),
        F.char_length(text_or_empty()).cast("bigint").alias("chars"),
        id_key("doc_id"),
        row_order(docs).alias("tie"),
    )
    return (
        rows.join(best, keys)
        .withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("tie")))
        .filter("place = 1")
        .select("row.*")
    )
