"""Suffix-array dedup: remove bytes covered by long strings that occur twice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import BASE, INVERSE, blocks, joined_bytes, mixed, powers, slices, written
from orderlens.llm.suffix_array import repeated_windows

WIDTH = 400
#: Anchors are the least of all strings of this length in a window.
GRAM = 50
#: Bytes of one shard array.
SHARD_BYTES = 1 << 20
#: An anchor whose different stretches have more bytes is a shard of its own,
#: thinned beforehand by counting its windows.
HOT_BYTES = 4 << 20
_CHUNK = 1 << 20
_POSITION_BITS = 22


def _sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // w) * w, ~np.uint64(0), np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).reshape(-1)
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


class _Stretches:
    """Cuts texts into stretches: runs of windows that share an anchor.

    The anchor of a window is the hash of its least ``gram`` bytes in an order
    by hash. Equal windows have equal anchors, so whatever repeats repeats
    within an anchor.
    """

    def __init__(self, width: int, gram: int):
        self.width, self.gram, self.span = width, gram, width - gram + 1
        n = _CHUNK + (1 << 18)
        self.up, self.down = powers(BASE, n), powers(INVERSE, n)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        return self.up[:n], self.down[:n]

    def cut(self, data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, windows, anchor and number of anchor places of each stretch.

        ``valid`` marks where a window may begin; it has ``width - 1`` entries
        fewer than ``data``.
        """
        up, down = self._tables(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up, out=total[1:])
        hashes = mixed((total[self.gram :] - total[: -self.gram]) * down[: len(data) - self.gram + 1])
        low = np.uint64((1 << _POSITION_BITS) - 1)
        least = _sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), self.span)
        at = np.flatnonzero(valid)
        place = (least[at] & low).astype(np.int64)
        anchor = hashes[place]
        if not len(at):
            return at, at, anchor, at
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
        moved = new.copy()
        moved[1:] |= place[1:] != place[:-1]
        first = np.flatnonzero(new)
        return (
            at[first],
            np.diff(np.append(first, len(at))),
            anchor[first],
            np.add.reduceat(moved.astype(np.int64), first),
        )

    def of(self, texts: list[str | None]) -> Iterator[tuple]:
        """(text, start, windows, anchor, places, digest of the bytes)."""
        data, starts = joined_bytes(texts)
        last = self.width - 1
        for i, j in blocks(starts, _CHUNK):
            for low in range(int(starts[i]), int(starts[j]), _CHUNK * 2):
                high = min(int(starts[j]), low + 2 * _CHUNK)
                part = data[low : min(high + last, len(data))]
                if len(part) < self.width:
                    continue
                # windows may begin up to width bytes before a text's newline
                valid = np.zeros(len(part) - last, bool)
                for a, b in zip(starts[i:j].tolist(), starts[i + 1 : j + 1].tolist()):
                    valid[max(0, a - low) : max(0, min(high, b - 1 - last) - low)] = True
                raw = part.tobytes()
                owner = np.searchsorted(starts, low + np.arange(len(valid)), "right") - 1
                for at, n, anchor, places in zip(*(x.tolist() for x in self.cut(part, valid))):
                    digest = hashlib.blake2b(raw[at : at + n + last], digest_size=16).digest()
                    text = int(owner[at])
                    yield text, low + at - int(starts[text]), n, anchor, places, digest


def _key(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest()[:16]


_RUN = "anchor bigint, places bigint, digest binary, key binary, at int, n int"


def stretches(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """One row per stretch of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Stretches(width, gram)
        for batch in slices(batches, 0):
            texts = batch.column(0).to_pylist()
            keys = [_key(t) for t in texts]
            rows = list(zip(*cutter.of(texts))) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(rows[3], np.uint64).view(np.int64)),
                    pa.array(rows[4], pa.int64()),
                    pa.array(rows[5], pa.binary()),
                    pa.array([keys[i] for i in rows[0]], pa.binary()),
                    pa.array(rows[1], pa.int32()),
                    pa.array(rows[2], pa.int32()),
                ],
                ["anchor", "places", "digest", "key", "at", "n"],
            )

    return docs.select("text").mapInArrow(cut, _RUN)


def _bodies(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the stretches in ``wanted`` (anchor, digest, key, at, n, copies)."""
    lists = wanted.groupBy("key").agg(
        F.collect_list(F.struct("anchor", "digest", "at", "n", "copies")).alias("parts")
    )
    texts = docs.select(
        F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16).alias("key"),
        "text",
    )
    one = texts.join(lists, "key").dropDuplicates(["key"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            rows = []
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for p in parts:
                    body = raw[p["at"] : p["at"] + p["n"] + width - 1]
                    rows.append((p["anchor"], p["digest"], p["copies"], body))
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["anchor", "digest", "copies", "body"],
            )

    return one.select("text", "parts").mapInArrow(
        extract, "anchor bigint, digest binary, copies bigint, body binary"
    )


_FOUND = "digest binary, spans array<struct<low:int,high:int>>"


def _runs(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _compared(bodies: DataFrame, width: int) -> DataFrame:
    """The repeated windows of each stretch, from the suffix arrays of shards.

    A shard holds the stretches of whole anchors, up to SHARD_BYTES or one
    anchor. Stretches that occur several times repeat as a whole.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []
        size = 0

        def solve() -> pa.RecordBatch:
            # a stretch that is there once more says that its windows repeat
            found = repeated_windows([h[3] for h in held], width)
            spans = [_runs(m) for m in found]
            keep = [i for i, s in enumerate(spans) if s and held[i][2] == 1]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[i][1] for i in keep], pa.binary()),
                    pa.array(
                        [spans[i] for i in keep],
                        pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])),
                    ),
                ],
                ["digest", "spans"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield solve()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield solve()

    return (
        bodies.repartition("anchor")
        .sortWithinPartitions("anchor", "digest")
        .mapInArrow(shard, _FOUND)
    )


def _thinned(bodies: DataFrame, width: int) -> DataFrame:
    """Of hot anchors, only the runs of windows that occur more than once.

    Each window is a row of its digest and is counted in one partial
    aggregation, so no task needs an anchor's stretches together. What is left
    is the same few strings again and again, counted once each.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, size=1 << 19):
            rows = []
            for anchor, digest, body in zip(*(c.to_pylist() for c in batch.columns)):
                for i in range(len(body) - width + 1):
                    window = hashlib.blake2b(body[i : i + width], digest_size=16).digest()
                    rows.append((window, digest, i))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.binary()),
                    pa.array(columns[1], pa.binary()),
                    pa.array(columns[2], pa.int32()),
                ],
                ["window", "digest", "i"],
            )

    rows = written(
        bodies.select("anchor", "digest", "body").mapInArrow(
            windows, "window binary, digest binary, i int"
        ),
        "hot-windows",
    )
    twice = rows.groupBy("window").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("window")
    return rows.join(twice, "window").groupBy("digest").agg(F.collect_set("i").alias("places")).select(
        "digest",
        F.transform("places", lambda i: F.struct(i.alias("low"), (i + 1).alias("high"))).alias("spans"),
    )


def repeated_spans(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """``key`` (of a text) and ``spans``: where windows begin that occur elsewhere."""
    runs = written(stretches(docs, width, gram), "stretches")
    # an anchor at one place in the corpus has no repeated window
    again = runs.groupBy("anchor").agg(F.sum("places").alias("c")).filter("c > 1").select("anchor")
    shared = written(
        runs.join(again, "anchor")
        .groupBy("anchor", "digest", "key", "at", "n")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("places").alias("places")),
        "shared-stretches",
    )
    different = written(
        shared.groupBy("anchor", "digest").agg(
            F.sum("copies").alias("copies"),
            F.max("places").alias("places"),
            F.min(F.struct("key", "at", "n")).alias("one"),
        ),
        "different-stretches",
    )
    anchors = different.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.n") + width).alias("bytes")
    )
    # where all stretches of an anchor are the same, their number says it all
    open_ = written(
        different.join(anchors, "anchor")
        .filter("kinds > 1 or (copies = 1 and places > 1)")
        .select("anchor", "digest", "copies", "one.*", "bytes"),
        "open-stretches",
    )
    bodies = written(_bodies(docs, open_, width), "bodies")
    hot = open_.filter(F.col("bytes") > hot_bytes).select("anchor").distinct()
    found = _compared(bodies.join(hot, "anchor", "left_anti"), width)
    if not hot.isEmpty():
        found = found.unionByName(_thinned(bodies.join(hot, "anchor", "left_semi"), width))
    found = written(found, "repeated")
    whole = different.filter("copies > 1").select("digest").distinct()
    place = F.struct(F.col("at").alias("low"), (F.col("at") + F.col("n")).alias("high"))
    spans = shared.join(whole, "digest").select("key", place.alias("span")).unionByName(
        shared.filter("copies = 1")
        .join(found, "digest")
        .select("key", "at", F.explode("spans").alias("s"))
        .select(
            "key",
            F.struct(
                (F.col("at") + F.col("s.low")).alias("low"),
                (F.col("at") + F.col("s.high")).alias("high"),
            ).alias("span"),
        )
    )
    return spans.groupBy("key").agg(F.collect_set("span").alias("spans"))


def without_repeats(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """What is left of each document after its repeated strings are removed.

    A byte goes if a string of ``width`` bytes that covers it also starts
    anywhere else, in the same document or another; strings lie within a
    document, and overlap. Null counts as an empty text. Texts shorter than
    ``width`` bytes lose nothing, repeated rows of longer ones everything. An
    empty table gives no rows; columns other than ``doc_id`` and ``text`` are
    not read.

    Texts are cut into stretches of windows that share an anchor. Anchors and
    stretches are counted first; only anchors with different stretches, or one
    that may repeat in itself, send their bytes to a shard. Shards sort all
    their suffixes by induced sorting and find windows with a common prefix of
    ``width`` bytes. Of an anchor with more than ``hot_bytes`` of different
    stretches, windows are counted as rows instead.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the
    bytes that stay).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = written(repeated_spans(docs, width, gram, hot_bytes), "repeated-spans")
    keyed = docs.select(
        F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16).alias("key"),
        "doc_id",
        "text",
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone = np.zeros(len(raw) + 1, np.int64)
                for s in marks or ():
                    gone[s["low"]] += 1
                    gone[s["high"] + width - 1] -= 1
                mask = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                rows.append(
                    (len(raw), int(mask.sum()), len(_runs(mask)), hashlib.sha256(kept).hexdigest(), kept)
                )
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return (
        keyed.join(spans, "key", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            remove,
            f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, "
            "kept_sha256 string, kept binary",
        )
    )
