"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import (
    mixed,
    row_order,
    shingle_hashes,
    slices,
    whole_row,
    word_hashes,
    written,
)

SHINGLE = 5
SIMILARITY = 0.8
#: 14 bands of 3 samples: a pair at 0.8 meets with probability
#: 1 - (1 - 0.8**3)**14 = 0.99996.
BANDS, ROWS = 14, 3
#: Samples that must agree before two texts are compared in full: half of all.
#: A pair at 0.8 has fewer with probability 0.000003 (binomial, 42 samples).
AGREE = BANDS * ROWS // 2
#: Document frequencies are counted in this many buckets of words, so that the
#: table has one size for any corpus.
WORD_BUCKETS = 1 << 16
#: Rows of one or two 32-letter keys that may be broadcast, about 10 MB.
BROADCAST_ROWS = 100_000
#: Texts of a cell in the comparison between classes.
PROBES, SLICE = 128, 1024
_LEVELS = 1 << 12
_BLOCK = 1 << 16


def gamma_quantiles(n: int) -> np.ndarray:
    """The Gamma(2, 1) distribution at the middles of n equal shares."""
    share = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - np.exp(-middle) * (1 + middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


_GAMMA = gamma_quantiles(_LEVELS).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)


def _word_bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


def weighted_shingles(
    texts: list[str | None], idf: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of the texts by (text, hash), once each: hash, weight, and where
    each text's begin. The weight is the count times the mean inverse document
    frequency of the words."""
    words, first = word_hashes(texts)
    hashes, owner = shingle_hashes(words, first, SHINGLE)
    spread = np.concatenate([[0.0], np.cumsum(idf[_word_bucket(words)], dtype=np.float64)])
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    starts = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(len(hashes)) - starts[:-1][owner] + first[:-1][owner]
    end = np.minimum(at + SHINGLE, first[1:][owner])
    mean = (spread[end] - spread[at]) / np.maximum(end - at, 1)
    order = np.lexsort((hashes, owner))
    hashes, owner, mean = hashes[order], owner[order], mean[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(hashes)))
    # six digits: sums over other neighbours differ in the last bits
    weights = np.round(tf * mean[at], 6)
    return hashes[at], weights, np.searchsorted(owner[at], np.arange(len(texts) + 1))


def _samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples per text (rows), for texts with shingles."""
    out = np.empty((len(starts) - 1, n), np.uint64)
    logs = np.log(weights).astype(np.float32)
    sizes = np.diff(starts)
    for k in range(n):
        bits = mixed(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = _GAMMA[(bits >> np.uint64(52)).astype(np.int32)]
        log_c = _LOG_GAMMA[((bits >> np.uint64(40)) & np.uint64(_LEVELS - 1)).astype(np.int32)]
        beta = ((bits & np.uint64(0xFFFFFF)).astype(np.float32)) * np.float32(2**-24)
        t = np.floor(logs / r + beta)
        key = log_c - r * (t - beta) - r
        least = np.minimum.reduceat(key, starts[:-1])
        hit = np.flatnonzero(key == np.repeat(least, sizes))
        first = hit[np.searchsorted(hit, starts[:-1])]
        out[:, k] = mixed(hashes[first] + (t[first].astype(np.int64) * 0x51ED27).view(np.uint64))
    return out


def band_keys(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS band hashes per text, zeros for a text without words, and one byte
    of each sample."""
    hashes, weights, starts = weighted_shingles(texts, idf)
    out = np.zeros((len(texts), BANDS), np.uint64)
    sketch = np.zeros((len(texts), BANDS * ROWS), np.int8)
    full = np.flatnonzero(np.diff(starts) > 0)
    i = 0
    while i < len(full):
        j = i + 1
        while j < len(full) and starts[full[j] + 1] - starts[full[i]] <= _BLOCK:
            j += 1
        ids = full[i:j]
        low, high = starts[ids[0]], starts[ids[-1] + 1]
        edges = np.append(starts[ids], high) - low
        got = _samples(hashes[low:high], weights[low:high], edges, BANDS * ROWS)
        sketch[ids] = (got >> np.uint64(56)).astype(np.uint8).view(np.int8)
        for band in range(BANDS):
            key = np.full(len(ids), band + 1, np.uint64)
            for row in range(ROWS):
                key = mixed(key * np.uint64(0x9FB21C651E98DF25) + got[:, band * ROWS + row])
            out[ids, band] = key
        i = j
    return out, sketch


def jaccard(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]
) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either else 0.0


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln(1 + N / (1 + documents with a word of the bucket)) over all documents.

    Each task counts into one array of WORD_BUCKETS; the table that comes back
    has WORD_BUCKETS rows for any corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WORD_BUCKETS, np.int64), 0
        for batch in slices(batches, 0):
            words, first = word_hashes(batch.column(0).to_pylist())
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pairs = np.unique(owner * WORD_BUCKETS + _word_bucket(words))
            total += np.bincount(pairs % WORD_BUCKETS, minlength=WORD_BUCKETS)
            n += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["bucket", "n"]
        )

    counted = docs.select("text").mapInArrow(count, "bucket bigint, n bigint")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table, n = np.zeros(WORD_BUCKETS), 0
    for bucket, value in zip(rows["bucket"], rows["n"]):
        if bucket < 0:
            n = value
        else:
            table[bucket] = value
    return np.log1p(n / (1 + table))


def _copy_key():
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.md5(F.trim(spaced).cast("binary"))


def _signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys = batch.column(0).to_pylist()
            first = list({k: i for i, k in reversed(list(enumerate(keys)))}.values())
            texts = batch.column(1).take(pa.array(first, pa.int64())).to_pylist()
            bands, sketch = band_keys(texts, idf)
            bands = bands.view(np.int64)
            some = np.flatnonzero(bands.any(axis=1))

            def lists(rows: np.ndarray) -> pa.Array:
                offsets = pa.array(np.arange(len(some) + 1) * rows.shape[1], pa.int32())
                return pa.ListArray.from_arrays(offsets, pa.array(rows[some].reshape(-1)))

            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[first[i]] for i in some], pa.string()), lists(bands), lists(sketch)],
                ["key", "bands", "sketch"],
            )

    return docs.select(_copy_key().alias("key"), "text").mapInArrow(
        sign, "key string, bands array<bigint>, sketch array<tinyint>"
    )


def _agree(a: str, b: str) -> Column:
    """Whether enough samples of two sketches agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x) >= AGREE


def _candidates(led: DataFrame) -> DataFrame:
    """The pairs of a member and a leader whose sketches agree, smaller key first.

    ``led``: ``key, sketch, lead`` (``key, sketch``).
    """
    return (
        led.filter(F.col("lead.key") != F.col("key"))
        .filter(_agree("sketch", "lead.sketch"))
        .select(
            F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")
        )
        .distinct()
    )


def if_few(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if counting shows ``most`` rows of short keys or less;
    else Spark shuffles both sides. The rows that come out are the same."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 3):
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            different: dict[str, str] = {}
            different.update(zip(a, part.column(2).to_pylist()))
            different.update(zip(b, part.column(3).to_pylist()))
            at = {k: i for i, k in enumerate(different)}
            hashes, weights, starts = weighted_shingles(list(different.values()), idf)

            def bag(key: str) -> tuple[np.ndarray, np.ndarray]:
                own = slice(starts[at[key]], starts[at[key] + 1])
                return hashes[own], weights[own]

            near = [jaccard(bag(x), bag(y)) for x, y in zip(a, b)]
            keep = [i for i, s in enumerate(near) if s >= similarity]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.string()),
                 pa.array([b[i] for i in keep], pa.string()),
                 pa.array([near[i] for i in keep], pa.float64())],
                ["a", "b", "similarity"],
            )

    few = if_few(pairs)
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")).join(few, "a")
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")).join(few, "b")
    return (
        left.join(right, ["a", "b"])
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(check, "a string, b string, similarity double")
    )


def _classed(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "key", "left").withColumn("class", F.coalesce("class", "key"))


def _between_classes(
    classed: DataFrame, signed: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float
) -> DataFrame:
    """Verified pairs that join the classes of every bucket.

    The texts outside a bucket's largest class (probes) meet all texts of other
    classes in it. Probes are dealt into blocks and the bucket's texts into
    slices; a cell is one block beside one slice, so a cell has one size for
    any bucket. A pair is compared in the first bucket it shares, and a probe is
    linked once to each class.
    """
    counted = classed.groupBy("band", "class").agg(F.count(F.lit(1)).alias("n"))
    plan = (
        counted.groupBy("band")
        .agg(
            F.max_by("class", F.struct("n", "class")).alias("_main"),
            F.max("n").alias("_most"),
            F.sum("n").alias("_all"),
        )
        .filter("_most < _all")
        .select(
            "band",
            "_main",
            F.ceil((F.col("_all") - F.col("_most")) / PROBES).cast("int").alias("_blocks"),
            F.ceil(F.col("_all") / SLICE).cast("int").alias("_slices"),
        )
    )
    rows = (
        classed.select("band", "key", "class")
        .join(plan, "band")
        .withColumn("probe", F.col("class") != F.col("_main"))
        .withColumn("_block", F.pmod(F.xxhash64("key", F.lit(1)), "_blocks").cast("int"))
        .withColumn("_slice", F.pmod(F.xxhash64("key", F.lit(2)), "_slices").cast("int"))
    )
    cell = F.struct("band", "_block", "_slice").alias("cell")
    probes = (
        rows.filter("probe")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        .select(cell, F.lit(0).alias("turn"), "probe", "key", "class")
    )
    others = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        cell, F.lit(1).alias("turn"), "probe", "key", "class"
    )
    tasks = int(classed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        probes.unionByName(others)
        .join(signed, "key")
        .join(texts, "key")
        .repartition(tasks, "cell")
        .sortWithinPartitions("cell", "turn")
        .select(
            F.to_json("cell").alias("cell"), F.col("cell.band").alias("band"), "turn", "probe",
            "key", "class", "bands", "sketch", "text",
        )
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, []
        for part in slices(batches, 8):
            cells, turns = part.column(0).to_pylist(), part.column(2).to_pylist()
            edges = [
                i for i in range(len(cells) + 1)
                if i in (0, len(cells)) or (cells[i], turns[i]) != (cells[i - 1], turns[i - 1])
            ]
            for i, j in zip(edges, edges[1:]):
                if cells[i] != current:
                    current, block = cells[i], []
                group = _Texts(part.slice(i, j - i), idf)
                if turns[i] == 0:
                    block.append((group, [set() for _ in group.keys]))
                    continue
                found = [
                    link for probe, linked in block for link in group.links(probe, linked, similarity)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.string()),
                     pa.array([x[1] for x in found], pa.string()),
                     pa.array([x[2] for x in found], pa.float64())],
                    ["a", "b", "similarity"],
                )

    found = dealt.mapInArrow(meet, "a string, b string, similarity double")
    return found.groupBy("a", "b").agg(F.first("similarity").alias("similarity"))


class _Texts:
    """Texts of one cell: keys, classes, samples and weighted shingles."""

    def __init__(self, part: pa.RecordBatch, idf: np.ndarray):
        self.band = part.column(1)[0].as_py()
        self.probe, self.keys, self.classes = (part.column(k).to_pylist() for k in (3, 4, 5))
        self.bands = part.column(6).flatten().to_numpy().reshape(-1, BANDS)
        self.sketch = part.column(7).flatten().to_numpy().reshape(-1, BANDS * ROWS)
        self.texts, self.idf, self.bags = part.column(8), idf, None

    def bag(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if self.bags is None:
            self.bags = weighted_shingles(self.texts.to_pylist(), self.idf)
        hashes, weights, starts = self.bags
        return hashes[starts[i] : starts[i + 1]], weights[starts[i] : starts[i + 1]]

    def links(
        self, probes: _Texts, linked: list[set[str]], similarity: float
    ) -> Iterator[tuple[str, str, float]]:
        """Links of the probes to these texts; ``linked`` keeps the classes of each."""
        for p, key in enumerate(probes.keys):
            shared = self.bands == probes.bands[p]
            here = self.bands[np.arange(len(shared)), shared.argmax(axis=1)] == self.band
            agree = (self.sketch == probes.sketch[p]).sum(axis=1)
            close = np.flatnonzero(here & (agree >= AGREE))
            # those that agree most come first, the rest of their class is skipped
            close, size = close[np.argsort(-agree[close], kind="stable")].tolist(), 8
            while close:
                open_ = [
                    i for i in close
                    if self.classes[i] != probes.classes[p]
                    and self.classes[i] not in linked[p]
                    and not (self.probe[i] and self.keys[i] < key)  # they meet the other way
                ]
                some, close, size = open_[:size], open_[size:], 2 * size
                for i in self.perhaps(some, probes.bag(p), similarity):
                    if self.classes[i] in linked[p]:
                        continue
                    near = jaccard(probes.bag(p), self.bag(i))
                    if near >= similarity:
                        linked[p].add(self.classes[i])
                        yield min(key, self.keys[i]), max(key, self.keys[i]), near

    def perhaps(
        self, some: list[int], bag: tuple[np.ndarray, np.ndarray], similarity: float
    ) -> list[int]:
        """Those of the texts that are as similar, but for rounding."""
        if not some:
            return []
        bags = [self.bag(i) for i in some]
        hashes, weights = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
        starts = np.concatenate([[0], np.cumsum([len(b[0]) for b in bags])])[:-1]
        at = np.minimum(np.searchsorted(bag[0], hashes), len(bag[0]) - 1)
        both = np.where(bag[0][at] == hashes, np.minimum(bag[1][at], weights), 0)
        both, total = np.add.reduceat(both, starts), np.add.reduceat(weights, starts)
        either = total + bag[1].sum() - both
        return [i for i, near in zip(some, both / either) if near >= similarity - 1e-9]


def components(edges: DataFrame) -> DataFrame:
    """``key, class`` for every end of an edge: the smallest key it reaches.

    ``edges`` holds each pair once. Labels spread over edges and jump along
    labels, so the rounds grow with the logarithm of a chain; they end when both
    ends of every edge have one label. Each round is a written table.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "links"
    )
    labels = written(
        both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("class")),
        "labels",
    )
    while True:
        near = both.join(
            labels.select(F.col("key").alias("b"), F.col("class").alias("near")), "b"
        )
        torn = near.join(
            labels.select(F.col("key").alias("a"), F.col("class").alias("own")), "a"
        ).filter("own <> near")
        if torn.isEmpty():
            return labels
        least = near.groupBy(F.col("a").alias("key")).agg(F.min("near").alias("near"))
        spread = written(
            labels.join(least, "key").select("key", F.least("class", "near").alias("next")),
            "spread",
        )
        jump = spread.select(F.col("key").alias("next"), F.col("next").alias("far"))
        labels = written(
            spread.join(jump, "next", "left").select("key", F.coalesce("far", "next").alias("class")),
            "labels",
        )


def near_links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links between different texts, and their classes.

    Texts equal up to blanks are one text. In every bucket of every band each
    text meets the bucket's leaders: the smallest key and two by the order of a
    hash. Where a bucket then spans more than one class, members meet its hub,
    the text with the most links so far. What is left outside the largest class
    of a bucket meets every text of other classes in it (``_between_classes``),
    so no link between classes is missed. Only pairs that agree in half of
    their samples are compared in full. A group of n near copies costs about n
    comparisons, and n more for each text that does not join it.
    """
    idf = inverse_frequencies(docs)
    signed = written(
        _signatures(docs, idf)
        .groupBy("key")
        .agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "signatures",
    )
    members = signed.select("key", "sketch", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(members.join(shared.select("band"), "band"), "buckets")
    whole = F.struct("key", "sketch")

    def ends(turn: int) -> list[Column]:
        order = F.xxhash64("key", F.lit(turn))
        return [F.min_by(whole, order).alias("x"), F.max_by(whole, order).alias("y")]

    lead = members.groupBy("band").agg(F.min_by(whole, "key").alias("least"), *ends(0))
    pairs = written(
        _candidates(
            members.join(lead, "band").withColumn("lead", F.explode(F.array("least", "x", "y")))
        ),
        "pairs",
    )
    involved = if_few(written(members.select("key").distinct(), "involved"))
    texts = written(
        docs.select(_copy_key().alias("key"), "text")
        .join(involved, "key", "left_semi")
        .groupBy("key")
        .agg(F.first("text").alias("text")),
        "near-texts",
    )
    links = written(_verified(pairs, texts, idf, similarity), "near-links")
    labels = components(links)
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    classed = _classed(members, labels).join(degree, "key", "left")
    hub = F.max_by(
        F.struct("key", "sketch", "class"),
        F.struct(F.coalesce("degree", F.lit(0)), F.xxhash64("key")),
    )
    lead = (
        classed.groupBy("band")
        .agg(hub.alias("lead"), F.min("class").alias("_low"), F.max("class").alias("_high"))
        .filter("_low <> _high")
    )
    apart = classed.join(lead, "band").filter("lead.class <> class")
    pairs = written(_candidates(apart).join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(written(_verified(pairs, texts, idf, similarity), "near-links"))
    labels = components(links)
    rest = written(
        _between_classes(_classed(members, labels), signed, texts, idf, similarity), "near-links"
    )
    if rest.isEmpty():
        return links, labels
    links = links.unionByName(rest)
    return links, components(links)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The class of each document: near-duplicates, joined through links.

    Two texts are linked when the weighted Jaccard similarity of their
    five-word shingles (case of ASCII aside; a shorter text is one shingle) is
    at least ``similarity``. Texts without words, null included, are one class.
    Repeated rows share a class; a null id counts but never names one. An empty
    table gives no rows; columns other than ``doc_id`` and ``text`` are not read.

    Returns ``doc_id, class_id`` (smallest id of the class), ``class_size``
    (documents), ``links_found`` (links of its text that were verified while
    classes were joined: enough to span the class, not all texts similar to it).
    """
    links, labels = near_links(docs, similarity)
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("links_found"))
    )
    known = written(labels.join(degree, "key", "left"), "classes")
    rows = docs.select(F.col("doc_id").alias("row_doc_id"), _copy_key().alias("key"))
    classed = written(
        rows.join(known, "key", "left").select(
            "row_doc_id",
            F.coalesce("class", "key").alias("class"),
            F.coalesce("links_found", F.lit(0)).cast("bigint").alias("links_found"),
        ),
        "near-rows",
    )
    sizes = classed.groupBy("class").agg(
        F.min("row_doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
    )
    return classed.join(sizes, "class").select(
        F.col("row_doc_id").alias("doc_id"), "class_id", "class_size", "links_found"
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all columns.

    The text with the smallest key stays, of its copies the one of the smallest
    id (null last), then of the smallest hash of all columns, so reruns agree. Texts
    without words are one class. An empty table gives no rows.
    """
    _, labels = near_links(docs, similarity)
    others = labels.filter("key <> class").select("key")
    rows = docs.select(
        whole_row(docs), _copy_key().alias("key"), F.col("doc_id").alias("id"), row_order(docs).alias("tie")
    )
    first = Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last(), "tie")
    return (
        rows.join(others, "key", "left_anti")
        .withColumn("place", F.row_number().over(first))
        .filter("place = 1")
        .select("row.*")
    )
