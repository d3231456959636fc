"""Language identification of mixed-language text: word scores and Viterbi."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import slices, written

UNKNOWN = "und"
#: Documents per language that the scores are learned from, at most. Those of
#: the smallest hash are taken; further documents hardly change the scores.
SAMPLE_DOCS = 1_000
#: Character n-grams kept per language, by count.
KEPT_GRAMS = 20_000
#: What a change of language between two words costs, in log probability.
SWITCH = 8.0
#: A language must have written this share of its letters in a script.
SCRIPT_SHARE = 0.001
#: A longer word is cut into words of so many letters and marks, each scored.
WORD_LETTERS = 24
#: The same in scripts that put no blanks between words.
RUN_LETTERS = 4

#: Different words scored at a time.
SCORED = 1 << 15

# fixed values: first and last code point of each script's letters, from the
# public Unicode charts
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
# fixed values: scripts without blanks between words (Lao, Myanmar, Khmer, too)
UNSPACED = [
    *SCRIPTS["han"], *SCRIPTS["kana"], *SCRIPTS["thai"],
    (0xE80, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF),
]


def _ranges(points: list[int]) -> str:
    """Code points, in order, as ranges of a character class."""
    out, start = [], None
    for here, after in zip(points, [*points[1:], None]):
        start = here if start is None else start
        if after != here + 1:
            out.append(f"\\U{start:08x}-\\U{here:08x}")
            start = None
    return "".join(out)


def grams(word: str) -> list[str]:
    """The n-grams of 1 to 3 characters of a word between blanks."""
    padded = f" {word} "
    return [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]


def script_table() -> np.ndarray:
    """The bit of the script of each code point; bit 0 is any other."""
    table = np.ones(0x30000, np.uint32)
    for i, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            table[low : high + 1] = 1 << (i + 1)
    return table


_SCRIPTS = script_table()


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def patterns() -> tuple[re.Pattern, np.ndarray]:
    """A letter (categories L) and the letters and marks (M) after it, cut as said
    above; and for each code point whether ``_PLAIN`` may be wrong about it."""
    letters, marks, numbers = [], [], []
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] in "LM":
            (letters if kind[0] == "L" else marks).append(point)
        elif kind in ("No", "Nl"):
            numbers.append(point)
    run = {p for low, high in UNSPACED for p in range(low, high + 1)}
    spaced, unspaced = ([p for p in letters if (p in run) is u] for u in (False, True))
    mark = _ranges(marks)
    odd = np.zeros(0x110000, bool)
    odd[[*marks, *numbers, *unspaced]] = True
    return (
        re.compile(
            f"[{_ranges(spaced)}][{_ranges(spaced)}{mark}]{{0,{WORD_LETTERS - 1}}}"
            f"|[{_ranges(unspaced)}][{_ranges(unspaced)}{mark}]{{0,{RUN_LETTERS - 1}}}"
        ),
        odd,
    )


_WORD, _ODD = patterns()
#: The same words, found faster, where no word is long and no character odd.
_PLAIN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    if text.isascii() or not _ODD[points_of(text)].any():
        words = _PLAIN.findall(text)
        if not words or max(map(len, words)) <= WORD_LETTERS:
            return words
    return _WORD.findall(text)


def gram_key(gram: str) -> int:
    """Up to three code points of 21 bits each."""
    return sum(ord(c) << (21 * i) for i, c in enumerate(gram))


@dataclass(frozen=True)
class Model:
    """Log probabilities of n-grams per language, and the scripts of a language.

    ``keys`` are n-grams in order; ``scores`` has a row for each and a last one
    for n-grams never seen. ``scripts`` are bits.
    """

    languages: tuple[str, ...]
    keys: np.ndarray
    scores: np.ndarray
    scripts: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """Mean log probability of each word's n-grams, times its letters and marks; very
        low for languages not written in any script of the word."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)))
        words = [w.lower() for w in words]
        text = points_of(" " + " ".join(words) + " ").astype(np.uint64)
        n = len(text)
        space = np.flatnonzero(text == 32)
        begin, sizes = space[:-1], np.diff(space)  # a word and the blank before it
        total = np.zeros((len(words), len(self.languages)), np.float32)
        key = np.zeros(n, np.uint64)
        for i in range(3):
            key[: n - i] |= text[i:] << np.uint64(21 * i)
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            at[self.keys[at] != key] = len(self.keys)
            own = self.scores[at]
            if i == 2:  # a trigram that starts at the last letter is of the next word
                own[space[1:] - 1] = 0
            total += np.add.reduceat(own, begin, axis=0)[: len(words)]
        letters = sizes - 1
        total *= (letters / (3 * sizes - 1))[:, None]
        low = np.minimum(text, len(_SCRIPTS) - 1).astype(np.int64)
        used = _SCRIPTS[low]
        used[space] = 0
        used = np.bitwise_or.reduceat(used, begin)[: len(words)]
        fits = (used[:, None] & self.scripts[None, :]) != 0
        fits |= ~fits.any(axis=1)[:, None]
        return np.where(fits, total, np.float32(-1e4))


def held_out() -> Column:
    """Whether a document is never learned from; false for a null id."""
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(digest % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, kept_grams: int = KEPT_GRAMS) -> Model:
    """Count n-grams of labelled documents, at most ``sample_docs`` texts per language.

    The sample are the different texts of a language that come first by hash, each
    once: copies neither crowd others out nor count again, and no language is
    without a text. What comes back to the driver is ``kept_grams`` rows per
    language.
    """
    labelled = docs.filter(
        ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("lang", "text", F.xxhash64("text").alias("_place"))
    # hashes below which a few more than sample_docs texts of a language lie (ten
    # deviations and 50), then the hash up to which its sample goes
    texts = written(labelled.select("lang", "_place").distinct(), "places")
    enough = float(sample_docs + 10 * sample_docs**0.5 + 50)
    share = F.least(F.lit(1.0), F.lit(enough) / F.col("_n")) * F.lit(2.0**64)
    low = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).select(
        "lang", (F.lit(-(2.0**63)) + share).alias("_low")
    )
    first = Window.partitionBy("lang").orderBy("_place")
    edges = (
        texts.join(F.broadcast(low), "lang")  # a row per language
        .filter(F.col("_place").cast("double") <= F.col("_low"))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= sample_docs)
        .groupBy("lang")
        .agg(F.max("_place").alias("_edge"))
    )
    sample = (
        labelled.join(written(edges, "edges"), "lang")
        .filter(F.col("_place") <= F.col("_edge"))
        .dropDuplicates(["lang", "_place"])
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
        found: Counter = Counter()
        for lang, counted in words.items():
            for word, n in counted.items():
                for gram in grams(word):
                    found["g", lang, gram] += n
                for letter in word:
                    found["s", lang, letter] += n
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.string()) for c in columns], pa.array(list(found.values()), pa.int64())],
            ["kind", "lang", "item", "n"],
        )

    counts = written(
        sample.select("lang", "text")
        .mapInArrow(count, "kind string, lang string, item string, n bigint")
        .groupBy("kind", "lang", "item")
        .agg(F.sum("n").alias("n")),
        "grams",
    )
    top = Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "item")
    rows = (
        counts.withColumn("place", F.row_number().over(top))
        .filter(F.col("place") <= kept_grams)
        .select("kind", "lang", "item", "n")
        .collect()
    )
    return model_of([tuple(r) for r in rows])


def model_of(rows: list[tuple[str, str, str, int]]) -> Model:
    languages = tuple(sorted({r[1] for r in rows}))
    at = {lang: i for i, lang in enumerate(languages)}
    keys = np.unique(np.array([gram_key(r[2]) for r in rows if r[0] == "g"], np.uint64))
    counts = np.zeros((len(keys) + 1, len(languages)))
    letters: dict[int, np.ndarray] = {}
    for kind, lang, item, n in rows:
        if kind == "g":
            counts[np.searchsorted(keys, np.uint64(gram_key(item))), at[lang]] += n
        else:
            bit = int(_SCRIPTS[min(ord(item), len(_SCRIPTS) - 1)])
            letters.setdefault(bit, np.zeros(len(languages)))[at[lang]] += n
    scores = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + len(keys) + 1)
    every = sum(letters.values(), np.zeros(len(languages)))
    scripts = np.zeros(len(languages), np.uint32)
    for bit, n in letters.items():
        scripts[n >= SCRIPT_SHARE * np.maximum(every, 1)] |= np.uint32(bit)
    return Model(languages, keys, scores.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word of many texts at once.

    ``scores`` has a row per word, texts one after another; ``starts`` where
    each begins. One step handles the t-th word of every text.
    """
    n_texts, n_langs = len(starts) - 1, scores.shape[1]
    path = np.zeros(len(scores), np.int32)
    if not len(scores) or not n_langs:
        return path
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[:-1][order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than t
    from_best = np.zeros(len(scores), np.int16)
    stays = np.zeros(scores.shape, bool)
    value = np.zeros((n_texts, n_langs))
    for t in range(int(lengths[0])):
        k = alive[t]
        at = first[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(axis=1)
            high = v[np.arange(k), best] - switch
            keep = v >= high[:, None]
            stays[at] = keep
            from_best[at] = best
            v = np.where(keep, v, high[:, None])
            v -= high[:, None]
        value[:k] = v + scores[at]
    last = np.zeros(n_texts, np.int64)
    last[:] = value.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        path[at] = last[:k]
        if t:
            kept = stays[at, last[:k]]
            last[:k] = np.where(kept, last[:k], from_best[at])
    return path


def label_words(texts: list[str | None], model: Model) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The words of the texts, where each text's begin, and their languages."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    words = [words_of(t or "") for t in texts]
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64)
    known.default_factory = None  # else the words refer to themselves and stay in memory
    different = list(known)
    scores = [model.score(different[i : i + SCORED]) for i in range(0, len(different), SCORED)]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    scores = np.concatenate(scores or [model.score([])])
    return words, starts, viterbi(scores[ids], starts)


def letters_by_language(texts: list[str | None], model: Model) -> np.ndarray:
    """Letters labelled with each language (columns) in each text."""
    words, starts, path = label_words(texts, model)
    n = max(1, len(model.languages))
    sizes = np.array(list(map(len, chain.from_iterable(words))), np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    return np.bincount(owner * n + path, sizes, len(texts) * n).reshape(len(texts), n)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The language of each document: that of most letters after labelling spans.

    Each word is scored by the languages that its script allows; Viterbi with a
    penalty for each change labels the words, so a text may hold several
    languages. ``score`` is the share of its letters in ``lang_pred``; ties go
    to the first name. ``und`` with score 0 where the text is null or has no
    letter, or nothing was learned. An empty table gives no rows.

    Returns ``row_doc_id, lang_pred, score``.
    """
    names = list(model.languages)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            letters = letters_by_language(batch.column(1).to_pylist(), model)
            every = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            some = (every > 0) & bool(names)
            share = letters.max(axis=1) / np.maximum(every, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([names[b] if s else UNKNOWN for b, s in zip(best, some)], pa.string()),
                    pa.array(np.where(some, share, 0.0)),
                ],
                ["row_doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        predict, f"row_doc_id {kind}, lang_pred string, score double"
    )


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """The maximal runs of one language: ``row_doc_id, start, end, lang`` in code
    points, from the first to the last word of the run."""
    names = list(model.languages)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            _, starts, path = label_words(texts, model)
            out: list[tuple] = []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), texts)):
                if not names:
                    break
                own = path[starts[i] : starts[i + 1]]
                run: list | None = None
                for m, lang in zip(_WORD.finditer(text or ""), own):
                    if run and run[3] == lang:
                        run[2] = m.end()
                    else:
                        if run:
                            out.append((run[0], run[1], run[2], names[run[3]]))
                        run = [doc_id, m.start(), m.end(), lang]
                if run:
                    out.append((run[0], run[1], run[2], names[run[3]]))
            ids, begin, end, lang = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(begin, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(lang, pa.string())],
                ["row_doc_id", "start", "end", "lang"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        label, f"row_doc_id {kind}, start bigint, end bigint, lang string"
    )


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then identify all.

    Returns ``doc_id, held_out, lang_pred, score``.
    """
    found = identify(docs, train(docs)).withColumnRenamed("row_doc_id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, whole, whose language is found and has at least ``least``
    of the letters.

    Null texts and texts without a letter go. Where nothing is labelled no language
    can be told from another, and every document with a letter stays. Repeated rows
    stay or go alike; an empty table gives no rows.
    """
    model = train(docs)
    known = bool(model.languages)

    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            letters = letters_by_language(batch.column(at).to_pylist(), model)
            every = letters.sum(axis=1)
            ok = (every > 0) & ((not known) | (letters.max(axis=1) >= least * every))
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
