"""Personal data: base forms, and identifiers found through their contexts.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import text_or_empty, written

KINDS = ("email", "ip", "card", "phone")

# The base forms. Possessive quantifiers and looks behind change no match: they
# spare the search from starting again inside a run that has failed as a whole.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

#: An identifier is a word that is no base match and has a digit, an at sign, or
#: a dot, underscore or open bracket between letters.
TOKEN = (
    r"[^\x20\x09-\x0D]*(?:[0-9@]|(?<=\p{L})[._(\[{<](?=\p{L}))[^\x20\x09-\x0D]*"
)
#: Code points on either side in which the neighbouring word is sought first.
REACH = 80
#: Matches whose places are summed at a time.
CHUNK = 256
#: Different identifiers that a context must hold before it counts.
SUPPORT = 3
#: How much of a context's identifiers must be known for it to be trusted.
TRUST = 0.8
#: What a word of any shape must have to be of a kind: an inner mark, digits.
PLAUSIBLE = {
    "email": r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]",
    "ip": r"[0-9].*[.:]|[.:].*[0-9]",
    "card": r"(?:[0-9][^0-9]*+){3}",
    "phone": r"(?:[0-9][^0-9]*+){3}",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits; ``digits`` holds digits only."""

    def step(total: Column, digit: Column, i: Column) -> Column:
        doubled = digit * 2
        return F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(digit)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    each = F.filter(each, lambda c: c.isNotNull())
    terms = F.transform(each, lambda c, i: step(F.lit(0), c, i))
    return F.aggregate(terms, F.lit(0), lambda total, c: total + c) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(_IP)
    digits = _digits(match)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    return F.length(digits).between(10, 15)


def _matches(text: Column, form: str, contexts: bool = False) -> Column:
    """All matches of a form with their places, in code points.

    Splitting and extracting walk the same matches, so the pieces between them
    and their own lengths give the places, and with ``contexts`` also the hashes
    of the words that stand before and after each match (null where none does).
    """
    kind = "s:int,e:int,m:string" + (",before:string,after:string" if contexts else "")

    def pairs(found: Column, between: Column) -> Column:
        n = F.size(found)

        def pair(m: Column, b: Column) -> Column:
            return F.struct(m.alias("m"), F.length(b).alias("gap"), F.length(m).alias("n"))

        out = F.zip_with(found, F.slice(between, F.lit(1), n), pair)
        if contexts:
            # the neighbour is in the piece between, or is a match itself
            none = F.array(F.lit(""))
            earlier = F.zip_with(
                F.slice(between, F.lit(1), n),
                F.slice(F.concat(none, found), F.lit(1), n),
                lambda b, m: _hashed(F.coalesce(*_last_word(b), m)),
            )
            later = F.zip_with(
                F.slice(between, F.lit(2), n),
                F.slice(F.concat(F.slice(found, F.lit(2), n), none), F.lit(1), n),
                lambda b, m: _hashed(F.coalesce(*_first_word(b), m)),
            )
            out = F.zip_with(out, earlier, lambda p, w: p.withField("before", w))
            out = F.zip_with(out, later, lambda p, w: p.withField("after", w))
        return out

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + p["n"]
        words = [p[c].alias(c) for c in ("before", "after")] if contexts else []
        one = F.struct(start.alias("s"), end.alias("e"), p["m"].alias("m"), *words)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        one = F.struct(acc["at"].alias("at"), c["out"].alias("out"))
        return F.struct(
            (acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out")
        )

    def zero(element: str) -> Column:
        return F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{element}>").alias("out"))

    # appending to an array copies it: places are summed in chunks, then chunks
    def placed(ps: Column) -> Column:
        last = F.greatest(F.floor((F.size(ps) - 1) / CHUNK), F.lit(0)).cast("int")
        chunks = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.aggregate(
                F.slice(ps, i * CHUNK + 1, F.lit(CHUNK)), zero(f"struct<{kind}>"), add
            ),
        )
        offsets = F.aggregate(
            chunks, zero(f"struct<at:int,out:array<struct<{kind}>>>"), chunk, lambda acc: acc["out"]
        )
        return F.flatten(
            F.transform(
                offsets,
                lambda c: F.transform(
                    c["out"],
                    lambda x: x.withField("s", x["s"] + c["at"]).withField("e", x["e"] + c["at"]),
                ),
            )
        )

    return _once(
        F.regexp_extract_all(text, F.lit(form), F.lit(0)),
        lambda found: _once(
            F.split(text, form, -1), lambda between: _once(pairs(found, between), placed)
        ),
    )


def _word_or_null(text: Column, form: str) -> Column:
    word = F.regexp_extract(text, form, 1)
    return F.when(word != "", word)


def _last_word(piece: Column) -> list[Column]:
    """The whole word that ends a piece, sought near its end and then in all of it."""
    return [
        _word_or_null(F.substring(piece, -REACH, REACH), r"[\x20\x09-\x0D]([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$"),
        _word_or_null(piece, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++$"),
    ]


def _first_word(piece: Column) -> list[Column]:
    return [_word_or_null(piece, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]++)")]


def _hashed(word: Column) -> Column:
    return F.when(word != "", F.md5(F.lower(word).cast("binary")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), use), 1)


def base_spans(docs: DataFrame) -> DataFrame:
    """Add one array of matches (``s, e, m``) per kind."""
    text = text_or_empty()

    def kept(kind: str) -> Column:
        return F.filter(_matches(text, FORMS[kind]), lambda x: _valid(kind, x["m"]))

    return docs.withColumns({f"_{kind}": kept(kind) for kind in KINDS})


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined with commas."""
    ordered = F.array_sort(spans)
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            ordered,
            lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"]),
        ),
        ",",
    )


def _all_base() -> Column:
    def of(i: int, kind: str) -> Column:
        return F.transform(
            f"_{kind}",
            lambda x: F.struct(
                x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), x["m"].alias("m")
            ),
        )

    return F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)])


def _shape(token: Column) -> Column:
    """A word with runs of digits as 9 and runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(token, r"[0-9]+", "9"), r"\p{L}+", "a")


def _patterns(item: Column, before: Column, after: Column) -> Column:
    """What may tell the kind of a word, each on its own: the word before it, the
    word after it, how it begins and ends up to a mark, and all of its place with
    its shape."""
    begins = F.regexp_extract(item, r"^([^\p{L}\p{N}]*[\p{L}\p{N}]*[^\p{L}\p{N}]+)", 1)
    ends = F.regexp_extract(
        item, r"(?:(?<=[\p{L}\p{N}])|^)([^\p{L}\p{N}]++[\p{L}\p{N}]++)[^\p{L}\p{N}]*+$", 1
    )
    place = F.when(
        before.isNotNull() | after.isNotNull(),
        F.concat_ws("\u0001", F.coalesce(before, F.lit("")), F.coalesce(after, F.lit("")), _shape(item)),
    )
    parts = {
        "b": before,
        "a": after,
        "p": F.when(begins != "", F.lower(begins)),
        "s": F.when(ends != "", F.lower(ends)),
        "w": place,
    }
    marked = [F.md5(F.concat(F.lit(f"{name}:"), part).cast("binary")) for name, part in parts.items()]
    return F.filter(F.array(*marked), lambda c: c.isNotNull())


def mentions(spanned: DataFrame) -> DataFrame:
    """Words that look like identifiers, with their patterns.

    Returns ``text_key, s, e, item, k`` (kind, null if no base match lies in the
    word) and ``contexts``, the hashes of its ``_patterns``. The item of a word
    that holds a part of a base match is the whole match, so a match with blanks
    is one item with the patterns of all its words.
    """
    word = rf"(?:(?<=^)|(?<=[\x20\x09-\x0D])){TOKEN}"
    found = spanned.select(
        "text_key",
        F.col("_base"),
        F.explode(_matches(text_or_empty(), word, contexts=True)).alias("x"),
    )
    inside = F.filter("_base", lambda b: (b["s"] < F.col("x.e")) & (b["e"] > F.col("x.s")))
    first = F.when(F.size("_in") > 0, F.element_at("_in", 1))
    return found.withColumn("_in", inside).select(
        "text_key",
        F.col("x.s").alias("s"),
        F.col("x.e").alias("e"),
        F.coalesce(first["m"], F.col("x.m")).alias("item"),
        first["k"].alias("k"),
        _patterns(F.col("x.m"), F.col("x.before"), F.col("x.after")).alias("contexts"),
    )


def _plausible(item: Column, k: Column) -> Column:
    """The weak check of a word's own shape."""
    fits = F.lit(False)
    for i, kind in enumerate(KINDS):
        fits = F.when(k == i, item.rlike(PLAUSIBLE[kind])).otherwise(fits)
    return fits


def learned(found: DataFrame, support: int, trust: float) -> DataFrame:
    """Items accepted by bootstrapping over the graph of patterns and items.

    Items inside base matches are the seeds, of score 1. A pattern's score for a
    kind is the mean score of its different items (0 for those not known), if it
    has ``support`` of them; an item's is the best of its patterns'. Patterns
    that reach ``trust`` accept their items that are plausible for the kind,
    which are seeds of the next round, until a round accepts none; each round
    but the last takes one item at least, so they end. All steps are
    aggregations over different (pattern, item) pairs, so copies count once.
    Returns ``item, k`` of items outside the seeds.
    """
    edges = written(
        found.select(F.explode("contexts").alias("context"), "item", "k")
        .groupBy("context", "item")
        .agg(F.min("k").alias("k")),
        "pii-edges",
    )
    seeds = edges.filter("k is not null").groupBy("item").agg(F.min("k").alias("k")).withColumn(
        "score", F.lit(1.0)
    )
    fresh = known = written(seeds, "pii-known")
    # a pattern with fewer items never counts
    width = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    edges = written(edges.drop("k").join(width, "context"), "pii-edges")
    sums = None
    while True:
        gained = (
            edges.join(fresh, "item").groupBy("context", "k", "n").agg(F.sum("score").alias("got"))
        )
        if sums is not None:
            gained = (
                sums.unionByName(gained).groupBy("context", "k", "n").agg(F.sum("got").alias("got"))
            )
        sums = written(gained, "pii-sums")
        scored = (
            sums.withColumn("score", F.col("got") / F.col("n"))
            .filter(F.col("score") >= trust)
            .groupBy("context")
            .agg(F.max(F.struct("score", "k")).alias("b"))
            .select("context", "b.score", "b.k")
        )
        grown = (
            edges.join(scored, "context")
            .filter(_plausible(F.col("item"), F.col("k")))
            .groupBy("item")
            .agg(F.max(F.struct("score", "k")).alias("b"))
            .select("item", "b.k", "b.score")
        )
        fresh = written(grown.join(known, "item", "left_anti"), "pii-known")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known.join(seeds.select("item"), "item", "left_anti").select("item", "k")


def find_pii(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """Personal data in each document.

    Base forms are matched per kind, leftmost and not overlapping; those that
    fail their check are dropped. Words accepted by ``learned`` add spans of
    their kind where no base match of any kind lies. Null counts as an empty
    text. Rows with equal texts get equal spans. An empty table gives no rows;
    columns other than ``doc_id`` and ``text`` are not read.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_found``; counts and the hash are of base matches, ``n_found`` of the rest.
    """
    spanned = (
        base_spans(docs.select("doc_id", "text"))
        .withColumn("text_key", F.md5(text_or_empty().cast("binary")))
        .withColumn("_base", _all_base())
    )
    found = written(mentions(spanned).distinct(), "pii-mentions")
    more = (
        found.filter("k is null")
        .drop("k")
        .join(learned(found, support, trust), "item")
        .groupBy("text_key")
        .agg(
            F.collect_set(
                F.struct(F.col("s"), F.col("k"), F.col("e"), F.lit("").alias("m"))
            ).alias("_more")
        )
    )
    rows = spanned.select(
        F.col("doc_id").alias("row_doc_id"),
        "text_key",
        *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        "_base",
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")
    return (
        rows.join(more, "text_key", "left")
        .withColumn("_more", F.coalesce("_more", none))
        .select(
            F.col("row_doc_id").alias("doc_id"),
            *[f"n_{k}" for k in KINDS],
            F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
            _joined(F.concat("_base", "_more")).alias("spans"),
            F.size("_more").cast("bigint").alias("n_found"),
        )
    )
