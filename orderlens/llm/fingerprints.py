"""Document fingerprints: consistent weighted sampling with gamma variables.

Everything here is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from orderlens.llm.common import text_or_empty

SAMPLES = 48
#: Levels of the tables of gamma variables, a power of two.
LEVELS = 1 << 10
#: Bits of a sample that the fingerprint keeps.
SAMPLE_BITS = 24
#: Texts are dealt by ranges of ids, which hold this many bytes each; more where
#: that would be more than COARSE * FINE ranges.
RANGE_BYTES = 4 << 20
COARSE, FINE = 200, 500


def gamma_levels(n: int) -> list[float]:
    """Gamma(2, 1) at the middles of n equal shares, by halving intervals."""
    out, low = [], 0.0
    for i in range(n):
        share, high = (i + 0.5) / n, 60.0
        at = low
        for _ in range(60):
            middle = (at + high) / 2
            if 1 - math.exp(-middle) * (1 + middle) < share:
                at = middle
            else:
                high = middle
        low = at
        out.append(at)
    return out


def _table(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _sample(k: int, rates: Column, logs: Column) -> Column:
    """The k-th sample of a term of log weight ``lw``, so that the least over all
    terms is the document's: its order above, the sample itself below."""
    bits = F.xxhash64("term", F.lit(k))
    # every place is in the tables; saying so spares the checks for null from here on
    r = F.coalesce(F.get(rates, F.shiftrightunsigned(bits, 54)), F.lit(1.0))
    place = F.shiftrightunsigned(bits, 44).bitwiseAND(LEVELS - 1)
    log_c = F.coalesce(F.get(logs, place), F.lit(0.0))
    beta = bits.bitwiseAND((1 << 24) - 1).cast("double") * (2.0**-24)
    t = F.floor(F.col("lw") / r + beta)
    order = F.floor((log_c - r * (t - beta) - r + 64.0) * float(1 << 31))
    own = bits.bitwiseXOR(t).bitwiseAND((1 << SAMPLE_BITS) - 1)
    return F.shiftleft(order, SAMPLE_BITS).bitwiseOR(own)


def _terms(text: Column) -> Column:
    """The hashes of all words, in order of hash."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _with_runs(df: DataFrame, body: str, name: str) -> DataFrame:
    """The different words of ``body``: an array ``name`` of ``term`` and ``n``.

    Words are sorted as hashes inside the row and counted by their runs.
    """
    terms, ends = f"{name}_terms", f"{name}_ends"
    last = F.filter(
        F.transform(
            terms,
            lambda h, i: F.when((i + 1 == F.size(terms)) | (F.get(terms, i + 1) != h), i),
        ),
        lambda i: i.isNotNull(),
    )
    runs = F.transform(
        ends,
        lambda e, i: F.struct(
            F.get(terms, e).alias("term"),
            (e - F.coalesce(F.get(ends, F.when(i > 0, i - 1)), F.lit(-1))).alias("n"),
        ),
    )
    return (
        df.withColumn(terms, _terms(F.col(body)))
        .withColumn(ends, last)
        .withColumn(name, runs)
        .drop(terms, ends)
    )


#: Where a term stands: in the text, in the edited text, or once in each.
OWN, OTHER, BOTH = 0, 1, 2


def weighted_terms(df: DataFrame, *carried: str) -> DataFrame:
    """A row per different word of ``text`` and of ``edited``: ``which``, ``term``, ``n``.

    A word that is once in each is one row of ``which`` BOTH, so that its samples,
    which are the same for both, are drawn once. A row without words in either
    is one row of nulls; a null text has no words.
    """

    def single(runs: str) -> Column:
        return F.transform(F.filter(runs, lambda x: x["n"] == 1), lambda x: x["term"])

    def row(which: int, term: Column, n: Column) -> Column:
        return F.struct(F.lit(which).alias("which"), term.alias("term"), n.alias("n"))

    def ones(which: int, terms: Column) -> Column:
        return F.transform(terms, lambda t: row(which, t, F.lit(1)))

    def more(which: int, runs: str) -> Column:
        many = F.filter(runs, lambda x: x["n"] > 1)
        return F.transform(many, lambda x: row(which, x["term"], x["n"]))

    found = df
    for body, name in (("text", "_own"), ("edited", "_other")):
        body_or_empty = found.withColumn(f"{name}_body", text_or_empty(body))
        found = _with_runs(body_or_empty, f"{name}_body", name).drop(f"{name}_body")
        found = found.withColumn(f"{name}_ones", single(name))
    rows = F.concat(
        ones(BOTH, F.array_intersect("_own_ones", "_other_ones")),
        ones(OWN, F.array_except("_own_ones", "_other_ones")),
        ones(OTHER, F.array_except("_other_ones", "_own_ones")),
        more(OWN, "_own"),
        more(OTHER, "_other"),
    )
    return found.select(*carried, F.explode_outer(rows).alias("x")).select(
        *carried, "x.which", "x.term", "x.n"
    )


def least_samples(terms: DataFrame, *keys: str, samples: int = SAMPLES) -> DataFrame:
    """The least consistent weighted samples of each key: an array ``least``.

    For a term of weight w, gamma variables r and c and a uniform beta, all
    drawn from the term's hash, t = floor(ln w / r + beta), and ln a = ln c -
    r (t - beta) - r; the term of least a, with its t, is the sample. Two texts
    agree in a sample with the probability of their generalised Jaccard
    similarity. The gamma variables come from tables of their quantiles. All
    samples are taken in one aggregation. Terms are not null.
    """
    levels = gamma_levels(LEVELS)
    rates, logs = _table(levels), _table([math.log(x) for x in levels])
    # A step that Spark fuses becomes one method, and with all samples in it the
    # method is too long for the JVM to compile. A higher-order function keeps
    # this step from being fused, so that each sample gets a method of its own.
    *first, last = keys
    apart = F.element_at(F.transform(F.array(last), lambda x: x), 1).alias(last)
    weighed = terms.withColumn("lw", F.coalesce(F.log(F.col("n").cast("double")), F.lit(0.0)))
    weighed = weighed.withColumn("term", F.coalesce("term", F.lit(0)))
    drawn = weighed.select(
        *first, apart, F.array(*[_sample(k, rates, logs) for k in range(samples)]).alias("drawn")
    )
    least = drawn.groupBy(*keys).agg(
        *[F.min(F.get("drawn", F.lit(k))).alias(f"v{k}") for k in range(samples)]
    )
    return least.select(*keys, F.array(*[f"v{k}" for k in range(samples)]).alias("least"))


def united(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The fingerprint of a text from the least samples of two parts of its terms.

    A part without terms is null; without any term all samples are 0.
    """
    least = F.zip_with(F.coalesce(a, b), F.coalesce(b, a), lambda x, y: F.least(x, y))
    low = F.transform(least, lambda x: x.bitwiseAND((1 << SAMPLE_BITS) - 1).cast("int"))
    return F.coalesce(low, F.array_repeat(F.lit(0), samples))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints agree."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(a).cast("double")


def printed(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), SAMPLE_BITS // 4, "0")), "")


def in_ranges(docs: DataFrame) -> DataFrame:
    """Rows by descending id: ``part`` numbers ranges of ids, and the first rows
    of a range stand once more, as ``guest``, at the end of the range before.

    So the next document of every row lies in its own range, and only there;
    the last range ends with the first rows of all. The ranges are cut at
    quantiles and evenly between them; null ids are the last range.
    """
    steps = [(i + 1) / COARSE for i in range(COARSE - 1)]
    seen = docs.agg(
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
        F.percentile_approx("doc_id", steps, 10 * COARSE).alias("cuts"),
        F.sum(F.octet_length(text_or_empty())).alias("bytes"),
    ).first()
    low, high = seen["low"], seen["high"]
    fine = max(1, min(FINE, -(-(seen["bytes"] or 0) // (RANGE_BYTES * COARSE))))
    cuts = sorted({c for c in seen["cuts"] or [] if low < c <= high})
    edges = [low, *cuts, high + 1] if low is not None else [0, 1]
    table = F.array(*[F.lit(e).cast("bigint") for e in edges])
    last = len(edges) - 2
    # the coarse range is the number of cuts at or below the id
    below = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    coarse = F.size(F.filter(below, lambda c: c <= F.col("doc_id")))
    placed = docs.withColumn("_coarse", coarse)
    begin = F.get(table, F.col("_coarse"))
    width = F.get(table, F.col("_coarse") + 1) - begin
    inner = F.floor((F.col("doc_id") - begin) * F.lit(float(fine)) / width)
    part = (F.lit(last) - F.col("_coarse")) * fine + (fine - 1 - inner)
    placed = placed.withColumn(
        "part",
        F.when(F.col("doc_id").isNull(), F.lit((last + 1) * fine)).otherwise(part).cast("bigint"),
    ).drop("_coarse")
    # at most COARSE * FINE + 1 rows, so this window and broadcast are bounded
    order = Window.orderBy("part")
    heads = (
        placed.groupBy("part")
        .agg(F.max("doc_id").alias("_head"))
        .withColumn("_before", F.lag("part").over(order))
        .withColumn("_before", F.coalesce("_before", F.max("part").over(Window.partitionBy())))
        .select(F.col("part").alias("_part"), "_head", "_before")
    )
    guests = (
        placed.join(
            F.broadcast(heads),
            (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_head")),
        )
        .withColumn("part", F.col("_before"))
        .drop("_part", "_head", "_before")
        .withColumn("guest", F.lit(True))
    )
    return placed.withColumn("guest", F.lit(False)).unionByName(guests)


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint each text and its edited text, and compare.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document, by descending id, null ids last and
    equal ids by the hash of the text; the last document takes from the first.
    Texts are moved once, by range of ids; terms, samples and comparisons stay
    in that partitioning. Null counts as an empty text; repeated rows count as
    documents; a table of one document is its own next. Ids are
    integers; others are refused, as they have another order. An empty table gives
    no rows; columns other than ``doc_id`` and ``text`` are not read.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id must be an integer")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = in_ranges(rows).withColumn("_tie", F.md5(F.col("text").cast("binary")))
    order = Window.partitionBy("part").orderBy(
        "guest", F.col("doc_id").desc_nulls_last(), "_tie"
    )
    n = F.char_length("text")
    edited = F.concat(
        F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 2) as int))"),
        F.expr("substring(next, 1, cast(floor(n_chars / 2) as int))"),
    )
    bodies = (
        rows.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
        .withColumn("n_chars", n)
        .withColumn("edited", edited)
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
        .withColumn("row", F.monotonically_increasing_id())
    )
    keys = ("part", "row", "guest", "doc_id", "_tie", "n_chars", "edited_sha256")
    # of a guest only the text is asked for
    asked = bodies.withColumn("edited", F.when(~F.col("guest"), F.col("edited")))
    signed = least_samples(weighted_terms(asked, *keys), *keys, "which", samples=samples)
    parts = signed.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("which") == which, F.col("least"))).alias(f"_{which}")
            for which in (OWN, OTHER, BOTH)
        ]
    )
    paired = parts.select(
        *keys,
        united(F.col(f"_{OWN}"), F.col(f"_{BOTH}"), samples).alias("own"),
        united(F.col(f"_{OTHER}"), F.col(f"_{BOTH}"), samples).alias("other"),
    )
    return (
        paired.withColumn("next", F.lead("own").over(order))
        .filter(~F.col("guest"))
        .select(
            "doc_id",
            F.col("n_chars").cast("bigint").alias("n_chars"),
            "edited_sha256",
            printed(F.col("own")).alias("fingerprint"),
            printed(F.col("other")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("other")).alias("near_edited"),
            likeness(F.col("own"), F.col("next")).alias("near_next"),
        )
    )
