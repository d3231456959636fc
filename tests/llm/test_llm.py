"""The document operators against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import (
    exact_dedup,
    fingerprints,
    language,
    license_scan,
    mixing,
    near_dedup,
    packing,
    pii,
    sharding,
    suffix_dedup,
)
from orderlens.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choices("abdelnorst", k=rng.randint(2, 7))) for _ in range(n))


def rows_of():
    """Nulls, empty and long texts, repeated rows, exact and near copies."""
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(1, 90)), "en", f"s{i % 3}", 0) for i in range(40)]
    long = words(rng, 3000)
    near = long.split()
    near[100] = "changed"
    rows += [
        (40, None, None, None, None),
        (41, "", "en", "", 0),
        (42, " \t\n", None, "s1", 0),
        (43, long, "en", "s0", 0),
        (44, " ".join(near), "en", "s0", 0),
        (45, long, "en", "s2", 0),
        (45, long, "en", "s2", 0),
        (46, long.replace(" ", "  "), "en", None, 0),
        (None, rows[3][1], None, None, 0),
        (47, "1234 5678", "de", "s1", 0),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # names that the operators use inside must not clash with extra columns
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("key", "code", "size", "row", "part", "class")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty):
    for operator in (
        mixing.mix,
        mixing.mixed_documents,
        suffix_dedup.without_repeats,
        license_scan.scan_licenses,
        fingerprints.fingerprint_edits,
        exact_dedup.exact_dedup,
        exact_dedup.without_copies,
        language.predict_languages,
        language.with_known_language,
        near_dedup.near_duplicates,
        near_dedup.one_of_each,
        packing.pack,
        pii.find_pii,
    ):
        assert operator(empty).count() == 0, operator.__name__
    assert sharding.assign_shards(empty, 10).count() == 0


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= len(own)
    assert sum(o[0].target for o in by.values()) == pytest.approx(
        1.5 * sum(r["size"] for r in rows)
    )
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(100):
        k = rng.choice([2, 3, 6])
        text = np.array([rng.randint(1, k) for _ in range(rng.randint(1, 50))] + [0])
        plain = text.tolist()
        sa = suffix_array(text, k + 1)
        want = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert sa.tolist() == want
        length, before = common_prefixes(text, sa)
        for a, b in zip(want, want[1:]):
            m = 0
            while plain[a + m : a + m + 1] and plain[a + m : a + m + 1] == plain[b + m : b + m + 1]:
                m += 1
            assert (before[b], length[b]) == (a, m)


@pytest.mark.parametrize("hot_bytes", [1 << 22, 10])
def test_repeats_are_removed(spark, hot_bytes):
    rng = random.Random(5)

    def some(n, letters="abc"):
        return "".join(rng.choices(letters, k=n))

    base = [some(60) for _ in range(4)]
    rows = [
        (1, None), (2, ""), (3, "a" * 90), (3, "x"), (4, base[0]), (5, base[0][:40] + base[1]),
        (6, base[1][10:] + base[2] + base[2][5:45]), (7, base[3]), (7, base[3]), (8, "ab" * 50),
        (None, base[0][5:50] + "é😀" * 12),
    ] + [(20 + i, some(9, "xyz") + base[2][3:40] + some(9, "xyz")) for i in range(20)]
    width = 20
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + width] for _, b in raw for j in range(len(b) - width + 1))
    want = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if seen[b[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        kept = bytes(x for x, m in zip(b, gone) if not m)
        runs = sum(m and not gone[k - 1] if k else m for k, m in enumerate(gone))
        want[i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = suffix_dedup.without_repeats(df, width=width, gram=6, hot_bytes=hot_bytes)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == want


def test_license_notices(spark):
    rng = random.Random(1)
    apache, gpl = license_scan.NOTICES["Apache-2.0"], license_scan.NOTICES["GPL-3.0"]
    rows = [(1, words(rng, 50) + " " + apache + " " + words(rng, 2000)), (2, gpl), (3, None), (4, ""),
            (5, words(rng, 300)), (6, gpl.upper() + " x " + gpl), (7, gpl.replace("work", "thing"))]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.license) for r in found.collect())
    assert got == {(1, "Apache-2.0"): 1, (2, "GPL-3.0"): 1, (6, "GPL-3.0"): 2}
    assert {r.start_word for r in found.filter("doc_id = 1").collect()} == {50}


def test_licenses_in_comments(spark):
    def wrapped(notice, mark):
        each = notice.split()
        return "\n".join(f"{mark} " + " ".join(each[i : i + 9]) for i in range(0, len(each), 9))

    headers = [n for n in license_scan.NOTICES if n.endswith(("header", "permission")) or n in ("BSD", "MPL-2.0")]
    marks = ["#", "//", " *", "--"]
    rows = [(i, wrapped(license_scan.NOTICES[n], marks[i % 4])) for i, n in enumerate(headers)]
    texts = ["GPL-2.0 text", "MIT text", "ISC text", "Unlicense text", "LGPL-2.1 text"]
    rows += [(100 + i, "x " * 90 + wrapped(license_scan.NOTICES[n], "#")) for i, n in enumerate(texts)]
    rows += [(200, "# Released under MIT License"), (201, "Released under the new license"),
             (202, "/* SPDX-License-Identifier: MIT OR Apache-2.0 */"), (203, "Released under the XYZ License.")]
    got = defaultdict(set)
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    for i, n in enumerate(headers):
        assert n in got[i], n
    assert not got[headers.index("LGPL-2.1 header")] & {"GPL-2.0 header", "LGPL-3.0 header"}
    for i, n in enumerate(texts):
        assert n in got[100 + i], n
    assert got[200] == {"MIT released line"} and not got[201] and not got[203]
    assert got[202] == {"SPDX MIT OR Apache-2.0"}


def test_fingerprints(docs):
    out = fingerprints.fingerprint_edits(docs).collect()
    rows = [(i, t or "") for i, t, *_ in rows_of()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want, exact = Counter(), {}
    for n, (i, text) in enumerate(rows):
        other = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want[i, len(text), sha] += 1
        a, b = Counter(WORDS.findall(text)), Counter(WORDS.findall(edited))
        total = sum((a | b).values())
        exact[i, sha] = sum((a & b).values()) / total if total else 1.0
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    error = [r.near_edited - exact[r.doc_id, r.edited_sha256] for r in out]
    assert abs(np.mean(error)) < 0.05 and np.std(error) < 0.12
    texts = defaultdict(set)
    for r in out:
        texts[r.doc_id].add(r.fingerprint)
    assert texts[43] == texts[45] and all(0 <= r.near_next <= 1 for r in out)


def test_words_once_in_both_texts_are_drawn_once(spark):
    rows = [(0, "a b c c", "b c d d d"), (1, "x", None), (2, None, None), (3, "y y", "y y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, edited string")
    got = defaultdict(Counter)
    for r in fingerprints.weighted_terms(df, "doc_id").collect():
        got[r.doc_id][r.which, r.n] += 1
    own, other, both = fingerprints.OWN, fingerprints.OTHER, fingerprints.BOTH
    assert got[0] == {(both, 1): 1, (own, 1): 1, (own, 2): 1, (other, 1): 1, (other, 3): 1}
    assert got[1] == {(own, 1): 1} and got[2] == {(None, None): 1}
    assert got[3] == {(own, 2): 1, (other, 2): 1}


def test_edited_text_has_the_fingerprint_of_an_equal_text(spark):
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(12)] + ["", "\t"]
    half = [
        t[: len(t) - len(t) // 2] + texts[(n + 1) % len(texts)][: len(t) // 2]
        for n, t in enumerate(texts)
    ]
    # the same order by descending id first; the edited texts are documents of their own below
    rows = [(1000 - n, t) for n, t in enumerate(texts)] + [(987 - len(texts), texts[0])]
    rows += [(100 - n, t) for n, t in enumerate(half)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    for n, t in enumerate(half):
        r = out[1000 - n]
        assert r.edited_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.edited_fingerprint == out[100 - n].fingerprint


def test_exact_dedup(docs):
    def normal(text):
        return re.sub(r"[\x20\x09-\x0D]", "", text or "")

    rows = [(i, t or "") for i, t, *_ in rows_of()]
    groups = defaultdict(list)
    for i, text in rows:
        groups[normal(text)].append((-len(text), i is None, i))
    want = Counter()
    for text, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for n, (_, _, i) in enumerate(members):
            sha = hashlib.sha256(text.encode()).hexdigest()
            want[i, members[0][2], len(members), n == 0, sha] += 1
    got = exact_dedup.exact_dedup(docs, bucket_bytes=500).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in want if k[3])


def test_language(spark):
    rng = random.Random(2)
    two = {"xx": "the and ing tion er".split(), "yy": "der und ung keit sch".split()}

    def text(lang, n):
        return " ".join("".join(rng.choices(two[lang], k=rng.randint(1, 3))) for _ in range(n))

    rows = [(i, text("xy"[i % 2] * 2, 40), "xy"[i % 2] * 2) for i in range(120)]
    rows += [(200, None, "xx"), (201, "12 ?!", "yy"), (202, text("xx", 40) + " " + text("yy", 10), None),
             (None, text("yy", 5), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.predict_languages(df).collect()}
    assert len(out) == len(rows)
    for i, _, lang in rows[:120]:
        assert out[i].lang_pred == lang and out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert (out[200].lang_pred, out[201].lang_pred) == ("und", "und")
    assert out[202].lang_pred == "xx" and 0.6 < out[202].score < 0.95
    assert out[None].lang_pred == "yy" and not out[None].held_out
    model = language.train(df)
    mixed = language.spans(df.filter("doc_id = 202"), model).orderBy("start").collect()
    assert [r.lang for r in mixed] == ["xx", "yy"]
    kept = {r.doc_id for r in language.with_known_language(df).collect()}
    assert kept == set(out) - {200, 201}


def test_letters_of_every_script(spark):
    words_ = language.words_of
    assert words_("½ ² Ⅳ 12 _ ?!") == []
    assert words_("नमस्ते हिन्दी") == ["नमस्ते", "हिन्दी"]
    assert words_("日本語テキスト漢字") == ["日本語テ", "キスト漢", "字"]
    assert words_("b" * 60) == ["b" * 24, "b" * 24, "b" * 12]
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("abé ½²_ः日字x̂ก1.\n", k=rng.randint(0, 60))) + "q" * rng.choice([0, 0, 30])
        assert words_(text) == language._WORD.findall(text)
    rows = [(1, "½ ² ③", "xx"), (2, "अआइ " * 20, "hi"), (3, "the and " * 20, "en"), (4, "ा ि", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.withColumn("doc_id", no_id()))
    assert set(model.languages) == {"hi", "en"}
    found = {r.row_doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    assert found == {1: "und", 2: "hi", 3: "en", 4: "und"}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(8)
    lengths = [0, 1, 5, 3, 0, 4]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for _ in range(40):
        scores = rng.normal(0, 3, (starts[-1], 3))
        path = language.viterbi(scores, starts, 2.0)
        for i, j in zip(starts, starts[1:]):
            def worth(p):
                return scores[np.arange(i, j), list(p)].sum() - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

            best = max((worth(p) for p in itertools.product(range(3), repeat=int(j - i))))
            assert worth(tuple(path[i:j])) == pytest.approx(best)


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "some words", None), (2, "12", None), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in language.with_known_language(df).collect()] == [1]
    assert {r.lang_pred for r in language.predict_languages(df).collect()} == {"und"}


HELPERS = (
    "row", "code", "times", "sha", "chars", "id", "tie", "place", "key", "best_id", "_most", "_sha", "_row",
    "_text", "_times", "_copy", "_edge", "_place", "_low", "_n", "_rank", "n_bytes", "depth", "prefix", "_code",
    "_size", "n_chars_", "class", "_key",
)


def test_helper_names_as_columns(spark, tmp_path):
    """Whole rows come back with their own values, whatever their columns are called."""
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(12)]
    rows = [(i, base[i % 12], "en" if i % 2 else "fr", f"s{i % 2}", i) for i in range(30)]
    rows += [(30, base[0].replace(" ", "  "), "en", "s0", 30), (None, base[1], "en", None, 31)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars_", F.col("n_chars"))
    df = df.withColumns({c: F.concat(F.lit(c), F.col("n_chars")) for c in HELPERS if c != "n_chars_"})
    for operator in (
        mixing.mixed_documents, exact_dedup.without_copies, language.with_known_language, near_dedup.one_of_each
    ):
        out = operator(df)
        assert out.columns == df.columns, operator.__name__
        got = out.collect()
        assert got
        for r in got:
            assert rows[r.n_chars][:2] == (r.doc_id, r.text)
            assert all(r[c] == f"{c}{r.n_chars}" for c in HELPERS if c != "n_chars_")
        again = operator(df.repartition(5)).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again)), operator.__name__
    kept = exact_dedup.without_copies(df).collect()
    assert sorted(r.doc_id for r in kept) == [*range(1, 12), 30]  # the longest of its copies, then the smallest id
    once = near_dedup.one_of_each(df).collect()
    assert sorted(r.doc_id for r in once) == list(range(12))
    path = str(tmp_path / "shards")
    sharding.write_shards(df, 3_000, path)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*df.columns, "shard"}
    assert Counter(map(tuple, back.select(*df.columns).collect())) == Counter(map(tuple, df.collect()))
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) <= 3_000
    with pytest.raises(ValueError):
        sharding.write_shards(back, 3_000, path + "2")
    with pytest.raises(ValueError):
        fingerprints.fingerprint_edits(df.withColumn("doc_id", F.lit("a")))


def test_two_long_texts_in_one_batch_of_pairs(spark):
    """Pairs are cut by both of their texts."""
    import pyarrow as pa

    from orderlens.llm.common import slices

    batch = pa.RecordBatch.from_arrays(
        [pa.array(["x" * 90, "y", None, "z"]), pa.array(["a", "b" * 90, "c", "d" * 20])], ["a", "b"]
    )
    assert [p.num_rows for p in slices([batch], 0, 1, size=100)] == [1, 2, 1]
    rng = random.Random(9)
    long = words(rng, 200_000)
    rows = [(i, long + f" end{i}", "en", "s", 0) for i in range(4)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.class_id for r in out} == {0}


def test_copies_do_not_crowd_a_language_out(spark):
    rows = [(i, f"{chr(97 + i % 8)}word " * 3, f"l{i % 8}") for i in range(400)]
    rows += [(1000 + i, f"zz{'klmnopqrst'[i]} only", "l0") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, sample_docs=1)
    assert model.languages == tuple(f"l{i}" for i in range(8))
    once = language.train(df.dropDuplicates(["lang", "text"]).withColumn("doc_id", no_id()))
    every = language.train(df.withColumn("doc_id", no_id()))
    assert np.array_equal(once.keys, every.keys) and np.array_equal(once.scores, every.scores)


def no_id():
    from pyspark.sql import functions as F

    return F.lit(None).cast("long")


def test_near_duplicates(docs):
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(rows_of())
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.class_id)
    assert by[43] == by[44] == by[45] == by[46] == {43}
    assert by[None] == by[3] == {3} and by[40] == by[41] == by[42] == {40}
    assert {r.class_size for r in out if r.doc_id == 43} == {5}
    assert len({r.class_id for r in out}) == 40 + 1 + 1 + 1
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 43


def test_links_found_span_their_class(docs):
    out = near_dedup.near_duplicates(docs)
    assert out.columns == ["doc_id", "class_id", "class_size", "links_found"]
    found = {r.doc_id: r.links_found for r in out.collect()}
    assert found[43] >= 1 and found[44] >= 1 and found[5] == 0


def test_packing(docs):
    lengths = (16, 64, 256)
    out = packing.pack(docs, lengths, pack_rows=20).collect()
    sizes = Counter((i, len(WORDS.findall(t or ""))) for i, t, *_ in rows_of())
    placed, bins = Counter(), defaultdict(list)
    for r in out:
        placed[r.doc_id] += r.n_words
        if r.n_words:
            bins[r.bin].append(r)
        else:
            assert r.bin is None
    want = Counter()
    for (i, n), times in sizes.items():
        want[i] += n * times
    assert placed == want
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == np.cumsum([0] + [r.n_words for r in own])[:-1].tolist()
        used = sum(r.n_words for r in own)
        assert own[0].bin_used == used <= own[0].bin_length
        assert own[0].bin_length == min(c for c in lengths if c >= used)
    assert Counter(map(tuple, packing.pack(docs, lengths, 20).collect())) == Counter(map(tuple, out))


def total_cost(lengths):
    return sum(packing.sequence_cost(c) for c in lengths)


def cheapest_packing(sizes, lengths):
    """The least total cost over every way to share the sizes among sequences."""
    def ways(rest):
        if not rest:
            yield []
            return
        head, *tail = rest
        for k in range(len(tail) + 1):
            for others in itertools.combinations(range(len(tail)), k):
                words_ = head + sum(tail[i] for i in others)
                if words_ <= max(lengths):
                    for more in ways([tail[i] for i in range(len(tail)) if i not in others]):
                        yield [min(c for c in lengths if c >= words_), *more]

    return min(total_cost(w) for w in ways(list(sizes)))


def test_lengths_are_chosen_jointly():
    lengths = (512, 1024, 2048, 4096)
    # a piece of 300 words alone takes the smallest, with enough others a longer one
    assert packing.best_fit([300], lengths)[2] == [512]
    bins, _, final = packing.best_fit([300] * 40, lengths)
    assert max(final) > 512 and max(Counter(bins).values()) > 1
    # attention over the longest costs more than the overhead it shares
    bins, _, final = packing.best_fit([1000] * 2 + [20] * 2, lengths)
    assert final == [2048] and set(bins) == {0}
    rng = random.Random(6)
    costs = [0, 0]
    for _ in range(20):
        sizes = sorted((min(4096, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(400)), reverse=True)
        bins, offsets, final = packing.best_fit(sizes, lengths)
        used = Counter()
        for b, o, s in zip(bins, offsets, sizes):
            assert o == used[b]
            used[b] += s
        assert all(used[b] <= c for b, c in enumerate(final))
        assert all(c == min(x for x in lengths if x >= used[b]) for b, c in enumerate(final))
        costs[0] += total_cost(final)
        costs[1] += total_cost(packing.best_fit(sizes, (4096,))[2])
    assert costs[0] < 0.99 * costs[1]  # than with the longest length alone
    ratios = []
    for _ in range(60):
        sizes = sorted((rng.choice([rng.randint(1, 600), rng.randint(1, 4096)]) for _ in range(7)), reverse=True)
        ratios.append(total_cost(packing.best_fit(sizes, lengths)[2]) / cheapest_packing(sizes, lengths))
    assert min(ratios) >= 1 - 1e-12 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.03, (min(ratios), max(ratios), sum(ratios) / len(ratios))


def test_a_task_packs_as_best_fit_does(docs):
    """The table against a plain call on the pieces of each task."""
    lengths = (16, 64, 256)
    out = packing.pack(docs, lengths, pack_rows=20).filter("bin is not null").collect()
    by = defaultdict(list)
    for r in out:
        by[r.bin.split("-")[0]].append(r)
    for own in by.values():
        sizes = sorted((r.n_words for r in own), reverse=True)
        _, _, final = packing.best_fit(sizes, lengths)
        assert Counter(final) == Counter({r.bin: r.bin_length for r in own}.values())


def test_sharding(docs):
    limit = 600
    out = sharding.assign_shards(docs, limit).collect()
    assert len(out) == docs.count()
    shards = defaultdict(list)
    for r in out:
        assert r.depth == len(r.shard)
        shards[r.shard].append(r.n_bytes)
        assert r.shard_bytes <= limit or r.depth == 60
    for r in out:
        assert (r.shard_bytes, r.shard_docs) == (sum(shards[r.shard]), len(shards[r.shard]))
        siblings = sum(sum(v) for s, v in shards.items() if r.shard and s.startswith(r.shard[:-1]))
        assert not r.shard or siblings > limit


def test_pii(spark):
    def luhn(digits):
        twice = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(digits))]
        return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0

    def digits(match):
        return re.sub("[^0-9]", "", match)

    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: max(map(int, m.split("."))) < 256),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]

    def base(text):
        found = [
            (m.start(), k, m.end(), name)
            for k, (name, form, ok) in enumerate(forms)
            for m in re.finditer(form, text or "")
            if ok(m.group())
        ]
        return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found))

    texts = [
        None, "", "a@b.c_x@y.z 1.2.3.4.5.6.7.8 999.1.1.1 +49 (030) 12345678 x@y",
        "é@b.cé@d.e 😀 +1 (555) 123-4567 4111-1111-1111-1111 4111 1111 1111 1112",
        "a" * 30_000, "1" * 30_000, "a@" + "b." * 9_000 + "c", "+1 " * 300, "1." * 700,
    ]
    texts += [f"write to u{i}@mail.example soon" for i in range(9)] + ["write to u7@mail soon"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    out = pii.find_pii(df).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    shape = pii.find_pii(
        spark.createDataFrame(
            [(i, f"call host {i}.1.2.3 now") for i in range(9)] + [(9, "call host 300.1.2.3 now")],
            "doc_id long, text string",
        )
    )
    last = shape.filter("doc_id = 9").first()
    assert (last.n_ip, last.n_found, last.spans) == (0, 1, "ip:10:19")


def test_pii_of_other_shapes(spark):
    rng = random.Random(9)
    far = words(rng, 60).replace(" ", "")  # a neighbour of more than 80 letters
    texts = [f"{words(rng, 2)} mail u{i}@m{i}.example {words(rng, 2)}" for i in range(20)]
    texts += [f"dial +49 30 {1234567 + 7 * i} {words(rng, 1)}" for i in range(9)]
    texts += [f"{far} u{i}@far{i}.example" for i in range(20, 24)]
    odd = ["mail user@localhost", "x mail name(at)mail.com y", "dial 0301234567 z", f"{far} who[at]home"]
    texts += odd + ["chapter 12 has 3 parts", f"q{far[1:]} not[at]home", "mail 5 letters"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {texts[r.doc_id]: r for r in pii.find_pii(df).collect()}
    for text, span in zip(odd, ("email:5:19", "email:7:23", "phone:5:15", f"email:{len(far) + 1}:{len(far) + 12}")):
        assert (out[text].n_found, out[text].spans) == (1, span), text
    for text in ("chapter 12 has 3 parts", f"q{far[1:]} not[at]home", "mail 5 letters"):
        assert out[text].n_found == 0, text


def test_pii_runs_until_nothing_is_fresh(spark):
    from pyspark.sql import functions as F

    # pattern i holds items of links i and i + 1: link i + 1 is known a round after i
    rows = [("c0", f"seed{j}@x.y", 0) for j in range(36)]
    for i in range(7):
        rows += [(f"c{i}", f"w{i}-{j}@lan", None) for j in range(4)]
        if i:
            rows += [(f"c{i}", f"w{i - 1}-{j}@lan", None) for j in range(4)]
            rows += [(f"c{i}", f"seed{j}@x.y", 0) for j in range(31)]
    found = spark.createDataFrame(rows, "context string, item string, k int").select(
        F.array("context").alias("contexts"), "item", "k"
    )
    got = {r.item for r in pii.learned(found, 3, 0.8).collect()}
    assert got == {f"w{i}-{j}@lan" for i in range(7) for j in range(4)}


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()


def pipeline_by_hand(rows):
    """Language, exact dedup, near-dedup and mixing over the fixture below, plainly:
    (id, words) by how often it is packed."""
    known = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    same = defaultdict(list)
    for r in known:
        same[re.sub(r"\s", "", r[1])].append(r)
    left = [min(own, key=lambda r: r[0]) for own in same.values()]

    def shingles(text):
        each = text.split()
        return {tuple(each[i : i + 5]) for i in range(max(1, len(each) - 4))}

    classes = []
    for r in left:
        own = shingles(r[1])
        near = [c for c in classes if any(len(own & s) >= 0.8 * len(own | s) for _, s in c)]
        classes = [c for c in classes if c not in near] + [sum(near, []) + [(r, own)]]
    left = [
        min((r for r, _ in c), key=lambda r: hashlib.md5(" ".join(r[1].split()).encode()).hexdigest())
        for c in classes
    ]
    size = {r[0]: len(r[1].split()) for r in left}
    sources = sorted({r[3] for r in left})
    total = {s: sum(size[r[0]] for r in left if r[3] == s) for s in sources}
    weight = dict(zip(sources, (5, 2, 1)))
    low, high = 0.0, 10.0 * sum(total.values())
    for _ in range(200):
        level = (low + high) / 2
        short = sum(min(2 * total[s], weight[s] * level) for s in sources) < 1.5 * sum(total.values())
        low, high = (level, high) if short else (low, level)
    want = Counter()
    for s in sources:
        target = min(2 * total[s], weight[s] * high)
        times = int(target / total[s] + 1e-9)
        budget = round(target - times * total[s])
        own = [r for r in left if r[3] == s]
        own.sort(key=lambda r: hashlib.md5(f"{r[0]}|{r[3]}|{r[1]}".encode()).hexdigest()[:15])
        for r in own:
            n = size[r[0]]
            want[r[0], n] += times + (budget > 0 and 2 * budget >= n)
            budget = max(0, budget - n)
    return +want


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [[i, words(rng, rng.randint(20, 60)), "en", f"s{i % 3}"] for i in range(30)]
    rows += [[100 + i, rows[i][1], "en", f"s{i % 2}"] for i in range(5)]
    for i in range(4):
        each = words(rng, 300).split()
        rows.append([200 + i, " ".join(each), "en", "s0"])
        each[150] = "changed"
        rows.append([300 + i, " ".join(each), "en", "s0"])
    rows += [[400, None, "en", "s0"], [401, "12 34 !?", "en", "s1"], [402, "", "en", "s2"]]
    table = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_words) for r in out) == pipeline_by_hand(rows)
    assert all(r.bin is not None and r.start == 0 for r in out)
