"""Exact dedup, the n-gram join and paragraph dedup against brute force, and their edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skytable.llm import components, exact_dedup, ngram_join, paragraphs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab "), (6, "a  b"), (7, "é x"), (8, "Ex"), (4, "a b"), (None, "a b c d")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)


def test_exact_dedup_rules(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(docs(spark, ODD)).collect()}
    assert (3, 3, 3, True) in got and (1, 3, 3, False) in got  # null, empty and white space are one group; the longest stays
    assert (6, 6, 4, True) in got and (4, 6, 4, False) in got and (5, 6, 4, False) in got
    assert (None, None, 1, True) in got
    kept = exact_dedup.deduplicated(docs(spark, ODD)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 3, 6, 7, 8]


def test_exact_dedup_repeated_winner_stays_once(spark):
    rows = [(1, "same"), (1, "same"), (2, "same")] + [(i, "hot text") for i in range(10, 600)]
    kept = exact_dedup.deduplicated(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 10]


def test_exact_dedup_empty_and_clashing_columns(spark):
    assert exact_dedup.groups(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a"), (2, "a")]).withColumn("__digest", F.lit(1)).withColumn("keep_id", F.lit(2))
    assert [r.asDict() for r in exact_dedup.deduplicated(clash).collect()] == [
        {"doc_id": 1, "text": "a", "lang": "en", "source": "src0", "n_chars": 1, "__digest": 1, "keep_id": 2}]


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def brute_components(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                k = len(sets[x] & sets[y])
                if 100 * k >= percent * (len(sets[x]) + len(sets[y]) - k):
                    a, b = sorted((root(x), root(y)))
                    up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(words, n=140):
    r, out = random.Random(3), []
    for i in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split()
            for _ in range(r.randrange(4)):
                at = r.randrange(len(w) + 1)
                w[at:at + r.randrange(2)] = r.choice([[], ["new"], ["one", "more"]])
            out.append(" ".join(w))
        else:
            out.append(words(r.choice([1, 2, 3, 20, 60, 200]), i, 300))
    out += ["common line of words that many texts hold " * 3 + str(i) for i in range(20)]
    return list(enumerate(out))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_is_exact(spark, words, size, percent):
    rows = near_copies(words)
    out, links = ngram_join.joined(docs(spark, rows), size=size, percent=percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == brute_components(rows, size, percent)
    assert links.count() > 0
    kept = {r.doc_id for r in ngram_join.kept(docs(spark, rows), size=size, percent=percent).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_ngram_join_hashes_do_not_depend_on_neighbours(spark, words):
    text = words(300, 1)
    rows = [(0, text), *[(i, words(2000, i)) for i in range(1, 400)], (500, text + " end")]
    out, _ = ngram_join.joined(docs(spark, rows).repartition(7))
    assert {r.doc_id: r.component_id for r in out.filter("doc_id in (0, 500)").collect()} == {0: 0, 500: 0}


def test_ngram_join_odd_rows(spark):
    out, _ = ngram_join.joined(docs(spark, ODD).withColumn("id", F.lit(1)).withColumn("n", F.lit("x")))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert (1, 0, 1) in got and (2, 0, 2) in got and (4, 1, 4) in got and (6, 1, 4) in got and (5, 1, 5) in got and (None, 2, None) in got
    assert ngram_join.joined(docs(spark, []))[0].count() == 0
    assert ngram_join.kept(docs(spark, ODD)).count() == len(ODD) - 1


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 300)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 200)) and 300 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_finds_links_that_the_middle_does_not_have(spark):
    # one bucket; links only between 5-6 and 6-7, none with the least member
    entries = spark.createDataFrame([(1, i) for i in range(8)], "bucket long, id long")
    known = spark.createDataFrame([(5, 6), (6, 7)], "a long, b long")
    found, _ = components.linked(entries, lambda pairs: pairs.join(known, ["a", "b"], "left_semi"))
    assert {(r.id, r.component) for r in found.collect()} == {(5, 5), (6, 5), (7, 5)}


def test_paragraphs_catch_copies_near_copies_and_passages(spark, words):
    a, b, c, passage = words(60, 1), words(80, 2), words(70, 3), words(60, 4)
    near = " ".join(b.split()[:40] + ["changed"] + b.split()[41:])
    rows = [(1, f"{a}\nshort line"), (2, f"{words(50, 5)}\n{a}"), (3, b), (4, near), (5, c),
            (6, f"{words(90, 6)} {passage} {words(90, 7)}"), (7, f"{words(20, 8)} {passage} {words(120, 9)}"), (8, words(100, 10)), (9, None), (10, ""), (None, a)]
    found = paragraphs.repeated(docs(spark, rows))
    got = {(r.doc_id, r.unit, r.keep_doc_id, r.removed) for r in found.collect()}
    assert got == {(1, "paragraph", 1, False), (2, "paragraph", 1, True), (None, "paragraph", 1, True), (3, "paragraph", 3, False), (4, "paragraph", 3, True),
                   (6, "passage", 6, False), (7, "passage", 6, True)}
    row = next(r for r in found.collect() if r.doc_id == 7)
    assert rows[6][1][row.start:row.end] in passage and row.end - row.start > 100
    clean = {r.doc_id: r.text for r in paragraphs.cleaned(docs(spark, rows), found).collect()}
    assert clean[2] == words(50, 5) and clean[1] == f"{a}\nshort line" and clean[None] == "" and clean[4] == "" and clean[9] is None and clean[5] == c
    assert paragraphs.repeated(docs(spark, [])).count() == 0


def test_paragraphs_passages_of_kept_lines_and_kept_places(spark, words):
    passage, other, long, own = words(70, 61), words(70, 62), words(700, 60), [words(60, 63 + k) for k in range(8)]
    shared = f"{own[0]} {passage} {own[1]}"
    docs = spark.createDataFrame([
        # a line kept in 2 and removed in 3 holds a passage of 1
        (1, f"{own[2]} {passage} {own[3]}"), (2, shared), (3, shared),
        # the earliest place of another passage is in a near copy that goes with its class
        (10, long), (11, f"{long} {other}"), (12, f"{own[6]} {other}"),
        # two passages of one line with own words between
        (20, f"{passage} {own[7]} {other}")], "doc_id long, text string")
    found = paragraphs.repeated(docs)
    rows = found.collect()
    assert [(r.keep_doc_id, r.removed) for r in rows if r.doc_id == 2 and r.unit == "passage"] == [(1, True)]
    gone = {(r.doc_id, r.paragraph) for r in rows if r.unit == "paragraph" and r.removed}
    assert gone == {(3, 0), (11, 0)}
    assert all((r.keep_doc_id, r.keep_paragraph) not in gone for r in rows)
    text = {r.doc_id: r.text for r in paragraphs.cleaned(docs, found).collect()}
    inside = " ".join(passage.split()[20:50])
    assert [i for i, t in sorted(text.items()) if inside in t] == [1]
    assert [i for i, t in sorted(text.items()) if " ".join(other.split()[20:50]) in t] == [12]
    # words of its own are never cut
    assert own[7] in text[20] and own[0] in text[2] and own[1] in text[2] and text[3] == ""


def test_paragraphs_first_place_is_not_a_removed_line(spark, words):
    passage, a, b, c = words(70, 71), words(60, 72), words(60, 73), words(60, 74)
    line = f"{a} {passage} {b}"
    docs = spark.createDataFrame([(5, f"{line}\n{line}"), (7, f"{c} {passage}")], "doc_id long, text string")
    rows = paragraphs.repeated(docs).collect()
    assert {(r.doc_id, r.paragraph, r.removed) for r in rows if r.unit == "paragraph"} == {(5, 0, False), (5, 1, True)}
    assert {(r.doc_id, r.paragraph, r.removed) for r in rows if r.unit == "passage"} == {(5, 0, False), (7, 0, True)}


def test_paragraphs_of_few_words(spark, words):
    exact, near = words(15, 81), words(38, 82).split()
    changed = " ".join([*near[:-1], "changed"])
    rows = paragraphs.repeated(spark.createDataFrame(
        [(1, f"{words(60, 83)}\n{exact}"), (2, f"{exact}\n{words(60, 84)}"), (3, " ".join(near)), (4, changed), (5, words(9, 85)), (6, words(9, 85))], "doc_id long, text string")).collect()
    assert {(r.unit, r.doc_id, r.paragraph, r.keep_doc_id, r.removed) for r in rows} == {
        ("paragraph", 1, 1, 1, False), ("paragraph", 2, 0, 1, True), ("paragraph", 3, 0, 3, False), ("paragraph", 4, 0, 3, True)}


def test_banding_has_the_wanted_recall():
    bands, rows = paragraphs.banding()
    assert bands * rows <= paragraphs.HASHES and 1 - (1 - 0.8 ** rows) ** bands >= paragraphs.RECALL


def test_parities_never_lose_a_linked_pair():
    import numpy as np

    from skytable.llm.words import mixed
    r = random.Random(1)
    for percent in (80, 90):
        for n in (1, 5, 40, 127, 128, 129, 700, 4096, 9000):
            a = mixed(np.arange(n, dtype=np.uint64) + np.uint64(r.randrange(1 << 40))) >> np.uint64(12)
            gone = (100 - percent) * n // 100
            b = a[:n - gone // 2]
            b = np.concatenate([b, mixed(np.arange(gone // 3, dtype=np.uint64) + np.uint64(7)) >> np.uint64(12)])
            if not len(b):
                continue
            lists = ngram_join._parities(np.concatenate([a, b]), np.array([len(a), len(b)])).to_pylist()
            small = min(map(len, lists))
            x, y = [np.bitwise_xor.reduce(np.array(v, dtype=np.int64).reshape(-1, small), axis=0) for v in lists]
            differ = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert differ <= apart and (apart - differ) % 2 == 0
            assert small * 64 >= 2 * min(len(a), len(b))


def test_ngram_join_of_long_near_copies_and_an_id_with_two_texts(spark, words):
    long = words(4000, 1, 900).split()
    rows = [(i, " ".join(long[:3700 + 40 * i] + words(60, i).split())) for i in range(8)] + [(20, "one two three four"), (20, "five six seven"), (19, "one two three four"), (21, "five six seven")]
    out, _ = ngram_join.joined(docs(spark, rows))
    got = sorted((r.doc_id, r.component_id) for r in out.collect() if r.doc_id > 8)
    assert got == [(19, 19), (20, 19), (20, 20), (21, 20)]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect() if r.doc_id <= 8}
    assert near == brute_components([r for r in rows if r[0] <= 8], 3, 90)


def test_buckets_of_two_meet_once(spark, monkeypatch):
    tables = []
    original = components.written_at

    def kept(df, name):
        tables.append((name, df.groupBy("bucket").count().collect() if name == "members" else df.count()))
        return original(df, name)
    monkeypatch.setattr(components, "written_at", kept)
    # forty buckets of two, none of them a link, and one of thirty ids in which neighbours are links
    rows = [(b, 1000 + 2 * b + k) for b in range(40) for k in (0, 1)] + [(99, i) for i in range(30)]
    entries = spark.createDataFrame(rows, "bucket long, id long")
    got, links = components.linked(entries, lambda pairs: pairs.filter("b < 1000 and b - a = 1"))
    assert {r.component for r in got.filter("id < 30").collect()} == {0}
    later = [t for name, t in tables if name == "members"][1:]
    assert later and all(r["count"] > 2 for t in later for r in t)


def test_rare_words_lead_where_every_bin_of_shingles_is_crowded(spark):
    # 40 frequent words make shingles that no two texts need to share; two texts hold one rare word each
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(60))) for i in range(200)]
    rows[7] = (7, rows[7][1] + " rarest")
    texts = spark.createDataFrame(rows, "id long, __text string")
    logs = ngram_join.rarity(texts.select("__text"))
    w = ngram_join.Words([rows[7][1].encode()])
    rank = ngram_join._ranked(w, 3, logs)
    assert rank.argmin() == len(rank) - 1 and sorted(rank)[1] > rank.min()
