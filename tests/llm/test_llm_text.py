"""Byte-level BPE, language ID, toxicity, PII and mixing: against brute force or held-out rows, and edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from skytable.llm import bpe, language, mixing, pii, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string"
ODD = ["", " ", None, "a", "\n\n\n  x", "don't we'll 'S", "x" * 3000, "é" * 50 + "'re" * 40, "12345 ٣٤", "   a\t\tb", "😀😀 z̈", "'" * 99, " " * 500 + "q", "日本語 テキスト"]


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


def frame(spark, texts, lang="en", source="src0"):
    return spark.createDataFrame([(i, t, lang, source) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 16), (100, 32), (bpe.CHUNK, bpe.OVERLAP)])
def test_bpe_equals_the_library_and_round_trips(spark, words, chunk, overlap):
    r = random.Random(1)
    texts = [*ODD, *["".join(r.choice("ab1 '\n.ré😀st") for _ in range(r.randrange(400))) for _ in range(150)], words(3000, 2), "a" * 999 + " tail of words " * 40, *ODD]
    df = frame(spark, texts).withColumn("ids", F.lit("clash"))
    tokens = bpe.encoded(df, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    got = {x.doc_id: x.ids for x in tokens.collect()}
    want = reference_encoding()
    assert got == {i: want.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {x.doc_id: bytes(x.decoded) for x in bpe.decoded(tokens, RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_bpe_repeated_and_missing_ids(spark):
    rows = [(1, "a" * 60 + " b " * 60, "en", "s"), (1, "other text " * 30, "en", "s"), (None, "c d " * 90, "en", "s"), (1, "a" * 60 + " b " * 60, "en", "s")]
    got = bpe.encoded(spark.createDataFrame(rows, SCHEMA), RANKS, public_tokenizers.PATTERN, chunk=50, overlap=10).collect()
    want = reference_encoding()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), want.encode_ordinary(t)) for i, t, _, _ in rows)
    assert bpe.summary(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    one = bpe.summary(frame(spark, ["ab c"]), RANKS, public_tokenizers.PATTERN).first()
    ids = want.encode_ordinary("ab c")
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (
        len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"ab c").hexdigest())


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.filter("lang_pred = lang").count()
    assert right >= 0.98 * got.count()
    assert got.filter("rejected").count() == 0


@pytest.mark.parametrize("n_words", [20, 100, 1000, 5000])
def test_language_rejects_unlearned_scripts_at_every_length(spark, n_words):
    r = random.Random(n_words)
    alphabets = {"cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "cjk": range(0x4E00, 0x5E00), "hangul": range(0xAC00, 0xB400),
                 "arabic": range(0x627, 0x64B), "latin": range(97, 123), "base64": [*range(48, 58), *range(65, 91), *range(97, 123), 43, 47]}
    texts = [" ".join("".join(chr(r.choice(a)) for _ in range(r.randint(2, 9))) for _ in range(n_words)) for a in alphabets.values() for _ in range(5)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identified(frame(spark, texts, lang=None), language.learned(docs)).filter("not rejected").select("row.doc_id", "score").collect()
    assert got == []
    # one text over and over is no nearer to a language than the text itself, and no farther
    some = [x.text for x in docs.filter("length(text) between 60 and 600").orderBy("doc_id").limit(20).collect()]
    again = language.identified(frame(spark, [" ".join([t] * (1 + n_words * 6 // len(t))) for t in some], lang=None), language.learned(docs))
    assert again.filter("rejected").count() == 0


def test_language_does_not_see_held_out_labels_and_odd_texts(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der hund und die katze " * 3, "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, "123 !!", "de", "s"), (103, "漢字漢字漢字漢字", None, "s"), (None, "the cat and the dog", None, None), (1, "the dog", "en", "s")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    got = {(r.doc_id, r.lang_pred): r for r in language.predictions(df).collect()}
    assert got[(100, "und")].score == 0 and got[(101, "und")].rejected and got[(102, "und")].rejected
    assert next(r for k, r in got.items() if k[0] == 103).rejected and got[(None, "en")].lang_pred == "en"
    hidden = df.withColumn("lang", F.when(language.held_out(F.col("doc_id"), 4, 2), F.lit("zz")).otherwise(F.col("lang")))
    assert language.predictions(hidden).filter("lang_pred = 'zz'").count() == 0
    kept = language.kept(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
    assert language.predictions(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.lang_pred for r in language.predictions(frame(spark, ["some text", None], lang=None)).collect()} == {"und"}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.predictions(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang = 'en'")
    rows = got.select("toxic", "predicted").collect()
    assert sum(r.predicted for r in rows if r.toxic) >= 0.8 * sum(r.toxic for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * sum(1 - r.toxic for r in rows)


def test_toxicity_held_out_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.predictions(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    counts = {(r.lang, r.toxic): (r.n, r.hit) for r in got.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hit")).collect()}
    assert {k[0] for k in counts} == {"de", "en", "es", "fr"}
    for lang in ("de", "en", "es", "fr"):
        n, hit = counts[(lang, 1)]
        assert hit >= 0.8 * n, counts
        n, hit = counts[(lang, 0)]
        assert hit <= 0.05 * n, counts


def test_toxicity_marginals_and_edges(spark):
    import itertools

    import numpy as np

    first, last = np.array([0, 3, 3]), np.array([3, 3, 5])
    gain, trans = np.array([0.5, 2.0, 3.0, 0.1, 4.0]), np.array([[1.0, 0.5], [0.7, 2.0]])
    p = toxicity.Chains(first, last).marginals(gain, trans)[0]
    for a, b in ((0, 3), (3, 5)):
        total, hit = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            s = np.prod([gain[a + i] if t else 1 for i, t in enumerate(tags)]) * np.prod([trans[x, y] for x, y in itertools.pairwise(tags)])
            total, hit = total + s, hit + s * np.array(tags)
        assert np.allclose(p[a:b], hit / total)
    docs = frame(spark, [None, "", "123", "nasty word", "a fine text"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.predictions(docs.withColumn("score", F.lit(1)), none).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    assert toxicity.predictions(frame(spark, []), none).count() == 0


def test_pii_base_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(text):
        out = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                        "card": 16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0, "phone": 8 <= len(digits) <= 15}
                if fine[kind]:
                    out.append((kind, m.start(), m.end()))
        return out
    r = random.Random(2)
    for alphabet in ("a1@. -+%", "0123456789.", "0123456789 -", "0123 -.()+", "12.5@x+ "):
        for _ in range(3000):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert pii.base_spans(text) == plain(text)


def test_pii_field_adds_spans(spark):
    r = random.Random(4)
    number = lambda: f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
    texts = [f"please call me at +1 {number()} or write to bob{i}@mail.example.com today" for i in range(60)]
    texts += ["please call me at (415) 555-0199 today", "room 12 costs 400 and the year is 2019", None, "", "é 4556737586899855 x"]
    df = frame(spark, texts).withColumn("spans", F.lit(1))
    rows = {x.doc_id: x for x in pii.found(df, pii.fitted(df)).collect()}
    assert rows[0].n_phone == 1 and rows[0].n_email == 1
    assert rows[60].n_phone == 0 and "phone" in rows[60].spans and rows[60].n_added == 1
    start, end = map(int, rows[60].spans.split(":")[1:])
    assert texts[60][start:end] == "(415) 555-0199"
    assert rows[61].spans == "" and rows[62].spans == "" and rows[62].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[64].spans == "card:2:18"
    assert pii.found(frame(spark, []), pii.fitted(frame(spark, []))).count() == 0


def test_pii_dynamic_programme_is_exact():
    import itertools

    import numpy as np

    island = next(pii.islands("x 12 34 5678 a@b"))
    model = pii.Model(np.random.default_rng(1).normal(size=(len(pii.KINDS), 1 << pii.BITS)), True)
    lattice = pii.Lattice.of(island)
    scores = model.scores(lattice)
    segments = [(i, j, k, s[k]) for j in range(lattice.n + 1) for i, s in scores[j] for k in range(len(pii.KINDS))]
    best = 0.0
    for n in (1, 2):
        for some in itertools.combinations(segments, n):
            some = sorted(some)
            if all(x[1] <= y[0] for x, y in itertools.pairwise(some)):
                best = max(best, sum(x[3] for x in some))
    got = pii.tagged(island, model)
    own = {(island.pieces[i][0], island.pieces[j - 1][1], pii.KINDS[k]): s for i, j, k, s in segments}
    assert np.isclose(sum(own[(a, b, k)] for k, a, b, _ in got), best) or len(got) > 2


def plain_mixture(rows, fraction=(1, 2), epochs=2):
    """Budgets by rounds: hand out in proportion, give what a child cannot hold to its siblings, until all is placed."""
    tree = defaultdict(int)
    for _, text, lang, source in rows:
        m = re.search(r"([0-9]{1,9})$", source or "")
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        tree[(f"domain{int(m[1]) % 4}" if m else "other", lang or "(none)", source or "(none)")] += n
    leaves = {k: v for k, v in tree.items() if v}

    def split(budget, children):
        got, open_ = dict.fromkeys(children, 0), set(children)
        while budget > 1e-9 and open_:
            weights = sum(children[c][1] for c in open_)
            for c in list(open_):
                got[c] += budget * children[c][1] / weights
            budget = 0
            for c in list(open_):
                if got[c] >= children[c][0]:
                    budget += got[c] - children[c][0]
                    got[c] = children[c][0]
                    open_.discard(c)
        return got
    cap = lambda head: epochs * sum(v for k, v in leaves.items() if k[:len(head)] == head)
    out = {}
    for d, x in split(sum(leaves.values()) * fraction[0] // fraction[1], {d: (cap((d,)), 1) for d in {k[0] for k in leaves}}).items():
        langs = {k[1] for k in leaves if k[0] == d}
        for lang, y in split(x, {n: (cap((d, n)), mixing.LANGUAGE_WEIGHTS.get(n, 1)) for n in langs}).items():
            out |= {(d, lang, s): z for s, z in split(y, {k[2]: (cap(k), 1) for k in leaves if k[:2] == (d, lang)}).items()}
    return out


def test_mixing_budgets(spark, words):
    r = random.Random(6)
    rows = [(i, words(r.randrange(1, 60), i), r.choice(["en", "en", "de", "fr", None]), r.choice(["src0"] * 5 + ["src1", "src2", "src5", "src8", None, "web"])) for i in range(400)]
    rows += [(1000, None, "en", "src0"), (1001, "", "de", "src1"), (None, "a b c", "en", "src0")]
    got = mixing.mixture(spark.createDataFrame(rows, SCHEMA).withColumn("tokens", F.lit("x"))).collect()
    taken = defaultdict(int)
    for x in got:
        taken[(x.domain, x.language, x.source)] += x.taken
    want = plain_mixture(rows)
    assert sum(taken.values()) == sum(len((t or "").split()) for _, t, _, _ in rows) // 2
    assert all(abs(taken[k] - v) <= 3 for k, v in want.items())
    assert all(0 < x.taken <= x.tokens and x.epoch in (0, 1) for x in got)
    # at most one document of a leaf is cut
    cut = [(x.domain, x.language, x.source) for x in got if x.taken < x.tokens]
    assert len(cut) == len(set(cut))


def test_mixed_keeps_columns(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    out = mixing.mixed(frame(spark, ["a b"] * 10).withColumn("__id", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "source", "__id"] and out.count() == 5


def test_mixed_takes_what_the_mixture_says(spark):
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(0, 40))) for _ in range(120)] + ["same  text \n here"] * 3
    docs = frame(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(docs.filter("doc_id % 40 = 7"))  # rows that are alike in all columns
    chosen = [(x.doc_id, x.taken) for x in mixing.mixture(docs, (2, 5)).collect()]
    text = {x.doc_id: x.text for x in docs.collect()}
    out = mixing.mixed(docs, (2, 5)).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert sorted((x.doc_id, len(words(x.text))) for x in out) == sorted(chosen)
    assert all(text[x.doc_id].startswith(x.text) and x.n_chars == len(x.text) for x in out)
    assert any(len(x.text) < len(text[x.doc_id]) for x in out)


def test_tokenised_says_that_texts_come_back(spark):
    from skytable.llm.queries import RANKS
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "ünï " * 20_000), (None, "x")], "doc_id long, text string")
    got = bpe.tokenised(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 4 and all(x.round_trip for x in got) and {x.doc_id: x.n_tokens for x in got}[2] == 0
