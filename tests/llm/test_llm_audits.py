"""Filter interactions and source divergence against plain Python, and their edge cases."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from skytable.llm import divergence, filters

SCHEMA = "doc_id long, text string, lang string, source string, __text string, part int, bits string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_audit(rows, said):
    found = []
    for i, text, lang, _ in rows:
        t = text or ""
        w = t.encode().split()
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows)}
        found.append((lang or "", f, i is not None and any(d == i and q == 1 for d, q, _ in said), i is not None and any(d == i and x == 1 for d, _, x in said)))
    out = {}
    for part in {p for p, *_ in found}:
        mine = [x for x in found if x[0] == part]
        shapley = Counter()
        for o in permutations("ABCDE"):
            gone = {}
            for k, f in enumerate(o):
                redundant = sum(1 for n, x in enumerate(mine) if x[1][f] and n in gone)
                now = [n for n, x in enumerate(mine) if x[1][f] and n not in gone]
                gone.update(dict.fromkeys(now, k))
                shapley[f] += len(now)
                only = sum(1 for x in mine if x[1][f] and sum(x[1].values()) == 1)
                out[part, "".join(o), k + 1] = [len(mine) - len(gone), len(now), redundant, only, sum(mine[n][2] for n in now), sum(mine[n][3] for n in now), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def test_audit_equals_walking_every_order(spark):
    r = random.Random(5)
    texts = ["", None, "a b", "LOUD " * 210, " ".join(f"w{i}" for i in range(220)), "w " * 300, "cost $5 " * 30,
             " ".join(f"W{i}&" for i in range(250)), "é" * 100 + " A", "\x0b".join(f"v{i}" for i in range(199))]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), "s") for i in range(80)] + [(None, "a b", "en", "s"), (3, "a b", "en", "s"), (3, "a b", "fr", "s")]
    said = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 80, 2)] + [(4, 1, 1), (None, 1, 1), (500, 1, 1)]
    got = filters.interactions(docs(spark, rows), labels(spark, said)).collect()
    want = plain_audit(rows, said)
    assert {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in got} == want
    assert len(got) == 600 * len({p for p, *_ in want})


def test_audit_of_an_empty_table_and_a_very_long_text(spark):
    assert filters.interactions(docs(spark, []), labels(spark, [])).count() == 0
    rows = [(1, "word " * 400_000, "en", "s"), (2, "word " * 400_000, "en", "s")]
    got = {(x.filter_order, x.step): x for x in filters.interactions(docs(spark, rows), labels(spark, [])).collect()}
    assert got["BACDE", 1].removed == 2 and got["EBACD", 1].removed == 1 and got["EBACD", 2].redundant == 1


def test_multikey_sort_orders_terms_of_all_lengths():
    r = random.Random(2)
    words = [("ab" * r.randrange(1, 20))[:r.randrange(1, 30)] + r.choice(["", "c", "é"]) for _ in range(800)] + ["abcdefgh", "abcdefghi", "abcdefg", "abcdefgh"] * 3
    buffer = np.frombuffer((" ".join(words) + "\n").encode(), dtype=np.uint8)
    start, end = divergence.term_pointers(buffer)
    order, new = divergence.multikey_sorted(buffer, start, end)
    raw = [bytes(buffer[a:b]) for a, b in zip(start, end, strict=True)]
    in_order = [raw[k] for k in order]
    assert in_order == sorted(w.encode() for w in words)
    assert new.tolist() == [i == 0 or in_order[i] != in_order[i - 1] for i in range(len(in_order))]


def plain_divergence(rows):
    import re
    terms = [(lang or "", source or "", [t.lower() if t.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
              for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        seen = Counter(t for x in mine for t in set(x[2]))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        sources = sorted({x[1] for x in mine})

        def p(words):
            c = Counter(w for w in words if seen[w] >= 3)
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}, c
        q, _ = p([w for x in mine for w in x[2]])
        by = {s: p([w for x in mine if x[1] == s for w in x[2]]) for s in sources}
        for s in sources:
            parts = {"pair": [(sum((by[s][0][t] - by[o][0][t]) ** 2 // by[o][0][t] for t in kept), o) for o in sources if o != s],
                     "term": [((by[s][0][t] - q[t]) ** 2 // q[t], t) for t in kept if by[s][1][t] > 0 and by[s][0][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(items[:200] if part == "term" else items)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_whole_numbers_in_python(spark, monkeypatch, small):
    if small:  # many blocks and tiles
        monkeypatch.setattr(divergence, "BLOCK_CELLS", 64)
        monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    r = random.Random(9)
    vocabulary = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ünder", "ünder", "Über", "ABC", "abc", "a" * 40, "a" * 41]
    rows = [(i % 90, " ".join(r.choices(vocabulary, k=r.randrange(60))) + r.choice(["", " 12-x", "\x00y"]), r.choice(["en", "en", "de", None]), r.choice(["s1", "s2", "s3", "s4", "s5", None]))
            for i in range(100)] + [(200, None, "en", "lonely"), (201, "", "xx", "a"), (202, "one", "xx", "b"), (203, "solo", "yy", "c")]
    got = sorted((x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in divergence.divergences(docs(spark, rows)).collect())
    assert got == plain_divergence(rows)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergences(docs(spark, [])).count() == 0


def test_counts_do_not_overflow(spark):
    n = 5 * 10**12
    got = spark.range(1).selectExpr(f"{n}L as c", f"{2 * n}L as t", "7L as v").select(divergence.probability("c", "t", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (2 * n + 7)
