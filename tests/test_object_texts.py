"""Names found in whole texts against comparing every run of words with every name."""

from collections import Counter

from skytable.operators import objects as op
from skytable.plans.object_queries import runs_of_words, words_of

DROPPED = {"the", "nebula", "galaxy", "cluster", "of", "complex"}


def words(t):
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower().replace("'", "")).split() if w not in DROPPED]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(typed, named):
    best = [max(max(0.0, 1 - distance(t, w) / max(len(t), len(w))) for w in named) for t in typed]
    return sum(best) / len(typed) - 0.05 * max(0, len(named) - sum(b >= 0.6 for b in best))


def test_every_run_of_words_is_asked(spark):
    texts = {1: "far away\tthe veil  nebula and\nthe Irish nebula shine, omega centaury too", 2: "one", 3: "", 4: None, 5: "omega centauri " * 300}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    runs = runs_of_words(d)
    want = {(i, " ".join((t or "").split()[k:k + 2])) for i, t in texts.items() for k in range(len((t or "").split()) - 1)}
    assert {(r.doc_id, r.query) for r in runs.collect()} == want and runs.filter("doc_id = 5").count() == 599
    names = ["Veil", "Iris", "Omega Centauri", "Far Veil", ""]
    c = spark.createDataFrame([(k, f"NGC{k + 1}", 1.0 * k, 0.0, 1.0, n, "") for k, n in enumerate(names)], "seq long, id string, ra double, dec double, diameter double, name string, messier string")
    got = {(r.query, r.name): round(r.score, 9) for r in op.find_object(runs.select("query").distinct(), c).collect() if r.name in names}
    plain = {(q, n): round(score(words(q), words(n)), 9) for q in {q for _, q in want} for n in names if n and words(q) and score(words(q), words(n)) >= 0.75}
    assert got == plain and len({n for _, n in plain}) >= 3


def test_first_objects_equal_the_best_of_all(spark):
    # many objects of one name, the first of them counts; runs that hit nothing are not asked
    names, texts = ["Far Veil", "Iris", "", "Omega Centauri"], ["the far veil", "m 31 and NGC 12 or ic 7b", "Irish omega centaury's messier 4", "nothing here", "ngc12 x", "M31", None, "far", "Horse-head nebula, (iris)"]
    c = spark.createDataFrame([(k, f"{'NGC' if k % 2 else 'IC'}{k}", 1.0 * k, 0.0, 1.0, names[k % 4], f"M{k}" if k % 3 else "") for k in range(50)], "seq long, id string, ra double, dec double, diameter double, name string, messier string")
    d = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    runs, asked = runs_of_words(d), op.runs_that_may_hit(words_of(d), c)
    want = {r.query: (r.id, round(r.score, 9)) for r in op.best_object(op.find_object(runs, c)).collect()}
    assert {r.query: (r.id, round(r.score, 9)) for r in op.first_object(asked, c).collect()} == want and len(want) >= 6
    every, some = Counter((r.doc_id, r.query) for r in runs.collect()), Counter((r.doc_id, r.query) for r in asked.collect())
    assert {x: n for x, n in every.items() if x[1] in want} == {x: n for x, n in some.items() if x[1] in want}
    assert "nothing here" not in {q for _, q in some}


def test_an_object_of_a_common_name_is_found_once(spark):
    # 3,000 objects of one name: each run met all of them
    c = spark.createDataFrame([(k, f"NGC{k}", 0.0, 0.0, 1.0, "Far Veil", "") for k in range(3000)], "seq long, id string, ra double, dec double, diameter double, name string, messier string")
    q = spark.createDataFrame([(f"the far veil {w}",) for w in ("nebula", "galaxy", "of", "complex")], "query string")
    assert {tuple(r) for r in op.first_object(q, c).select("query", "id").collect()} == {(r.query, "NGC0") for r in q.collect()}
    assert op._every_hit(q, c, True).count() == 4 and op._every_hit(q, c, False).count() == 12000


def test_objects_of_paths_are_not_sent_whole(spark):
    # runs of words and their objects grow with the paths, whatever their estimates say
    paths = spark.createDataFrame([("/astro/far_veil/NGC1_light.fits",)], "path string")
    c = spark.createDataFrame([(1, "NGC1", 0.0, 0.0, 1.0, "Far Veil", "")], "seq long, id string, ra double, dec double, diameter double, name string, messier string")
    df = op.object_from_path(paths, c)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [query" in plan and "BroadcastHashJoin [query" not in plan
