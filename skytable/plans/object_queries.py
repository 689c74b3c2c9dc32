"""Queries about named objects: names from ``part``, texts from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions.storage import fresh_path, multiplied, written
from skytable.operators import objects as op
from skytable.plans.registry import query
from skytable.plans.sky_queries import sep_sql
from skytable.plans.views import table, view, with_views

OBJECTS = """ob AS (SELECT p_partkey AS seq, concat(CASE WHEN p_partkey % 2 = 0 THEN 'NGC' ELSE 'IC' END, CAST(p_partkey AS VARCHAR(9))) AS id, (p_partkey * 731e-1) % 360e0 AS ra, ((p_partkey * 37) % 161 - 80) * 1e0 AS "dec", (p_size % 30) * 1e0 AS diameter,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 10 = 0 THEN concat('M', CAST(p_partkey // 10 AS VARCHAR(9))) ELSE '' END AS messier FROM part)"""


def objects(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql("WITH " + OBJECTS.replace('"dec"', "dec").replace("p_partkey // 10", "CAST(p_partkey / 10 AS BIGINT)") + " SELECT * FROM ob")


ASKED = """asked AS (SELECT DISTINCT CASE doc_id % 6 WHEN 0 THEN concat('ngc ', CAST(doc_id AS VARCHAR)) WHEN 1 THEN concat('IC', CAST(doc_id AS VARCHAR), 'a') WHEN 2 THEN concat('Messier ', CAST(doc_id AS VARCHAR)) WHEN 3 THEN concat('The ', substr(p.p_name, 2), ' Nebula') WHEN 4 THEN concat(p.p_name, 's') ELSE p.p_type END AS query
  FROM documents JOIN part p ON p.p_partkey = doc_id)"""
WORDS = "list_filter(string_split(trim(regexp_replace(replace(lower({0}), '''', ''), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('the', 'nebula', 'galaxy', 'cluster', 'of', 'complex'))"
SCORED = OBJECTS + ",\n" + ASKED + f""",
q AS (SELECT query, regexp_replace(upper(query), '\\s+', '', 'g') AS compact, {WORDS.format('query')} AS ty FROM asked), nm AS (SELECT DISTINCT name, {WORDS.format('name')} AS wo FROM ob WHERE name <> ''),
be AS (SELECT query, name, wo, list_transform(ty, lambda t: greatest(0e0, list_max(list_transform(wo, lambda w: 1e0 - levenshtein(t, w) * 1e0 / greatest(length(t), length(w)))))) AS b, ty FROM q CROSS JOIN nm WHERE len(ty) > 0 AND len(wo) > 0),
sc AS (SELECT query, name, list_sum(b) / len(ty) - 5e-2 * greatest(0, len(wo) - len(list_filter(b, lambda x: x >= 6e-1))) AS score FROM be),
hits AS (SELECT q.query, o.id, 1e0 AS score, 0 AS kind, o.seq FROM q JOIN ob o ON o.id = q.compact
  UNION ALL SELECT q.query, o.id, 97e-2, 1, o.seq FROM q JOIN ob o ON o.id = regexp_extract(q.compact, '^((?:NGC|IC)\\d+)[A-Z]$', 1) WHERE q.compact NOT IN (SELECT id FROM ob)
  UNION ALL SELECT q.query, o.id, 1e0, 2, o.seq FROM q JOIN ob o ON o.messier <> '' AND o.messier = concat('M', regexp_extract(q.compact, '^M(?:ESSIER)?(\\d+)$', 1))
  UNION ALL SELECT s.query, o.id, s.score, 3, o.seq FROM sc s JOIN ob o ON o.name = s.name WHERE s.score >= 75e-2)"""


def asked(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
    i = F.col("doc_id")
    text = (F.when(i % 6 == 0, F.concat(F.lit("ngc "), i.cast("string"))).when(i % 6 == 1, F.concat(F.lit("IC"), i.cast("string"), F.lit("a")))
            .when(i % 6 == 2, F.concat(F.lit("Messier "), i.cast("string")))
            .when(i % 6 == 3, F.concat(F.lit("The "), F.expr("substr(p_name, 2)"), F.lit(" Nebula"))).when(i % 6 == 4, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_type")))
    return d.join(p, "doc_id").select("doc_id", text.alias("query"))


@query("find_object", "WITH " + SCORED + " SELECT query, count(DISTINCT id) AS objects, round(max(score), 6) AS score, (arg_max(id, score * 1e9 - kind * 1e7 - seq)) AS best FROM hits GROUP BY query")
def find_object(spark, sf):
    hits = op.find_object(asked(spark, sf), objects(spark, sf))
    best = op.best_object(hits).select("query", F.col("id").alias("best"))
    g = hits.groupBy("query").agg(F.count("*").alias("objects"), F.round(F.max("score"), 6).alias("score"))
    return g.join(best, "query")


def words_of(docs):
    return docs.select("doc_id", F.expr(r"filter(split(text, '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')").alias("w"))


def runs_of_words(docs, words: int = 2):
    """Every run of so many words of every whole text: ``doc_id``, ``query``. Shorter texts have none."""
    w = words_of(docs).filter(F.size("w") >= words)
    return w.select("doc_id", F.explode(F.expr(f"transform(sequence(1, size(w) - {words - 1}), i -> array_join(slice(w, i, {words}), ' '))")).alias("query"))


# no SQL: it would compare every run with every name
@query("objects_in_texts")
def objects_in_texts(spark, sf):
    runs = written(op.runs_that_may_hit(words_of(table(spark, sf, "documents")), objects(spark, sf)), "runs")
    best = op.first_object(runs, objects(spark, sf)).select("query", F.col("id").alias("best"), F.round("score", 6).alias("score"))
    return multiplied(runs).join(multiplied(best), "query").groupBy("doc_id", "best").agg(F.count("*").alias("runs"), F.max("score").alias("score"))


PATHS = """pt AS (SELECT f.file_id, concat('/astro/', CASE WHEN f.file_id % 3 = 0 THEN concat('M ', CAST(f.file_id % 60 AS VARCHAR(9))) ELSE concat(replace(p.p_name, ' ', '_'), '_run') END, '/night1/', CASE WHEN f.file_id % 4 = 0 THEN concat('NGC', CAST(f.file_id AS VARCHAR(9)), '_light.v1.fits') WHEN f.file_id % 4 = 1 THEN concat(replace(p.p_name, ' ', '-'), '_180s.fits') ELSE 'frame-1.fits' END) AS path
  FROM files f JOIN part p ON p.p_partkey = f.file_id)"""


@query("object_from_path")
def object_from_path(spark, sf):
    view(spark, sf, "files").createOrReplaceTempView("files")
    # both sides grow with the tables, and the paths are read by every way to find an object
    multiplied(table(spark, sf, "part")).createOrReplaceTempView("part")
    paths = written(spark.sql("WITH " + PATHS + " SELECT path FROM pt"), "paths")
    return op.object_from_path(paths, objects(spark, sf)).select("path", "id", F.round("score", 6).alias("score"))


FIELDS = """fd AS (SELECT s_suppkey AS field_id, (s_suppkey * 731e-1 + 3e0) % 360e0 AS ra, ((s_suppkey * 37) % 161 - 78) * 1e0 AS "dec", 4e0 + s_suppkey % 6 AS radius FROM supplier)"""


@query("pick_target", "WITH " + OBJECTS + ",\n" + FIELDS + f""", nr AS (SELECT f.field_id, o.id, o.diameter, {sep_sql('o.ra', 'o."dec"', 'f.ra', 'f."dec"')} AS sep, f.radius FROM fd f JOIN ob o ON o."dec" BETWEEN f."dec" - 10 AND f."dec" + 10),
rk AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY diameter / (1e0 + sep / radius) DESC, diameter DESC, id) AS rn FROM nr WHERE sep <= radius) SELECT field_id, max(CASE WHEN rn = 1 THEN id END) AS best, max(CASE WHEN rn = 2 THEN id END) AS runner_up FROM rk WHERE rn <= 2 GROUP BY field_id""")
def pick_target(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    f = spark.sql("WITH " + FIELDS.replace('"dec"', "dec") + " SELECT * FROM fd")
    return op.pick_targets(f, objects(spark, sf), 4.0)


ANGLES = """an AS (SELECT image_id, key, CASE key WHEN 'OBJCTRA' THEN concat(CAST(image_id % 24 AS VARCHAR(3)), ' 36 42.5') WHEN 'OBJCTDEC' THEN concat('-', CAST(image_id % 80 AS VARCHAR(3)), ':30:15') WHEN 'RA' THEN CASE WHEN image_id % 3 = 0 THEN '400' ELSE CONCAT(CAST(image_id AS VARCHAR(9)), '.5 deg') END
  WHEN 'DEC' THEN '''12.25''' WHEN 'CTYPE1' THEN CASE WHEN image_id % 5 = 0 THEN '''RA---TAN''' ELSE 'GLON' END WHEN 'CRVAL1' THEN '10.5' ELSE '-20.25' END AS value FROM (SELECT DISTINCT image_id FROM headers) CROSS JOIN (SELECT 'OBJCTRA' AS key UNION ALL SELECT 'OBJCTDEC' UNION ALL SELECT 'RA' UNION ALL SELECT 'DEC' UNION ALL SELECT 'CTYPE1' UNION ALL SELECT 'CRVAL1' UNION ALL SELECT 'CRVAL2'))"""


@query("header_centre", with_views("headers", ANGLES + """ SELECT DISTINCT image_id, round(CASE WHEN image_id % 5 = 0 THEN 105e-1 WHEN image_id % 3 <> 0 AND image_id + 5e-1 < 360 THEN image_id + 5e-1 ELSE 15e0 * (image_id % 24 + 36 / 6e1 + 425e-1 / 36e2) END, 6) AS ra,
  round(CASE WHEN image_id % 5 = 0 THEN -2025e-2 WHEN image_id % 3 <> 0 AND image_id + 5e-1 < 360 THEN 1225e-2 ELSE -(image_id % 80 + 30 / 6e1 + 15e0 / 36e2) END, 6) AS "dec" FROM an"""))
def header_centre(spark, sf):
    view(spark, sf, "headers").createOrReplaceTempView("headers")
    h = op.header_centres(spark.sql("WITH " + ANGLES + " SELECT * FROM an"))
    return h.select("image_id", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


TOKENS = PATHS + """,
pr AS (SELECT path, list_reverse(list_filter(string_split(path, '/'), lambda p: p <> ''))[1:4] AS ps FROM pt), bs AS (SELECT path, [CASE WHEN i = 1 THEN regexp_replace(ps[i], '\\.[^.]*$', '') ELSE ps[i] END for i in range(1, len(ps) + 1)] AS b FROM pr),
al AS (SELECT path, list_concat(list_concat(flatten([list_filter(regexp_split_to_array(x, '[\\s_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{1,5}-?\\d{1,5}(-\\d{1,5})?[A-Za-z]?')) for x in b]),
  flatten([[w[i] || ' ' || w[i + 1] for i in range(1, len(w))] for w in [list_filter(regexp_split_to_array(x, '[^A-Za-z0-9'']+'), lambda w: w <> '') for x in b]])),
  flatten([list_filter(regexp_split_to_array(x, '[^A-Za-z0-9'']+'), lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '\\d+')) for x in b])) AS a FROM bs)"""


@query("name_tokens", with_views("files", TOKENS + " SELECT DISTINCT path, array_to_string([a[i] for i in range(1, len(a) + 1) if list_position([lower(z) for z in a], lower(a[i])) = i][1:6], ';') AS names FROM al"))
def name_tokens(spark, sf):
    view(spark, sf, "files").createOrReplaceTempView("files")
    table(spark, sf, "part").createOrReplaceTempView("part")
    t = op.name_tokens(spark.sql("WITH " + PATHS + " SELECT * FROM pt"))
    return t.select("path", F.array_join("names", ";").alias("names"))


RECORDS = """rc AS (SELECT l_orderkey AS answer_id, concat(' NGC', CASE WHEN l_orderkey % 7 = 0 THEN CAST(l_linenumber AS VARCHAR(5)) ELSE '1' END) AS main_id, CAST(1e1 + (l_orderkey % 300) AS VARCHAR(9)) AS ra, '20.01' AS "dec", CASE WHEN l_linenumber % 4 = 3 THEN 'Star' ELSE 'HII ' END AS otype,
  CASE WHEN l_linenumber % 5 = 4 THEN '-1' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(9)) END AS dist, CASE l_partkey % 3 WHEN 0 THEN 'pc' WHEN 1 THEN 'kpc' ELSE 'ly' END AS unit, 'x' AS method, concat(CAST(1990 + l_suppkey % 30 AS VARCHAR(9)), 'A&A', CAST(l_linenumber AS VARCHAR(3))) AS bibcode, CASE l_suppkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'A' ELSE NULL END AS qual FROM lineitem)"""
ONE = RECORDS + """,
nr AS (SELECT *, trim(main_id) AS id, TRY_CAST(dist AS DOUBLE) * CASE unit WHEN 'pc' THEN 1e0 WHEN 'kpc' THEN 1e3 END AS pc FROM rc WHERE trim(otype) = 'HII'),
one AS (SELECT answer_id FROM nr GROUP BY answer_id HAVING count(DISTINCT id) = 1),
us AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY CAST(substr(bibcode, 1, 4) AS INTEGER) DESC, bibcode, pc) AS rn FROM nr WHERE pc > 0 AND coalesce(qual, '') IN ('', 'A', 'B', 'C') AND answer_id IN (SELECT answer_id FROM one))"""


def records(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("WITH " + RECORDS.replace('"dec"', "dec") + " SELECT * FROM rc")


def answer_targets(r):
    return r.select("answer_id", (10.0 + F.col("answer_id") % 300).alias("target_ra"), F.lit(20.0).alias("target_dec")).distinct()


@query("pick_distance", "WITH " + ONE + " SELECT answer_id, id AS main_id, round(pc, 6) AS distance_pc, bibcode FROM us WHERE rn = 1")
def pick_distance(spark, sf):
    r = records(spark, sf)
    return op.pick_distance(r, answer_targets(r)).withColumn("distance_pc", F.round("distance_pc", 6))


@query("read_lookup_answers", "WITH " + RECORDS + """, n AS (SELECT answer_id, count(*) AS rows, count(DISTINCT trim(main_id)) AS objects FROM rc GROUP BY answer_id) SELECT answer_id, rows, objects FROM n WHERE answer_id % 10 <> 0""")
def read_lookup_answers(spark, sf):
    r = records(spark, sf)
    row = F.array(*[F.col(c) for c in op.ANSWER_COLUMNS])
    names = F.array(*[F.struct(F.when((F.col("answer_id") % 10 == 0) & F.lit(c == "qual"), "other").otherwise(c).alias("name")) for c in op.ANSWER_COLUMNS])
    text = F.to_json(F.struct(F.first("__n").alias("metadata"), F.collect_list("__d").alias("data")))
    answers = r.withColumns({"__d": row, "__n": names}).groupBy("answer_id").agg(text.alias("text"))
    path = fresh_path(spark, "answers")
    answers.write.parquet(path)
    back = op.parse_answers(spark.read.parquet(path))
    return back.groupBy("answer_id").agg(F.count("*").alias("rows"), F.count_distinct(F.trim("main_id")).alias("objects"))


@query("name_resolver_answers", "SELECT p_partkey AS answer_id, concat('obj ', p_name) AS id, (p_partkey % 360) * 1e0 AS ra, -5e-1 AS \"dec\" FROM part WHERE p_partkey % 4 <> 0")
def name_resolver_answers(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("# obj "), "p_name", F.lit("\t#Q1\n%@ 12\n"), F.when(F.col("p_partkey") % 4 != 0, F.concat(
        F.lit("%J "), (F.col("p_partkey") % 360).cast("string"), F.lit(".0 -0.5 = x\n"))).otherwise(F.lit("#! nothing\n")))
    return op.parse_resolver(p.select(F.col("p_partkey").alias("answer_id"), text.alias("text")))


@query("read_object_catalogue", "WITH " + OBJECTS + """ SELECT id, round(ra, 6) AS ra, "dec", CASE WHEN seq % 4 = 0 THEN 0e0 ELSE diameter END AS diameter, name, messier FROM ob WHERE seq % 6 <> 5""")
def read_object_catalogue(spark, sf):
    o = objects(spark, sf)
    size = F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("diameter").cast("string"))
    line = F.concat_ws(",", "id", F.col("ra").cast("string"), F.col("dec").cast("string"), F.lit("x"), size, F.lit(""), F.lit(""), "name", F.lit("pgc"), F.lit(""), "messier")
    short = F.concat_ws(",", "id", "ra")
    path = fresh_path(spark, "objects")
    o.select(F.when(F.col("seq") % 6 == 5, short).otherwise(line).alias("line")).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    c = op.read_object_catalogue(spark, path)
    return c.select("id", F.round("ra", 6).alias("ra"), "dec", "diameter", "name", "messier")


CASCADE = ONE + """,
tg AS (SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 9 = 0 THEN 'galaxy' ELSE 'nebula' END AS target_type, CASE o_orderkey % 8 WHEN 1 THEN '1,200' WHEN 2 THEN 'far' WHEN 3 THEN '-5' ELSE NULL END AS typed FROM orders),
pb AS (SELECT answer_id AS target_id, pc FROM us WHERE rn = 1), cl AS (SELECT o_orderkey AS target_id, o_totalprice AS pc FROM orders WHERE o_orderkey % 5 = 0), st AS (SELECT o_orderkey AS target_id, o_totalprice / 2e0 AS pc FROM orders WHERE o_orderkey % 3 = 0)"""


@query("distance_cascade", "WITH " + CASCADE + """ SELECT t.target_id, round(CASE WHEN target_type = 'galaxy' THEN NULL WHEN typed = '1,200' THEN 12e2 WHEN typed IS NOT NULL THEN NULL ELSE coalesce(pb.pc, cl.pc, st.pc) END, 6) AS distance_pc,
  CASE WHEN target_type = 'galaxy' THEN 'galaxy' WHEN typed = '1,200' THEN 'typed' WHEN typed IS NOT NULL THEN NULL WHEN pb.pc IS NOT NULL THEN 'catalog' WHEN cl.pc IS NOT NULL THEN 'cluster' WHEN st.pc IS NOT NULL THEN 'star' END AS source,
  CASE WHEN target_type = 'galaxy' OR typed = '1,200' THEN NULL WHEN typed IS NOT NULL THEN 'typed distance not above zero' WHEN coalesce(pb.pc, cl.pc, st.pc) IS NULL THEN 'neither cluster nor illuminating star' END AS reason
  FROM tg t LEFT JOIN pb ON t.target_id = pb.target_id LEFT JOIN cl ON t.target_id = cl.target_id LEFT JOIN st ON t.target_id = st.target_id""")
def distance_cascade(spark, sf):
    o = table(spark, sf, "orders")
    i = F.col("o_orderkey")
    t = o.select(i.alias("target_id"), F.when(i % 9 == 0, "galaxy").otherwise("nebula").alias("target_type"),
                 F.when(i % 8 == 1, "1,200").when(i % 8 == 2, "far").when(i % 8 == 3, "-5").alias("typed"))
    r = records(spark, sf)
    published = op.pick_distance(r, answer_targets(r)).select(F.col("answer_id").alias("target_id"), "distance_pc")
    clusters = o.filter("o_orderkey % 5 = 0").select(i.alias("target_id"), F.col("o_totalprice").alias("distance_pc"))
    stars = o.filter("o_orderkey % 3 = 0").select(i.alias("target_id"), (F.col("o_totalprice") / 2.0).alias("distance_pc"))
    d = op.distance_cascade(t, published, clusters, stars)
    finite = F.when(F.col("distance_pc") < float("inf"), F.round("distance_pc", 6))
    return d.withColumn("distance_pc", finite)


@query("search_order")
def search_order(spark, sf):
    history = view(spark, sf, "catalogue").filter("g < 9").select(F.col("star_id").alias("seq"), "ra", "dec")
    s = op.search_order(history, objects(spark, sf), 6.0, 2.0)
    return s.select("priority", "rank", "name", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


SOLVES = """sv AS (SELECT o_orderkey AS seq, o_custkey % 20 AS site, (o_custkey % 50) * 7e0 + (o_orderkey % 4) * 6e-2 AS ra, (o_custkey % 30) * 2e0 AS "dec" FROM orders)"""


@query("solve_history", "WITH " + SOLVES + f""", kp AS (SELECT a.* FROM sv a WHERE NOT EXISTS (SELECT 1 FROM sv b WHERE b.site = a.site AND b."dec" = a."dec" AND b.seq > a.seq AND {sep_sql('a.ra', 'a."dec"', 'b.ra', 'b."dec"')} <= 1e-1)),
rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq DESC) AS place FROM kp) SELECT site, seq, place FROM rk WHERE place <= 200""")
def solve_history(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    s = spark.sql("WITH " + SOLVES.replace('"dec"', "dec") + " SELECT * FROM sv")
    return op.solve_history(s, "site").select("site", "seq", F.col("place").cast("long").alias("place"))
