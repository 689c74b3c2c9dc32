"""Named objects: finding them by name, path or place, and their distances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed, multiplied, written

from skytable.functions.sky import equal_area_cell, separation, with_cells_near
from skytable.operators.frames import finite

# Fixed values of the name rules.
STOPWORDS = ("the", "nebula", "galaxy", "cluster", "of", "complex")
MIN_SCORE = 0.75
FILE_NAME_SCORE = 0.85
NAME_QUERY_MAX = 6
# Words of names that go to every task.
FEW_WORDS = 10_000
ALIASES = (  # names, id, and ra, dec, diameter where the catalogue has no place for it
    (("Elephant's Trunk Nebula",), "IC1396A", 324.0, 57.5, 30.0), (("Horsehead Nebula",), "B33", 85.246, -2.458, 8.0),
    (("Splinter Galaxy", "Knife Edge Galaxy"), "NGC5907", None, None, None), (("Needle Galaxy",), "NGC4565", None, None, None),
    (("Heart Nebula",), "IC1805", None, None, None), (("Soul Nebula",), "IC1848", None, None, None),
    (("Rosette Nebula",), "NGC2237", None, None, None), (("Pacman Nebula",), "NGC281", None, None, None),
    (("Wizard Nebula",), "NGC7380", None, None, None), (("Bubble Nebula",), "NGC7635", None, None, None),
    (("Crescent Nebula",), "NGC6888", None, None, None), (("Iris Nebula",), "NGC7023", None, None, None),
    (("Cocoon Nebula",), "IC5146", None, None, None), (("Flame Nebula",), "NGC2024", None, None, None),
    (("Cone Nebula", "Christmas Tree Cluster"), "NGC2264", None, None, None), (("Witch Head Nebula",), "IC2118", None, None, None),
    (("Jellyfish Nebula",), "IC443", None, None, None), (("Flaming Star Nebula",), "IC405", None, None, None),
    (("Tadpoles Nebula",), "IC410", None, None, None), (("California Nebula",), "NGC1499", None, None, None),
    (("Fish Head Nebula",), "IC1795", None, None, None), (("Eastern Veil Nebula",), "NGC6992", None, None, None),
    (("Western Veil Nebula", "Witch's Broom Nebula"), "NGC6960", None, None, None), (("Seagull Nebula",), "IC2177", None, None, None),
    (("Fireworks Galaxy",), "NGC6946", None, None, None), (("Cat's Eye Nebula",), "NGC6543", None, None, None),
    (("Helix Nebula",), "NGC7293", None, None, None), (("Silver Dollar Galaxy", "Sculptor Galaxy"), "NGC253", None, None, None),
    (("Double Cluster",), "NGC869", None, None, None))
NEBULA_TYPES = ("PN", "HII", "RNe", "SNR", "Neb", "EmO", "MoC", "DNe", "BNe", "ISM", "CGb")
ANSWER_COLUMNS = ("main_id", "ra", "dec", "otype", "dist", "unit", "method", "bibcode", "qual")
ANSWER_RADIUS = 2 / 60
ANSWER_MAX_ROWS = 200
# Objects of a cell that is not cut further, the size at which cutting ends, and how far a separation may be off.
CELL_OBJECTS = 8
CELL_LEAST = 0.02
ANGLE_SLACK = 1e-5
UNITS = {"pc": 1.0, "kpc": 1e3, "Mpc": 1e6}


def object_words(text: Column) -> Column:
    """Lower case words without apostrophes, punctuation and stop words."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(t), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))


def name_score(typed: Column, words: Column) -> Column:
    """How well typed words match a name's words: each typed word's best match, averaged, less 0.05 per word nobody typed."""
    def best(t: Column) -> Column:
        return F.array_max(F.transform(words, lambda w: 1.0 - F.levenshtein(t, w) / F.greatest(F.length(t), F.length(w))))
    bests = F.transform(typed, lambda t: F.greatest(F.lit(0.0), best(t)))
    used = F.size(F.filter(bests, lambda b: b >= 0.6))
    total = F.aggregate(bests, F.lit(0.0), lambda a, b: a + b)
    spare = F.greatest(F.lit(0), F.size(words) - used)
    return F.when((F.size(typed) > 0) & (F.size(words) > 0), total / F.size(typed) - 0.05 * spare).otherwise(0.0)


def _segments(word: Column) -> Column:
    """A word cut into floor(length / 3) + 1 even pieces.

    Two words with a similarity of at least 0.75 differ by at most a third of either length, so one piece of the one
    stands unchanged in the other.
    """
    n = F.length(word)
    parts = F.floor(n / 3).cast("int") + 1

    def at(i: Column) -> Column:
        return F.floor(i * n / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: word.substr(at(i) + 1, at(i + 1) - at(i)))


def _pieces(word: Column) -> Column:
    """Every piece of a word that is as long as a segment of a similar word can be (1 to 4 letters)."""
    n = F.length(word)
    by_size = F.transform(F.sequence(F.lit(1), F.least(F.lit(4), n)),
                          lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: word.substr(i, k)))
    return F.array_distinct(F.flatten(by_size))


def similar_words(left: DataFrame, right: DataFrame, few: bool = False) -> DataFrame:
    """Pairs of distinct words (``word`` on both sides) whose similarity is at least 0.75: ``typed``, ``named``.

    Where ``right`` is known to have ``few`` words they go to the pieces of ``left``, which are not moved.
    """
    a = left.select("word").distinct().filter(F.length("word") > 0).select(
        F.col("word").alias("typed"), F.explode(_pieces(F.col("word"))).alias("piece"),
        F.sequence(F.ceil(F.length("word") * 0.75).cast("int"), F.floor(F.length("word") / 0.75).cast("int")).alias("sizes"))
    a, b = a.select("typed", "piece", F.explode("sizes").alias("size")), (right.select("word").distinct().filter(F.length("word") > 0).select(
        F.col("word").alias("named"), F.length("word").alias("size"), F.explode(F.array_distinct(_segments(F.col("word")))).alias("piece")))
    a, b = (a, F.broadcast(b)) if few else (multiplied(a), multiplied(b))
    near = 1.0 - F.levenshtein("typed", "named") / F.greatest(F.length("typed"), F.length("named")) >= MIN_SCORE
    return a.join(b, ["piece", "size"]).select("typed", "named").distinct().filter(near)


def has_few_words(names: DataFrame) -> bool:
    return names.select("name").distinct().select(F.explode(object_words(F.col("name"))).alias("word")).distinct().count() <= FEW_WORDS


def name_hits(queries: DataFrame, names: DataFrame, few: bool = False) -> DataFrame:
    """Pairs of a distinct query and a distinct name that score at least 0.75: ``query``, ``name``, ``score``.

    A pair that scores has at least one pair of similar words; only such pairs are scored. Distinct texts meet, not rows.
    ``few``: the names are known to have few different words.
    """
    q = queries.select("query").distinct().withColumn("typed", object_words(F.col("query")))
    n = names.filter(F.length("name") > 0).select("name").distinct().withColumn("words", object_words(F.col("name")))
    qw = multiplied(q.select("query", F.explode(F.array_distinct("typed")).alias("word")))
    nw = multiplied(n.select("name", F.explode(F.array_distinct("words")).alias("word")))
    pairs = similar_words(qw, nw, few)
    meet = (qw.withColumnRenamed("word", "typed").join(pairs, "typed").join(nw.withColumnRenamed("word", "named"), "named")
            .select("query", "name").distinct())
    return (meet.join(multiplied(q), "query").join(multiplied(n), "name").withColumn("score", name_score(F.col("typed"), F.col("words")))
            .filter(F.col("score") >= MIN_SCORE).select("query", "name", "score"))


def alias_table(spark: SparkSession) -> DataFrame:
    """The fixed popular names: one row per name."""
    rows = [(i, n, a[0][0], a[1], a[2], a[3], a[4]) for i, a in enumerate(ALIASES) for n in a[0]]
    return spark.createDataFrame(rows, "alias_no int, name string, label string, id string, ra double, dec double, diameter double")


def _every_hit(queries: DataFrame, catalogue: DataFrame, first: bool) -> DataFrame:
    """What a query can mean, each way it is found; of objects with the same id, Messier number or name only the ``first`` where that is set."""
    spark = queries.sparkSession
    q = queries.select("query").distinct().filter(F.trim("query") != "").withColumn(
        "compact", F.regexp_replace(F.upper("query"), r"\s+", ""))
    c = multiplied(catalogue.select("seq", "id", "ra", "dec", F.coalesce("diameter", F.lit(0.0)).alias("diameter"), F.coalesce("name", F.lit("")).alias("name"), "messier"))

    def of(key: Column) -> DataFrame:
        rows = c.withColumn("key", key).filter("key != ''")
        return multiplied(rows.groupBy("key").agg(F.min_by(F.struct(*c.columns), "seq").alias("s")).select("s.*", "key")) if first else rows
    by_id = of(F.upper("id"))
    shape = ["query", "id", "ra", "dec", "diameter", "name", "score", "kind", "seq"]

    def hits(df: DataFrame, score: Column, kind: int) -> DataFrame:
        return df.withColumns({"score": score.cast("double"), "kind": F.lit(kind)}).select(*shape)
    exact = hits(q.withColumn("key", F.col("compact")).join(by_id, "key"), F.lit(1.0), 0)
    part = q.withColumn("key", F.nullif(F.regexp_extract("compact", r"^((?:NGC|IC)\d+)[A-Z]$", 1), F.lit("")))
    part = part.join(multiplied(exact.select("query").distinct()), "query", "left_anti")
    sub = hits(part.join(by_id, "key"), F.lit(0.97), 1)
    number = F.regexp_extract("compact", r"^M(?:ESSIER)?(\d+)$", 1)
    messier = q.withColumn("key", F.when(number != "", F.concat(F.lit("M"), number))).join(of(F.col("messier")), "key")
    messier = hits(messier.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.col("messier"))), F.lit(1.0), 2)
    scored = name_hits(q, c, first and has_few_words(c))
    fuzzy = hits(scored.select(F.col("name").alias("key"), "query", F.col("score").alias("s")).join(of(F.col("name")), "key"), F.col("s"), 3)
    aliases = alias_table(spark)
    named = name_hits(q, aliases, first).join(aliases, "name").groupBy("query", "alias_no", "label", "id", "ra", "dec", "diameter").agg(F.max("score").alias("s"))
    held = of(F.col("id")).select(F.col("id").alias("__id"), F.col("ra").alias("__ra"), F.col("dec").alias("__dec"), F.col("diameter").alias("__d"))
    named = named.join(held, named.id == held["__id"], "left").filter(F.col("ra").isNotNull() | F.col("__id").isNotNull())
    named = named.withColumns({"ra": F.coalesce("ra", "__ra"), "dec": F.coalesce("dec", "__dec"), "diameter": F.coalesce("diameter", "__d"),
                               "name": F.col("label"), "seq": F.col("alias_no").cast("long")})
    alias = hits(named, F.col("s"), 4)
    return exact.unionByName(sub).unionByName(messier).unionByName(fuzzy).unionByName(alias)


def find_object(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue objects for typed texts (``query``): ``id``, ``ra``, ``dec``, ``diameter``, ``name``, ``score``, ``place``.

    An exact id and a Messier number score 1, a part of a catalogued object 0.97, similar names at least 0.75. One row
    per query and id, best first. ``catalogue`` has ``seq``, ``id``, ``ra``, ``dec``, ``diameter``, ``name``, ``messier``.
    """
    best = _every_hit(queries, catalogue, False).groupBy("query", "id").agg(F.max_by(F.struct("ra", "dec", "diameter", "name", "score", "kind", "seq"),
                                                                                      F.struct("score", -F.col("kind"), -F.col("seq"))).alias("h"))
    return best.select("query", "id", "h.*")


def best_object(hits: DataFrame) -> DataFrame:
    """The first hit of each query."""
    order = F.struct("score", -F.col("kind"), -F.col("seq"))
    return hits.groupBy("query").agg(F.max_by(F.struct("id", "ra", "dec", "diameter", "name", "score"), order).alias("h")).select("query", "h.*")


def first_object(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What ``best_object`` takes of ``find_object``; a name that many objects have does not bring them all."""
    return best_object(_every_hit(queries, catalogue, True))


def runs_that_may_hit(texts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every run of two words of ``texts`` (their words as ``w``) that can hit an object: the columns of ``texts`` but ``w``, and ``query``.

    A hit has a word like one of a name, or looks like an id: the same letters with any digits. Both are settled on distinct
    words and ids, so texts are only read, and a run that hits nothing is not moved.
    """
    tokens = written(texts.select(F.explode("w").alias("token")).distinct(), "tokens")
    names = catalogue.select("name").unionByName(alias_table(texts.sparkSession).select("name"))
    named = names.distinct().select(F.explode(object_words(F.col("name"))).alias("word")).distinct()
    typed = tokens.select("token", F.explode(F.array_distinct(object_words(F.col("token")))).alias("word"))
    like = similar_words(typed, named, has_few_words(names)).select(F.col("typed").alias("word")).distinct()
    like = written(multiplied(typed).join(like, "word", "left_semi").select("token").distinct(), "like_names")

    def shape(text: Column) -> Column:
        return F.regexp_replace(F.upper(text), "[0-9]+", "#")
    fixed = texts.sparkSession.createDataFrame([(x,) for x in ("M#", "MESSIER#", *[f"{p}#{chr(c)}" for p in ("NGC", "IC") for c in range(65, 91)])], "shape string")
    shapes = written(catalogue.select(shape(F.col("id")).alias("shape")).unionByName(fixed).distinct(), "id_shapes")
    rest = [c for c in texts.columns if c != "w"]
    runs = texts.filter(F.size("w") > 1).select(*rest, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, 2))).alias("__r"))
    runs = runs.select(*rest, F.col("__r")[0].alias("__a"), F.col("__r")[1].alias("__b")).withColumn("__s", shape(F.concat("__a", "__b")))
    found = F.lit(False)
    for c, known in (("__a", like), ("__b", like), ("__s", shapes)):
        runs = runs.join(known.select(F.col(known.columns[0]).alias(c), F.lit(True).alias(f"{c}_known")), c, "left")
        found = found | F.col(f"{c}_known").isNotNull()
    return runs.filter(found).select(*rest, F.concat_ws(" ", "__a", "__b").alias("query"))


def path_parts(paths: DataFrame) -> DataFrame:
    """The last four parts of each path, innermost first: ``path``, ``level``, ``text`` (the file's ending dropped)."""
    parts = F.filter(F.split("path", r"[/\\]"), lambda p: p != "")
    rows = paths.select("path", F.posexplode(F.slice(F.reverse(parts), 1, 4)).alias("level", "part"))
    return rows.select("path", "level", F.when(F.col("level") == 0, F.regexp_replace("part", r"\.[^.]*$", "")).otherwise(F.col("part")).alias("text"))


def object_from_path(paths: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The object a file name names, else one of its last folders: runs of three, two and one words that score 0.85."""
    words = F.filter(F.split("text", "[^A-Za-z0-9']+"), lambda w: w != "")
    rows = path_parts(paths).withColumn("__w", words).filter(F.size("__w") > 0)
    rows = rows.withColumn("run", F.explode(F.sequence(F.least(F.lit(3), F.size("__w")), F.lit(1))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("__w") - F.col("run") + 1)))
    rows = rows.withColumn("query", F.array_join(F.slice("__w", F.col("i"), F.col("run")), " ")).select("path", "level", "run", "i", "query")
    hits = first_object(rows, catalogue).filter(F.col("score") >= FILE_NAME_SCORE)
    found = multiplied(rows).join(multiplied(hits), "query")
    order = F.struct((-F.col("level")).alias("a"), F.col("score").alias("b"), F.col("run").alias("c"), (-F.col("i")).alias("d"))
    return found.groupBy("path").agg(F.max_by(F.struct("id", "name", "score"), order).alias("h")).select("path", "h.*")


def _with_bounds(pairs: DataFrame) -> DataFrame:
    """Pairs of a field and a cell with the least and the greatest score that the cell's two largest objects, or any, can have."""
    apart = separation("cone_ra", "cone_dec", "c_ra", "c_dec")
    rows = pairs.withColumn("__apart", apart).withColumns({
        "__near": F.greatest(F.lit(0.0), F.col("__apart") - F.col("reach")), "__far": F.col("__apart") + F.col("reach")})
    rows = rows.filter(F.col("__near") <= F.col("radius"))

    def scores(d: str) -> tuple[Column, Column]:
        return tuple(F.col(d) / (1.0 + F.col(s) / F.col("radius")) for s in ("__near", "__far"))
    held = F.col("__far") <= F.col("radius")
    least = F.array(*[F.when(held, F.least(*scores(d))) for d in ("d1", "d2")])
    return rows.withColumns({"__least": least, "__most": F.greatest(*scores("d1"))})


def _target_cells(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each cell with a place in it (``c_ra``, ``c_dec``), how far its objects reach from there and its two largest diameters."""
    at = objects.groupBy(*keys).agg(F.min(F.struct("ra", "dec")).alias("__c")).select(*keys, F.col("__c.ra").alias("c_ra"), F.col("__c.dec").alias("c_dec"))
    w = Window.partitionBy(*keys).orderBy(F.col("diameter").desc())
    top = objects.select(*keys, "diameter").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= 2).groupBy(*keys).agg(
        F.max(F.when(F.col("__n") == 1, F.col("diameter"))).alias("d1"), F.max(F.when(F.col("__n") == 2, F.col("diameter"))).alias("d2"))
    reach = objects.join(at, list(keys)).groupBy(*keys, "c_ra", "c_dec").agg((F.max(separation("ra", "dec", "c_ra", "c_dec")) + ANGLE_SLACK).alias("reach"))
    return checkpointed(reach.join(top, list(keys)))


def pick_targets(fields: DataFrame, catalogue: DataFrame, size: float = 2.0) -> DataFrame:
    """The object of each field (``field_id``, ``ra``, ``dec``, ``radius``) with the highest diameter / (1 + sep / radius), and the next one.

    Fields meet cells, not objects: from cells of ``size`` down to cells of a few objects, a cell is opened only where its
    largest object could still score as high as two objects that surely lie in the field.
    """
    objects = catalogue.filter(finite(F.col("ra")) & finite(F.col("dec"))).select("id", "ra", "dec", "diameter")
    sizes = [size]
    while sizes[-1] > CELL_LEAST:
        # how many objects share the cell of an object
        crowd = objects.groupBy(equal_area_cell("ra", "dec", sizes[-1]).alias("c")).count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
        if (crowd or 0) <= CELL_OBJECTS:
            break
        sizes.append(sizes[-1] / 4)
    names = [f"__cell{i}" for i in range(len(sizes))]
    objects = checkpointed(objects.withColumns({c: equal_area_cell("ra", "dec", s) for c, s in zip(names, sizes, strict=True)}))
    cones = fields.select(F.col("field_id").alias("cone_id"), F.col("ra").alias("cone_ra"), F.col("dec").alias("cone_dec"), "radius")
    held = with_cells_near(cones, "cone_ra", "cone_dec", F.col("radius"), size, names[0]).withColumn("__floor", F.lit(None).cast("double"))
    for i in range(len(sizes)):
        keys = names[:i + 1]
        met = checkpointed(_with_bounds(held.join(_target_cells(objects, keys), names[:max(i, 1)])))
        sure = met.withColumn("__s", F.explode("__least")).filter(F.col("__s").isNotNull()).groupBy("cone_id").agg(F.sort_array(F.collect_list("__s"), False).alias("__s"))
        floors = sure.select("cone_id", (F.get("__s", F.lit(1)) * (1.0 - 1e-9 * F.signum(F.get("__s", F.lit(1))))).alias("__new"))
        met = met.join(multiplied(floors), "cone_id", "left").withColumn("__floor", F.greatest("__floor", "__new"))
        # objects without a size come last, so they count only where two others are not certain
        met = met.filter(F.col("__floor").isNull() | (F.col("__most") >= F.col("__floor")))
        held = multiplied(met.select("cone_id", "cone_ra", "cone_dec", "radius", "__floor", *keys))
    near = held.join(objects, names).withColumn("sep", separation("ra", "dec", "cone_ra", "cone_dec")).filter(F.col("sep") <= F.col("radius"))
    near = near.withColumn("score", F.col("diameter") / (1.0 + F.col("sep") / F.col("radius")))
    w = Window.partitionBy("cone_id").orderBy(F.col("score").desc(), F.col("diameter").desc(), "id")
    top = near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 2)
    return top.groupBy(F.col("cone_id").alias("field_id")).agg(F.max(F.when(F.col("place") == 1, F.col("id"))).alias("best"),
                                                              F.max(F.when(F.col("place") == 2, F.col("id"))).alias("runner_up"))


# --- texts ------------------------------------------------------------------------------

def parse_angle(text: Column, is_ra: bool) -> Column:
    """A typed angle in degrees: decimal, or sexagesimal (hours for RA)."""
    t = F.trim(text)
    form = r"^([-+]?)([0-9]+)[\s:]+([0-9]+)(?:[\s:]+([0-9]+(?:\.[0-9]+)?))?$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(t, form, i).try_cast("double"), F.lit(0.0))
    v = part(2) + part(3) / 60.0 + part(4) / 3600.0
    sign = F.when(F.regexp_extract(t, form, 1) == "-", -1.0).otherwise(1.0)
    return F.when(t.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), t.try_cast("double")).when(t.rlike(form), sign * v * (15.0 if is_ra else 1.0))


def header_centres(headers: DataFrame, image: str = "image_id") -> DataFrame:
    """The centre of each image from its header rows: CRVAL on an RA axis, else RA/DEC, else OBJCTRA/OBJCTDEC."""
    k, v = F.upper(F.trim("key")), F.trim(F.regexp_replace("value", "^'|'$", ""))
    names = ("CTYPE1", "CRVAL1", "CRVAL2", "RA", "DEC", "OBJCTRA", "OBJCTDEC")
    g = headers.groupBy(image).agg(*[F.min(F.when(k == n, v)).alias(n) for n in names])

    def number(c: str) -> Column:
        return F.regexp_extract(F.col(c), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")

    def place(ra: Column, dec: Column) -> Column:
        return F.when((ra >= 0) & (ra < 360) & (F.abs(dec) <= 90), F.struct(ra.alias("ra"), dec.alias("dec")))
    first = F.when(F.col("CTYPE1").startswith("RA"), place(number("CRVAL1"), number("CRVAL2")))
    spot = F.coalesce(first, place(number("RA"), number("DEC")), place(parse_angle(F.col("OBJCTRA"), True), parse_angle(F.col("OBJCTDEC"), False)))
    return g.withColumn("__p", spot).select(image, F.col("__p.ra").alias("ra"), F.col("__p.dec").alias("dec"))


def name_tokens(paths: DataFrame) -> DataFrame:
    """What a path's names might be called, best first: catalogue-looking words, word pairs, long words; at most six."""
    base = path_parts(paths.select("path").distinct())
    ids = F.filter(F.split("text", r"[\s_]+"), lambda w: w.rlike(r"^[A-Za-z]{1,5}-?\d{1,5}(?:-\d{1,5})?[A-Za-z]?$"))
    words = F.filter(F.split("text", "[^A-Za-z0-9']+"), lambda w: w != "")
    rows = base.withColumns({"ids": ids, "__w": words})
    pairs = F.transform(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get("__w", i + 1)))
    singles = F.filter("__w", lambda w: (F.length(w) >= 4) & ~w.rlike(r"^\d+$"))
    g = rows.withColumns({"pairs": pairs, "singles": singles}).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("level", "ids", "pairs", "singles"))).alias("p"))

    def all_of(field: str) -> Column:
        return F.flatten(F.transform("p", lambda s: s[field]))
    every = g.withColumn("__all", F.concat(all_of("ids"), all_of("pairs"), all_of("singles")))
    lower = F.transform("__all", lambda t: F.lower(t))
    once = F.filter("__all", lambda t, i: F.array_position("__lower", F.lower(t)) == i + 1)
    return every.withColumn("__lower", lower).select("path", F.slice(once, 1, NAME_QUERY_MAX).alias("names"))


def typed_distance(text: Column) -> Column:
    """A typed distance: positive and finite, thousands commas dropped; null otherwise."""
    v = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return F.when((v > 0) & (v < float("inf")), v)


# --- saved answers -------------------------------------------------------------------------

def parse_answers(answers: DataFrame) -> DataFrame:
    """Rows of saved table answers (``answer_id``, ``text`` as JSON) by column name: the nine fixed columns as text.

    An answer with a missing column or as many rows as the limit counts as no answer.
    """
    schema = "struct<metadata:array<struct<name:string>>,data:array<array<string>>>"
    rows = answers.select("answer_id", F.from_json("text", schema).alias("j"))
    names = F.transform("j.metadata", lambda m: m["name"])
    rows = rows.withColumn("names", names).filter(
        (F.size(F.array_except(F.array(*[F.lit(c) for c in ANSWER_COLUMNS]), "names")) == 0) & (F.size("j.data") < ANSWER_MAX_ROWS))
    flat = rows.select("answer_id", "names", F.explode("j.data").alias("d")).filter(F.size("d") == F.size("names"))
    m = flat.select("answer_id", F.map_from_arrays("names", "d").alias("m"))
    return m.select("answer_id", *[F.col("m")[c].alias(c) for c in ANSWER_COLUMNS])


def pick_distance(records: DataFrame, targets: DataFrame) -> DataFrame:
    """The published distance of each target: ``answer_id``, ``main_id``, ``distance_pc``, ``bibcode``.

    Exactly one nebula must lie within two arcminutes. The newest usable estimate counts, then the first bibcode, then
    the shorter distance.
    """
    ra, dec = F.col("ra").try_cast("double"), F.col("dec").try_cast("double")
    rows = records.withColumns({"ra": ra, "dec": dec}).join(targets.select("answer_id", "target_ra", "target_dec"), "answer_id")
    ok = ((F.col("ra") >= 0) & (F.col("ra") < 360) & F.col("dec").between(-90, 90) & F.trim("otype").isin(*NEBULA_TYPES)
          & (separation("ra", "dec", "target_ra", "target_dec") <= ANSWER_RADIUS))
    near = rows.filter(ok).withColumn("id", F.trim("main_id"))
    factor = F.lit(None).cast("double")
    for unit, f in UNITS.items():
        factor = F.when(F.trim(F.coalesce("unit", F.lit(""))) == unit, f).otherwise(factor)
    distance = F.col("dist").try_cast("double") * factor
    bib = F.trim(F.coalesce("bibcode", F.lit("")))
    usable = ((distance > 0) & (distance < float("inf")) & bib.rlike(r"^\d{4}") & F.trim(F.coalesce("qual", F.lit(""))).isin("", "A", "B", "C"))
    rank = F.struct((-F.substring(bib, 1, 4).try_cast("int")).alias("year"), bib.alias("bibcode"), distance.alias("distance_pc"), F.col("id").alias("main_id"))
    g = near.groupBy("answer_id").agg((F.min("id") == F.max("id")).alias("__one"), F.min(F.when(usable, rank)).alias("b"))
    return g.filter(F.col("__one") & F.col("b").isNotNull()).select(
        "answer_id", F.col("b.main_id").alias("main_id"), F.col("b.distance_pc").alias("distance_pc"), F.col("b.bibcode").alias("bibcode"))


def parse_resolver(answers: DataFrame) -> DataFrame:
    """Name-resolver texts (``answer_id``, ``text``) as ``id``, ``ra``, ``dec``; answers without a place are left out."""
    place = r"(?m)^%J\s+(-?[\d.]+)\s+([+-]?[\d.]+)"
    ra, dec = (F.regexp_extract("text", place, i).try_cast("double") for i in (1, 2))
    name = F.trim(F.regexp_extract("text", r"(?m)^#\s*([^\t\r\n]+)", 1))
    return answers.select("answer_id", name.alias("id"), ra.alias("ra"), dec.alias("dec")).filter((F.col("id") != "") & F.col("ra").isNotNull() & F.col("dec").isNotNull())


def distance_cascade(targets: DataFrame, published: DataFrame, clusters: DataFrame, illuminators: DataFrame) -> DataFrame:
    """The distance of each target and where it comes from: a galaxy, typed, published, a cluster, a bright star, or a reason why none.

    ``targets`` has ``target_id``, ``target_type``, ``typed``; the others ``target_id`` and ``distance_pc``.
    """
    rows = targets
    for name, df in (("published", published), ("cluster", clusters), ("star", illuminators)):
        rows = rows.join(df.select("target_id", F.col("distance_pc").alias(f"__{name}")), "target_id", "left")
    typed = typed_distance(F.col("typed"))
    asked = F.trim(F.coalesce("typed", F.lit(""))) != ""
    galaxy = F.col("target_type") == "galaxy"
    steps = (("catalog", F.col("__published")), ("cluster", F.col("__cluster")), ("star", F.col("__star")))
    value = F.when(galaxy, float("inf")).when(asked, typed)
    source = F.when(galaxy, "galaxy").when(asked & typed.isNotNull(), "typed").when(asked, F.lit(None))
    for name, d in steps:
        value, source = value.when(d.isNotNull(), d), source.when(d.isNotNull(), name)
    reason = F.when(~galaxy & asked & typed.isNull(), "typed distance not above zero").when(
        ~galaxy & ~asked & F.coalesce(*[d for _, d in steps]).isNull(), "neither cluster nor illuminating star")
    return rows.select("target_id", value.alias("distance_pc"), source.alias("source"), reason.alias("reason"))


def read_object_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The object catalogue from a CSV: id, ra, dec, diameter (0 when blank), name, pgc, messier.

    Lines of under nine fields, or without an id, are left out.
    """
    lines = spark.read.schema("line string").csv(path, header=True, sep="\u0001", quote="")
    f = F.split("line", ",", -1)
    rows = lines.filter((F.size(f) >= 9) & (f[0] != "")).select(f.alias("f"))

    def text(i: int) -> Column:
        return F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    return rows.select(text(0).alias("id"), text(1).try_cast("double").alias("ra"), text(2).try_cast("double").alias("dec"),
                       F.coalesce(text(4).try_cast("double"), F.lit(0.0)).alias("diameter"), text(7).alias("name"), text(8).alias("pgc"),
                       F.trim(text(10)).alias("messier"))


# --- where to look first -------------------------------------------------------------------

def sky_tiles(spark: SparkSession, radius: float) -> DataFrame:
    """Centres whose circles cover the sky, row by row."""
    step = radius * math.sqrt(2)
    rows = math.ceil(180 / step)
    r = spark.range(rows).select(F.col("id").alias("row"), (-90.0 + (F.col("id") + 0.5) * 180.0 / rows).alias("dec"))
    edge = F.greatest(F.lit(0.0), F.abs("dec") - 90.0 / rows)
    n = F.greatest(F.lit(1), F.ceil(360.0 * F.cos(F.radians(edge)) / step).cast("int"))
    r = r.withColumn("n", n).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return r.select(((F.col("c") + 0.5) * 360.0 / F.col("n")).alias("ra"), "dec", "row", "c")


def spaced(places: DataFrame, order: Sequence[str], apart: float) -> DataFrame:
    """Places (``ra``, ``dec``) kept when they are visited in ``order`` and a kept place drops the later ones nearer than ``apart``.

    No pairs of places are made: a place is safe when none comes before it that is first in a cell its circle touches.
    Every round keeps the safe places and drops what lies near them; kept places are ``apart`` from each other, so the
    sky bounds their number and a place meets few of them. The first place left is always safe, so the rounds end.
    """
    rest = checkpointed(places.withColumns({"__o": F.struct(*order), "__cell": equal_area_cell("ra", "dec", apart)}))
    kept = rest.limit(0)
    while not rest.isEmpty():
        first = checkpointed(rest.groupBy("__cell").agg(F.min("__o").alias("__o")))
        leads = checkpointed(rest.join(first, ["__cell", "__o"], "left_semi"))
        around = with_cells_near(leads.select("__o", "ra", "dec"), "ra", "dec", F.lit(apart), apart)
        late = around.join(first.select(F.col("__cell").alias("cell"), F.col("__o").alias("__p")), "cell").filter("__p < __o").select("__o").distinct()
        safe = checkpointed(leads.join(late, "__o", "left_anti"))
        kept = kept.unionByName(safe)
        near = with_cells_near(safe.select(F.col("__o").alias("__p"), F.col("ra").alias("__ra"), F.col("dec").alias("__dec")).distinct(), "__ra", "__dec", F.lit(apart), apart)
        same = (F.col("__p") == F.col("__o")) & (F.col("__ra") == F.col("ra")) & (F.col("__dec") == F.col("dec"))
        later = (F.col("__p") < F.col("__o")) & (separation("__ra", "__dec", "ra", "dec") < apart)
        rest = checkpointed(rest.join(near, (F.col("__cell") == F.col("cell")) & (same | later), "left_anti"))
    return kept.drop("__o", "__cell")


def search_order(history: DataFrame, catalogue: DataFrame, step: float, target_step: float) -> DataFrame:
    """Where to look for an unknown field, best first: earlier solves, popular objects and Messier objects, the rest by
    size, then sky tiles. A named place within ``target_step`` of an earlier kept one is left out.

    ``priority`` and ``rank`` give the order; ``history`` has ``seq``, ``ra``, ``dec``.
    """
    spark = catalogue.sparkSession
    c = catalogue.withColumns({"diameter": F.coalesce("diameter", F.lit(0.0)),
                               "__m": F.regexp_replace(F.coalesce("messier", F.lit("")), r"\D", "").try_cast("int")})
    label = F.when(F.col("__m") > 0, F.concat(F.lit("M"), F.col("__m").cast("string"))).otherwise(F.col("id"))
    shape = [F.col("ra"), F.col("dec")]

    def part(df: DataFrame, priority: int, first: Column, second: Column, name: Column) -> DataFrame:
        return df.select(F.lit(priority).alias("priority"), first.cast("double").alias("rank"), second.cast("long").alias("tie"), *shape, name.alias("name"))
    a = alias_table(spark).dropDuplicates(["alias_no"])
    held = c.select(F.col("id").alias("__id"), F.col("ra").alias("__ra"), F.col("dec").alias("__dec"), F.col("diameter").alias("__d"), "__m")
    a = a.join(held, a.id == held["__id"], "left").filter(F.col("ra").isNotNull() | F.col("__id").isNotNull()).withColumns(
        {"ra": F.coalesce("ra", "__ra"), "dec": F.coalesce("dec", "__dec"), "diameter": F.coalesce("diameter", "__d", F.lit(0.0))})
    popular = part(c.filter(F.col("name") != ""), 1, -F.col("diameter"), F.col("seq"), label).unionByName(
        part(a, 1, -F.col("diameter"), F.col("alias_no") + F.lit(1 << 40), F.col("id")))
    messier = part(c.filter("__m > 0"), 2, F.col("__m"), F.col("seq"), label)
    rest = part(c.filter("coalesce(__m, 0) <= 0"), 3, -F.col("diameter"), F.col("seq"), F.col("id"))
    past = part(history, 0, F.lit(0), F.col("seq"), F.lit("solved before"))
    named = past.unionByName(popular).unionByName(messier).unionByName(rest).filter(F.col("ra").isNotNull() & F.col("dec").isNotNull())
    kept = spaced(named, ["priority", "rank", "tie"], target_step)
    tiles = part(sky_tiles(spark, step), 4, F.col("row"), F.col("c"), F.format_string("RA %.1f, Dec %+.1f", F.col("ra"), F.col("dec")))
    return kept.unionByName(tiles)


def solve_history(solves: DataFrame, key: str, limit: int = 200, same: float = 0.1) -> DataFrame:
    """Earlier solves of each ``key``, newest first (``seq``), without those a newer one lies within 0.1 degree of; at most ``limit``."""
    # only the newest solves of a place are not near a newer one, and only the newest tell of others: places meet, not solves
    known = finite(F.col("ra")) & finite(F.col("dec"))
    places = checkpointed(solves.filter(known & F.col(key).isNotNull()).groupBy(key, "ra", "dec").agg(F.max("seq").alias("seq")))
    spread = with_cells_near(places, "ra", "dec", F.lit(same), 1.0)
    newer = places.select(F.col(key).alias("__key"), F.col("seq").alias("__seq"), F.col("ra").alias("__ra"), F.col("dec").alias("__dec"),
                          equal_area_cell("ra", "dec", 1.0).alias("__cell"))
    newest = places.join(spread.join(newer, (F.col("cell") == F.col("__cell")) & (F.col(key) == F.col("__key")) & (F.col("__seq") > F.col("seq"))
                                     & (separation("ra", "dec", "__ra", "__dec") <= same), "left_semi").select(key, "ra", "dec"), [key, "ra", "dec"], "left_anti")
    kept = (solves.join(newest, [key, "ra", "dec", "seq"], "left_semi").select(*solves.columns)
            .unionByName(solves.filter(~F.coalesce(known & F.col(key).isNotNull(), F.lit(False)))))
    w = Window.partitionBy(key).orderBy(F.col("seq").desc())
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
