"""Tables as they grow: images that the table gives only in part, and joins whose sides an explode has multiplied."""

import duckdb
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import difference
from skytable.functions.storage import fresh_path
from skytable.operators import spikes
from skytable.plans import stream_queries
from skytable.streaming import streams

SF = "/root/testdata/sf0.001"


def same_rows(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    assert difference([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None


@pytest.mark.parametrize("name", ["read_fits_pixels", "explode_pixels_udtf"])
def test_an_image_of_which_the_table_has_a_part(spark, tmp_path, name):
    rows = pq.read_table(f"{SF}/embeddings.parquet")
    ids = rows["vec_id"]
    pq.write_table(rows.filter(pc.or_(pc.less(ids, 115), pc.and_(pc.greater_equal(ids, 230), pc.less(ids, 470)))), tmp_path / "embeddings.parquet")
    same_rows(spark, tmp_path, name, "embeddings")


def exploded_builds(df):
    """Joins that would send a side to every executor although an explode has multiplied it, which the size estimate does not see."""
    found, nodes = [], [df._jdf.queryExecution().sparkPlan()]
    while nodes:
        node = nodes.pop()
        sides = [node.children().apply(i) for i in range(node.children().size())]
        nodes += sides
        if node.nodeName().startswith("Broadcast") and len(sides) == 2 and "Generate explode" in sides[str(node.buildSide().toString()) == "BuildRight"].toString():
            found.append(node.simpleString(25))
    return found


GROWING = ["blend_flags", "find_object", "radial_profile_cores", "star_model_sums", "deblend_share", "deblend_layer", "pixel_ownership", "sprite_ownership",
           "crossmatch_detections", "nearest_neighbour_residual", "drop_inside_brighter", "illuminator_distance", "cone_search_join", "covering_cone_pick"]


@pytest.mark.parametrize("name", GROWING)
def test_what_an_explode_multiplies_is_not_sent_whole(spark, name):
    assert exploded_builds(entry.queries()[name](spark, SF)) == []


def test_places_about_stars_are_not_sent_whole(spark, tmp_path):
    px = spark.range(40_000_000).selectExpr("id div 1600 AS image_id", "id % 1600 div 40 AS y", "id % 40 AS x", "CAST(id % 7 AS DOUBLE) AS v")
    stars = spark.createDataFrame([(1, 0, 20.0, 21.0, 2.0, 2.0)], "image_id long, star int, x double, y double, flux double, half double")
    stars.write.parquet(str(tmp_path / "stars"))
    top = spikes.top_stars(spark.read.parquet(str(tmp_path / "stars")))
    assert exploded_builds(spikes.angular_profile(px, top, 2.0)) == []


def test_arriving_rows_are_written_by_many_tasks(spark):
    rows = spark.range(0, 4000, 1, 8)
    for parts in (1, 3):
        sizes = []
        stream = stream_queries.arriving(spark, rows, "many", parts)
        streams.run_batches(stream, fresh_path(spark, "batches"), lambda b, n, s=sizes: s.append((b.count(), b.select(F.input_file_name()).distinct().count())))
        assert len(sizes) == parts and sum(n for n, _ in sizes) == 4000 and all(files >= 8 for _, files in sizes)


def test_nights_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/orders.parquet").repartition(6).write.parquet(str(tmp_path / "orders.parquet"))
    paths, stream = [], streams.table_stream
    monkeypatch.setattr(streams, "table_stream", lambda spark, path, *a, **k: paths.append(path) or stream(spark, path, *a, **k))
    df = entry.queries()["running_gates"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()["running_gates"])
    assert difference([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None
    assert len(spark.read.parquet(paths[0]).inputFiles()) > 3


def test_paths_are_made_once_and_parts_not_sent_whole(spark):
    plan = entry.queries()["object_from_path"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "p_name" in plan and "BroadcastHashJoin [file_id" not in plan and "concat(/astro/" not in plan
