"""What the second round's findings were about, each beside its SQL."""

import math

import duckdb
import pytest
from conftest import same_rows

from rasterloom.operators import batch, paint
from rasterloom.plans import registry


def test_batch_summary_rounds_as_sql_does(spark, tmp_path):
    """A hundredth of every other value ends in a half in decimal that most doubles do not hold."""
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT i AS event_id, i / 20.0::DOUBLE AS value, 'view' AS event_type FROM range(1, 20000) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same_rows(registry.queries()["batch_summary"](spark, str(tmp_path)), duck, registry.oracle_sql()["batch_summary"])


def test_summed_seconds_know_no_order(spark):
    row = lambda *seconds: batch.batch_summary(spark.createDataFrame([(str(k), 0.5, 1, s, None) for k, s in enumerate(seconds)], "name string, similarity double, svg_bytes long, seconds double, note string")).first().seconds
    assert row(1e10, *[1e-6] * 20, None, -1e10) == row(*[1e-6] * 20, 1e10, -1e10) == 2e-5
    assert row(1e300, 1.0) == 1e300 and math.isnan(row(1.0, math.nan)) and row(math.inf) == math.inf and row(None) is None


@pytest.mark.parametrize("name", ["resize_lanczos", "supersample_bicubic", "supersample_bilinear"])
def test_rasters_without_all_their_rows_are_resized_like_whole_ones(name, spark, sf_dir, tmp_path):
    """The first raster is whole, the second ends after six rows, the third starts late and has a gap."""
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id < 56 OR vec_id BETWEEN 120 AND 130 OR vec_id = 140) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    same_rows(registry.queries()[name](spark, str(tmp_path)), duck, registry.oracle_sql()[name])


def test_points_on_a_circle_have_no_centre_and_a_far_ramp_has_its_own(spark):
    """Three points lie on a circle, whose lack of curvature doubles do not always tell; far from the corner they lose the centre of a true ramp."""
    three = [(1, 35, 1, 8, 116, 103), (1, 44, 22, 25, 139, 132), (1, 53, 42, 24, 139, 134)]
    square = [(2, x, y, x * y % 7, x, y) for x in (3, 60) for y in (2, 41)]
    ramp = [(3, x, y, (x - 30_007) ** 2 + (y - 40_002) ** 2, 9, 9) for x in range(30_000, 30_012) for y in range(40_000, 40_012)]
    near = [(4, x, y, 255 - (x - 4) ** 2 - (y - 5) ** 2, x, 2 * y + (x - 4) ** 2 + (y - 5) ** 2) for x in range(10) for y in range(10)]
    pixels = spark.createDataFrame([*three, *square, *ramp, *near], "region int, x int, y int, r int, g int, b int").coalesce(1)
    found = {r.region: (r.cx, r.cy) for r in paint.centres(pixels, ["region"]).collect()}
    assert found.keys() == {3, 4} and found[3] == (30_007, 40_002)
    assert found[4] == (4, 4.5)  # the middle of (4, 5) and, for the slope of 2 in b, (4, 4)


def test_a_centre_beyond_exact_sums_is_an_error(spark):
    with pytest.raises(Exception, match="55108 pixels"):
        paint.centres(spark.createDataFrame([(1, 60_000, 1, 1, 1, 1)], "region int, x int, y int, r int, g int, b int"), ["region"]).collect()
