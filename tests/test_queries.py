"""Every query with SQL gives that SQL's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def _rows(frame, cols):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(map(plain, r)) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, con, name):
    got, said = entry.queries()[name](spark, D).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(said.columns)
    assert _rows(got, sorted(got.columns)) == _rows(said, sorted(got.columns))


def test_scale_bilinear_joins_nothing(spark):
    """A join here is planned by the size of the file, which says little of the pixels in it: they were broadcast."""
    got = entry.queries()["scale_bilinear"](spark, D)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scale_bilinear_of_holes(spark):
    """Corners that are missing, null, outside or of no page add nothing; a place without any corner is no row, corners of weight 0 count."""
    from pagemill.operators import pixels as R

    page = [(1, 0, 0, 100), (1, 1, 0, None), (1, 2, 0, 50), (1, 7, 0, 9), (1, -1, 0, 9), (None, 0, 0, 80), (2, 1, 1, 40)]
    got = R.scale_bilinear(spark.createDataFrame(page, "image_id bigint, x int, y int, v int"), 3, 2, 5, 2)
    said = [(1, 0, 0, 100), (1, 1, 0, 50), (1, 2, 0, 0), (1, 3, 0, 25), (1, 4, 0, 50), (2, 0, 0, 0), (2, 0, 1, 0), (2, 1, 0, 0), (2, 1, 1, 20), (2, 2, 0, 0), (2, 2, 1, 40), (2, 3, 0, 0), (2, 3, 1, 20)]
    assert sorted(map(tuple, got.filter("v is not null").collect())) == said


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_page_files(spark, tmp_path):
    import numpy as np

    from pagemill.functions.page import BW1, Page
    from pagemill.sources import pages
    from pagemill.sources.codecs import bmp, tiff

    p = Page(np.eye(6, dtype=np.uint8), BW1, 300, 300)
    (tmp_path / "a.TIF").write_bytes(tiff.write([p, p], tiff.G4))
    (tmp_path / "b.bmp").write_bytes(bmp.write(p))
    (tmp_path / "c.txt").write_text("no page")
    rows = pages.read_pages(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.page_index) for r in rows) == [("a.TIF", 0), ("a.TIF", 1), ("b.bmp", 0)]
    assert pages.read_tags(spark, str(tmp_path)).filter("width = 6").count() == 2
