"""A folder of parsed documents: what is written is read back, and pages that nobody asks for are not opened."""

import pyarrow.parquet as pq
import pytest

from inkwell.plans import process
from inkwell.sources import parsed as R


@pytest.fixture()
def folder(spark, tmp_path):
    docs = [f"d{i:02d}" for i in range(12)]
    sources = spark.createDataFrame([(d, f"{d}.pdf", f"h{d}", 101 if d == "d03" else 4) for d in docs], "doc_id string, source_name string, source_hash string, total_pages int")
    pages = spark.createDataFrame([(d, p, f"# {d} ü {p}", 50.0, 60.0) for d in docs for p in (1, 2, 4)], R.TABLES["pages"])
    items = spark.createDataFrame([(d, p, i, f"text {i}", 1.0 * i, 2.0, 3.0, 4.5) for d in docs for p in (1, 4) for i in range(3)], R.TABLES["items"])
    blocks = spark.createDataFrame([(d, 2, 0, "table", None, 0.0, 0.0, 1.0, 1.0) for d in docs], R.TABLES["blocks"])
    shots = spark.createDataFrame([(d, p, 2, 1, bytes([p] * 6)) for d in docs for p in (1, 2)] + [("d00", 4, 0, 0, b"")], R.TABLES["screenshots"])
    path = f"{tmp_path}/parsed"
    R.write_parsed(R.pack_pages(sources, pages, items, blocks, shots), path)
    return path, {"documents": sources, "pages": pages, "items": items, "blocks": blocks, "screenshots": shots}


def rows(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("filters", ["false", "true"])
def test_what_is_written_is_read(spark, folder, filters):
    path, tables = folder
    spark.conf.set("spark.sql.python.filterPushdown.enabled", filters)
    try:
        for name, want in tables.items():
            got = R.read_parsed(spark, path, name)
            assert got.columns == want.columns
            assert rows(got) == rows(want), name
        own = R.read_parsed(spark, path, "items").where("doc_id IN ('d01', 'd07') AND page > 1 AND idx <> 1")
        assert rows(own) == rows(tables["items"].where("doc_id IN ('d01', 'd07') AND page > 1 AND idx <> 1"))
        assert rows(R.read_parsed(spark, path, pages="2-3,4").where("doc_id >= 'd10'")) == rows(tables["pages"].where("page IN (2, 4) AND doc_id >= 'd10'"))
        assert R.read_parsed(spark, path).where("doc_id = 'nobody'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def spoil(path, page):
    """Overwrite the bodies of all other pages."""
    import glob

    for file in glob.glob(f"{path}/manifest/*.parquet"):
        for r in pq.read_table(file).to_pylist():
            if r["page"] != page:
                with open(f"{path}/bodies/{r['file']}", "r+b") as f:
                    f.seek(r["body_at"])
                    f.write(b"?" * r["body_size"])


def test_other_pages_are_not_opened(spark, folder):
    path, tables = folder
    spoil(path, 4)
    assert rows(R.read_parsed(spark, path, "items", pages="4")) == rows(tables["items"].where("page = 4"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert rows(R.read_parsed(spark, path).where("page = 4")) == rows(tables["pages"].where("page = 4"))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    with pytest.raises(Exception, match="JSON|Expecting"):
        R.read_parsed(spark, path).collect()
    # Counts need no page at all.
    counts = R.read_parsed(spark, path, "documents").select("doc_id", "total_pages")
    wanted = spark.createDataFrame([("d00", [5]), ("d01", None)], "doc_id string, selected array<int>")
    got = {r.doc_id: r.problem for r in process.preflight(counts, wanted).collect()}
    assert "beyond" in got["d00"] and got["d01"] is None and "more than 100" in got["d03"] and len(got) == 12


def test_row_groups_are_pruned():
    bounds = R._Bounds("3-4")
    assert bounds.may("page", 1, 3) and not bounds.may("page", 5, 9)
    assert bounds.add(R.EqualTo(("doc_id",), "m")) and not bounds.add(R.EqualTo(("text",), "m"))
    assert bounds.may("doc_id", "a", "z") and not bounds.may("doc_id", "n", "z") and bounds.lets("m", 4) and not bounds.lets("m", 5) and not bounds.lets(None, 4)


def test_unknown_table(spark, folder):
    with pytest.raises(Exception, match="unknown table"):
        R.read_parsed(spark, folder[0], "nothing")
