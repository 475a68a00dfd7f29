"""Markdown files as rows, and ceilings."""

import pytest
from pyspark.sql import functions as F

from fathomline.sources import markdown


def test_markdown_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in {"a.md": b"\xef\xbb\xbf# T\r\ntext\n", "deep/b.md": "é\n\nü".encode(), "bad.md": b"\xff\xfe", "none.md": b"", "blank.md": "　 \n".encode(), "big.md": b"x" * 101, "c.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.n_bytes, r.text, r.n_lines, r.problem) for r in markdown.markdown_files(spark, str(tmp_path), most_bytes=100).collect()}
    assert got == {  # none.md has no byte and no row
        "a.md": (13, "# T\r\ntext\n", 2, None), "b.md": (6, "é\n\nü", 3, None), "bad.md": (2, None, None, "not_utf8"), "blank.md": (5, None, None, "empty"), "big.md": (101, None, None, "too_large"),
    }


def test_limits(spark):
    images = spark.createDataFrame([(1, 60_000, 60_000, 1), (1, 2, 2, 30 << 20), (2, None, 5, None)], "doc_id long, width int, height int, n_bytes long")
    found = markdown.image_measures(images).withColumn("over", markdown.limits({k: F.col(k) for k in ("total_image_bytes", "images", "image_pixels", "image_bytes", "total_image_pixels")}, {"images": 1}))
    assert {r.doc_id: (r.images, r.image_pixels, r.over) for r in found.collect()} == {1: (2, 3_600_000_000, ["images", "image_pixels", "total_image_pixels", "image_bytes"]), 2: (1, None, [])}
    with pytest.raises(ValueError, match="no limits for pges"):
        markdown.limits({"pges": F.lit(1)})
