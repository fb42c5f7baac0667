"""Image files through Spark's image source and the pixel kernel."""

import struct
import zlib

from quire.operators import scans
from quire.sources import files, sinks


def png(width, height, pixel):
    """A grey PNG; ``pixel(x, y)`` gives 0-255."""
    raw = b"".join(b"\0" + bytes(pixel(x, y) for x in range(width)) for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_profiles(spark, tmp_path):
    folder = tmp_path / "lib" / "book1"
    folder.mkdir(parents=True)
    (folder / "white.png").write_bytes(png(60, 40, lambda x, y: 255))
    (folder / "text.png").write_bytes(png(40, 60, lambda x, y: 0 if y % 6 == 0 and x % 2 else 255))
    (folder / "border.png").write_bytes(png(40, 60, lambda x, y: 0 if x < 4 else 255))
    (folder / "broken.png").write_bytes(b"no image")
    images = files.read_images(spark, str(tmp_path / "lib"))
    assert {r.book_id for r in images.select("book_id").collect()} == {"book1"}
    assert {r.image.origin.rsplit("/", 1)[1]: r.error for r in images.collect() if r.error} == {"broken.png": "not an image"}
    sound = images.where("error IS NULL")
    rows = scans.quality_rule(scans.blank_rule(scans.scan_profile(sound.select("image.*")))).collect()
    got = {r.origin.rsplit("/", 1)[1]: r for r in rows}
    assert set(got) == {"white.png", "text.png", "border.png"}
    assert got["white.png"].is_blank and got["white.png"].is_landscape and got["white.png"].needs_rotation
    assert got["text.png"].text_detected and not got["text.png"].is_blank
    assert got["border.png"].border_share == 0.25 and got["white.png"].border_share == 0


def test_samples_by_class(spark, tmp_path):
    rows = spark.createDataFrame([(1, "XIV"), (2, ""), (3, None), (4, "xiv")], "sample_id int, label string")
    sinks.write_samples(rows, str(tmp_path / "samples"))
    counts = {r.class_label: r["count"] for r in spark.read.parquet(str(tmp_path / "samples")).groupBy("class_label").count().collect()}
    assert counts == {"xiv": 2, "none": 2}
