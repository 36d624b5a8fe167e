"""Image sizes from headers, against files made by hand."""

import base64
import struct

from pyspark.sql import functions as F

from tessera.functions import images


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0"


def gif(w, h, v=b"89a"):
    return b"GIF" + v + struct.pack("<HH", w, h) + b"\xf7\0\0"


def jpeg(w, h, frame=0xC0, before=()):
    head = b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in before)
    return head + b"\xff" + bytes([frame]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"rest"


CASES = [
    (png(1, 2), "png", 1, 2), (png(100_000, 70_000), "png", 100_000, 70_000), (gif(513, 258), "gif", 513, 258), (gif(5, 6, b"87a"), "gif", 5, 6),
    (jpeg(640, 480), "jpeg", 640, 480), (jpeg(65_535, 1, 0xC2, [(0xE0, b"JFIF\0"), (0xE1, b"\xff\xc0" * 30_000), (0xC4, b"huffman"), (0xFE, b"")]), "jpeg", 65_535, 1),
    (b"\xff\xd8\xff\xff\xff\xc0" + struct.pack(">HBHH", 17, 8, 3, 4), "jpeg", 4, 3), (png(1, 2)[:20], None, None, None), (png(4_000_000_000, 2), None, None, None), (jpeg(7, 8)[:8], None, None, None), (b"\xff\xd8", None, None, None), (b"BM text", None, None, None), (b"", None, None, None), (None, None, None, None),
]


def test_sizes(spark):
    df = spark.createDataFrame([(i, None if c[0] is None else bytearray(c[0])) for i, c in enumerate(CASES)], "i int, data binary")
    got = df.select("i", images.size(F.col("data")).alias("s")).orderBy("i").collect()
    assert [tuple(r.s) for r in got] == [c[1:] for c in CASES]


def test_base64(spark):
    text = base64.b64encode(png(3, 4)).decode()
    rows = [text, f"data:image/png;base64,{text}", f"data:image/png;charset=x;base64,{text[:10]}\n{text[10:]}", "no base64!", "", None]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select(images.from_base64(F.col("t")).alias("b")).collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == [png(3, 4)] * 3 + [None, b"", None]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png(8, 9))
    (tmp_path / "sub" / "b.jpg").write_bytes(jpeg(10, 11))
    (tmp_path / "c.txt").write_text("no picture")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.width, r.height) for r in images.files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.png": ("png", 8, 9), "b.jpg": ("jpeg", 10, 11), "c.txt": (None, None, None)}
    assert images.files(spark, f"file://{tmp_path}", "*.png").count() == 1
