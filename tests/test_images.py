import struct
import zlib

import numpy as np
import pytest

from rowmill.errors import AvroError
from rowmill.operators import images


def png(width, height, depth, color, lines, *chunks):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(chunk(k, d) for k, d in chunks) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(
    ("depth", "line", "want"), [(1, b"\0\x50", [0, 255, 0, 255]), (2, b"\0\x1b", [0, 85, 170, 255]), (4, b"\0\x05\xaf", [0, 85, 170, 255]), (16, b"\0" + struct.pack(">4H", 0, 130, 257, 65535), [0, 130, 257, 65535])]
)
def test_gray(depth, line, want):
    assert images.decode(png(4, 1, depth, 0, line)).ravel().tolist() == want


def test_palette_and_transparency():
    got = images.decode(png(2, 1, 8, 3, b"\0\0\1", (b"PLTE", bytes([255, 0, 0, 0, 255, 0])), (b"tRNS", b"\0\x80")))
    assert got.reshape(-1, 4).tolist() == [[255, 0, 0, 0], [0, 255, 0, 128]]
    got = images.decode(png(4, 1, 8, 0, b"\0" + bytes([0, 128, 200, 255]), (b"tRNS", struct.pack(">H", 128))))
    assert got.reshape(-1, 2).tolist() == [[0, 255], [128, 0], [200, 255], [255, 255]]


def filtered(samples, kind):
    """Rows encoded with one filter, from the definition."""
    rows, step = samples.reshape(len(samples), -1).astype(int), samples.shape[2]
    out = b""
    for y, row in enumerate(rows):
        up = rows[y - 1] if y else np.zeros_like(row)
        line = [kind]
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), up[x], (up[x - step] if x >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append(int(v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out += bytes(line)
    return out


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize(("parts", "color"), [(1, 0), (3, 2), (4, 6)])
def test_filters(kind, parts, color):
    samples = np.random.default_rng(kind).integers(0, 256, (5, 7, parts)).astype(np.uint8)
    assert (images.decode(png(7, 5, 8, color, filtered(samples, kind))) == samples).all()


def test_text_is_grouped_and_bad_chunks_are_skipped():
    good = (b"iTXt", b"i\0\0\0\0\0" + "é".encode())
    data = png(1, 1, 8, 0, b"\0\0", good, (b"zTXt", b"z\0\0" + zlib.compress(b"zip")), (b"zTXt", b"bad\0\0xx"), (b"tEXt", b"t\0plain"))
    assert images.png_text(data) == [("t", "plain"), ("z", "zip"), ("i", "é")]


def test_limits_and_bad_data():
    data = images.encode_png(np.zeros((50, 50, 3), np.uint8))
    with pytest.raises(AvroError, match="limit"):
        images.decode(data, limit=1000)
    for n in (10, 40, 60):
        with pytest.raises(AvroError):
            images.decode(data[:n])
    with pytest.raises(AvroError):
        images.info(b"nothing")


def test_blend():
    px = np.array([[[255, 0, 0, 0], [10, 20, 30, 255]]], np.uint8)
    assert images.decode(images.encode_png(px), background_8=(1, 2, 3, 255), background_16=(0, 0, 0, 0)).tolist() == [[[1, 2, 3, 255], [10, 20, 30, 255]]]
    gray = np.array([[[9, 0]]], np.uint8)
    assert images.decode(images.encode_png(gray), background_8=(1, 2, 3, 200), background_16=(0, 0, 0, 0)).tolist() == [[[2, 200]]]


def test_other_formats_by_header():
    gif = b"GIF89a" + struct.pack("<HHB", 5, 6, 0x80) + b"\0\0" + bytes(6) + (b"," + bytes(9) + b"\2\1a\0") * 2 + b";"
    assert (images.info(gif)["width"], images.info(gif)["is_animated"]) == (5, True)
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 70, 0, 0, 54, 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0) + bytes([1, 2, 3, 4, 5, 6, 0, 0])
    assert images.decode(bmp).tolist() == [[[3, 2, 1], [6, 5, 4]]] and images.info(bmp)["color"] == "Rgb"
    jpeg = b"\xff\xd8\xff\xc0" + struct.pack(">HBHHB", 11, 8, 4, 3, 1) + b"\1\x11\0" + b"\xff\xd9"
    assert (images.info(jpeg)["width"], images.info(jpeg)["color"]) == (3, "L")
    ico = b"\0\0\1\0\1\0" + bytes([16, 16, 0, 0, 1, 0, 32, 0]) + bytes(8)
    assert images.info(ico)["width"] == 16
    webp = b"RIFF" + bytes(4) + b"WEBPVP8X" + struct.pack("<I", 10) + bytes([16, 0, 0, 0]) + (9).to_bytes(3, "little") + (4).to_bytes(3, "little")
    assert (images.info(webp)["width"], images.info(webp)["height"]) == (10, 5)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 7, 0) + struct.pack("<HHIHH", 257, 3, 1, 8, 0)
    assert (images.info(tiff)["width"], images.info(tiff)["height"]) == (7, 8)


def gif_codes(codes, size):
    """Codes of one width, low bit first, as sub-blocks."""
    n = sum(c << size * k for k, c in enumerate(codes))
    body = n.to_bytes(-(-len(codes) * size // 8), "little")
    return bytes([len(body)]) + body + b"\0"


def test_gif_frames():
    head = b"GIF89a" + struct.pack("<HHB", 2, 2, 0x81) + b"\0\0" + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    image = lambda x, y, w, h, codes: b"," + struct.pack("<HHHHB", x, y, w, h, 0) + b"\2" + gif_codes([4, *codes, 5], 3)
    control = lambda packed, delay, clear: b"!\xf9\4" + struct.pack("<BHB", packed, delay, clear) + b"\0"
    data = head + control(4, 5, 0) + image(0, 0, 2, 2, [0, 4, 1, 4, 2, 4, 3]) + control(9, 7, 3) + image(1, 1, 1, 1, [3]) + b";"
    (a, first), (b, second) = images.frames(data)
    assert (first, second) == (50, 70) and (a == b).all()
    assert a[..., :3].reshape(-1, 3).tolist() == [[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]] and (a[..., 3] == 255).all()
    assert (images.decode(data) == a).all()
    with pytest.raises(AvroError):
        images.frames(head + image(0, 0, 2, 2, [0, 4, 1, 4, 2, 4, 3]) + b";")
    with pytest.raises(AvroError):
        images.decode(data[:40])


def tiff_file(px, packing=1, body=None, extra=(), meaning=2):
    h, w, c = px.shape
    body = px.tobytes() if body is None else body
    kinds = [(256, w), (257, h), (258, px.dtype.itemsize * 8), (259, packing), (262, meaning), (273, 8), (277, c), (278, h), (279, len(body)), (339, 3 if px.dtype.kind == "f" else 1), *extra]
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(kinds))
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(kinds)) + entries + bytes(4)


def test_tiff():
    rng = np.random.default_rng(3)
    for kind, c in ((np.uint8, 3), (np.uint16, 1), (np.float32, 3)):
        px = (rng.random((4, 5, c)) * 200).astype(kind)
        assert (images.decode(tiff_file(px, meaning=2 if c == 3 else 1)) == px).all()
        assert (images.decode(tiff_file(px, 8, zlib.compress(px.tobytes()), meaning=2 if c == 3 else 1)) == px).all()
    row = np.array([[[7], [7], [7], [1], [2]]], np.uint8)
    assert images.decode(tiff_file(row, 32773, bytes([254, 7, 1, 1, 2]), meaning=1)).ravel().tolist() == [7, 7, 7, 1, 2]
    codes = [256, 7, 7, 7, 1, 2, 257]
    packed = sum(v << 9 * (len(codes) - 1 - k) for k, v in enumerate(codes)) << 1
    assert images.decode(tiff_file(row, 5, packed.to_bytes(8, "big"), meaning=1)).ravel().tolist() == [7, 7, 7, 1, 2]
    alpha = np.array([[[200, 100, 0, 128]]], np.uint8)
    assert images.decode(tiff_file(alpha, extra=[(338, 2)])).ravel().tolist() == [100, 50, 0, 128]
    with pytest.raises(AvroError):
        images.decode(tiff_file(row, meaning=1)[:40])
    assert images.info(tiff_file(px))["pixel_type"] == "F32"


def test_jpeg_samples_by_the_jvm(spark, tmp_path):
    """A red and a green image as JPEG, and a PNG with alpha, in the order red, green, blue, alpha; a file that is no image is left out."""
    jvm = spark.sparkContext._jvm
    for name, rgb in (("red", 0xFF0000), ("green", 0x00FF00)):
        image = jvm.java.awt.image.BufferedImage(16, 8, 1)
        for x in range(16):
            for y in range(8):
                image.setRGB(x, y, rgb)
        assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / f"{name}.jpg")))
    (tmp_path / "a.png").write_bytes(images.encode_png(np.array([[[10, 20, 30, 40]]], np.uint8)))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.jvm_samples(spark, str(tmp_path)).collect()}
    assert set(got) == {"red.jpg", "green.jpg", "a.png"}
    red, green = (np.frombuffer(got[n]["samples"], np.uint8).reshape(8, 16, 3) for n in ("red.jpg", "green.jpg"))
    assert (got["red.jpg"]["width"], got["red.jpg"]["height"]) == (16, 8)
    assert red[..., 0].min() > 230 and red[..., 1:].max() < 30 and green[..., 1].min() > 200
    assert got["a.png"]["samples"] == bytes([10, 20, 30, 40])


def test_samples_come_many_to_a_batch(spark, monkeypatch):
    rows = [(k, images.encode_png(np.full((k % 3 + 1, 2, 1), k, np.uint8))) for k in range(40)] + [(40, None), (41, b"bad")]
    df = spark.createDataFrame(rows, "k long, content binary").coalesce(1)
    got = {r["k"]: r for r in images.image_samples(df, "k").collect()}
    assert set(got) == {*range(40), 41} and got[41]["samples"] is None and got[41]["error"]
    assert all(got[k]["samples"] == [float(k)] * (2 * (k % 3 + 1)) and got[k]["strides"]["height"] == 2 for k in range(40))
