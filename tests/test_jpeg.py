"""JPEG data that another encoder made is whole; cut and broken data is not."""

import random

import pytest

from quire.operators import archive as A
from quire.sources import books as K, jpeg as J


def encoded(spark, width, height, grey=False, progressive=False, quality=0.8, seed=1):
    """An image of noise and steps, by the JVM's encoder."""
    jvm = spark._jvm
    kinds = jvm.java.awt.image.BufferedImage
    image = kinds(width, height, kinds.TYPE_BYTE_GRAY if grey else kinds.TYPE_INT_RGB)
    rng = random.Random(seed)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, (x * 5 % 256) << 16 | (y * 3 % 256) << 8 | rng.randrange(256))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    if progressive:
        param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


@pytest.fixture(scope="module")
def images(spark):
    return {(w, h, grey, progressive): encoded(spark, w, h, grey, progressive) for w, h, grey in ((1, 1, True), (17, 9, False), (40, 33, False), (33, 40, True)) for progressive in (False, True)}


def test_whole_images(images):
    for (w, h, _, _), data in images.items():
        assert K.probe_image(data) == ("image/jpeg", "jpg", w, h, None)


def test_cut_images(images):
    """Cut anywhere before the last of the coded data, an image is refused."""
    for key, data in images.items():
        last = data.rfind(b"\xff\xda")
        for at in {*range(4, last + 10, 7), *range(last + 10, len(data) - 24, 11)}:
            assert K.probe_image(data[:at])[4], (key, at, len(data))


def test_broken_images(images):
    """Bytes of the coded data exchanged: many are found out (others still make codes that fill the blocks), and none does harm."""
    rng = random.Random(5)
    data = images[40, 33, False, False]
    start = data.rfind(b"\xff\xda") + 14
    found = 0
    for _ in range(200):
        bad = bytearray(data)
        for _ in range(8):
            bad[rng.randrange(start, len(bad) - 2)] = rng.randrange(256)
        found += K.probe_image(bytes(bad))[4] is not None
    assert found > 60


def test_signature_alone_is_no_image():
    fake = bytes([0xFF, 0xD8, 0xFF, 0xC0, 0, 0x0B, 8, 0, 1, 0, 1, 1, 1, 0x11, 0, 0xFF, 0xD9])
    assert K.probe_image(fake)[4] == "no data"
    assert K.probe_image(b"\xff\xd8\xff\xda\x00\x02")[4] == "no frame"


def test_broken_tables(images):
    data = images[17, 9, False, False]
    table, frame = data.index(b"\xff\xc4"), data.index(b"\xff\xc0")
    counts = bytearray(data)
    counts[table + 5] = 9  # nine codes of one bit
    assert K.probe_image(bytes(counts))[4] in ("a table of too many codes", "broken code table")
    without = data[:table] + data[table + 2 + int.from_bytes(data[table + 2 : table + 4], "big") :]
    assert K.probe_image(without)[4] in ("a table is missing", "a code that no table has")
    large = bytearray(data)
    large[frame + 5 : frame + 9] = b"\xff\xff\xff\xff"
    assert K.probe_image(bytes(large))[4] == "too large" and 0xFFFF * 0xFFFF > A.MAX_PIXELS
    twelve = bytearray(data)
    twelve[frame + 4] = 12
    assert K.probe_image(bytes(twelve))[4] == "unsupported frame"


def test_restarts(images):
    """An interval that is told but not kept is refused; stretches are parted at restart markers."""
    data = images[40, 33, False, False]
    scan = data.rfind(b"\xff\xda")
    assert K.probe_image(data[:scan] + b"\xff\xdd\x00\x04\x00\x01" + data[scan:])[4] == "data ends early"
    assert J._stretches(b"ab\xff\x00c\xff\xd0d\xff\xff\xd9", 0) == ([b"ab\xff\x00c", b"d\xff"], 9)
