import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark import schemas, session, workers
from quillspark.functions import layout, rules
from quillspark.operators import listing
from quillspark.sources import images, ink, tables


def png(pixels):
    """Bytes of an RGB picture from rows of (r, g, b)."""

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(shift=0):
    return [[((x * 7 + shift) % 256, (y * 5) % 256, (x * y) % 256) for x in range(48)] for y in range(40)]


INK = """<?xml version="1.0" encoding="UTF-8"?>
<ink xmlns="http://www.w3.org/2003/InkML">
<annotation type="writer">w0</annotation><annotation>no type</annotation>
{label}<annotation type="writer">w1</annotation>
<trace id="a">1.5 2 0,3 4.25 0.5,5 6 1</trace>
<trace id="b">9 9 2</trace>
</ink>"""


def test_ink_files(spark, tmp_path):
    for split, name, label in (("train", "x", "\\frac{1}{2}"), ("valid", "y", None)):
        (tmp_path / split).mkdir()
        note = f'<annotation type="label">{label}</annotation>' if label else ""
        (tmp_path / split / f"{name}.inkml").write_text(INK.format(label=note))
    (tmp_path / "train" / "skip.txt").write_text("no ink")
    df = ink.read_ink(spark, str(tmp_path))
    got = {r.split: r for r in df.collect()}
    assert got["train"].label == "\\frac{1}{2}" and got["valid"].label is None
    assert got["train"].annotations == {"label": "\\frac{1}{2}", "writer": "w1"}
    points = {(r.stroke, r.point): (r.x, r.y, r.t) for r in ink.points(df, ["split"]).where("split = 'train'").collect()}
    assert points == {(0, 0): (1.5, 2, 0), (0, 1): (3, 4.25, 0.5), (0, 2): (5, 6, 1), (1, 0): (9, 9, 2)}
    box = ink.bounds(ink.points(df, ["split"]), ["split"]).where("split = 'valid'")
    row = box.select(layout.canvas_side(F.col("xmin"), F.col("xmax")).alias("w"), layout.canvas_shift(F.col("xmin")).alias("s")).first()
    assert (row.w, row.s) == (int(9 - 1.5 + 20), 8.5)


def test_images_and_hashes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(picture()))
    (tmp_path / "b.png").write_bytes(png(picture()))
    tweaked = picture()
    tweaked[3][4] = (0, 0, 0)
    (tmp_path / "c.png").write_bytes(png(tweaked))
    (tmp_path / "d.png").write_bytes(png([row[::-1] for row in picture(90)]))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG not really")
    df = images.read_images(spark, str(tmp_path)).select("path", images.perceptual_hash(F.col("image")).alias("h"))
    got = {r.path.rsplit("/", 1)[1]: r.h for r in df.collect()}
    assert len(got) == 5 and got["broken.png"] is None
    assert got["a.png"] == got["b.png"] and len(got["a.png"]) == 16
    differing = bin(int(got["a.png"], 16) ^ int(got["c.png"], 16)).count("1")
    assert differing <= 4 < bin(int(got["a.png"], 16) ^ int(got["d.png"], 16)).count("1")


def test_pixel_hash_equals_plain_sums():
    import math
    import random

    rng = random.Random(2)
    height, width = 64, 96
    grey = [[rng.randrange(256) for _ in range(width)] for _ in range(height)]
    small = [[sum(grey[2 * y + a][3 * x + b] for a in range(2) for b in range(3)) / 6 for x in range(32)] for y in range(32)]

    def coefficient(u, v):
        return sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64)
                   for y in range(32) for x in range(32))

    block = [coefficient(u, v) for u in range(8) for v in range(8)]
    middle = sum(sorted(block)[31:33]) / 2
    want = f"{int(''.join(str(int(c > middle)) for c in block), 2):016x}"
    data = bytes(p for row in grey for p in row)
    assert workers.pixel_hash(height, width, 1, data, 8) == want
    coloured = bytes(v for row in grey for p in row for v in (p, p, p))
    assert workers.pixel_hash(height, width, 3, coloured, 8) == want
    assert workers.pixel_hash(-1, -1, 3, b"", 8) is None


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["NA", "", None, "a,b", 'say "hi"', "line\nend", " outer ", "\\frac{1}{2}\\", "null", "tab\t"]
    df = spark.createDataFrame([(f"p{i}", t, "train", i if i % 2 else None) for i, t in enumerate(texts)], schemas.REGISTRY)
    tables.write_csv(df, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), schemas.REGISTRY)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "reg")
    rows = spark.createDataFrame([("a", "x", "train", 1)], schemas.REGISTRY)
    calls = []

    def ingest():
        calls.append(1)
        return rows

    assert tables.read_or_create(spark, root, ingest).count() == 1
    now = tables.read_or_create(spark, root, ingest)
    assert len(calls) == 1
    more = now.union(spark.createDataFrame([("b", "y", "valid", None)], schemas.REGISTRY))
    assert tables.save_version(more, root) == 2
    assert tables.load_version(spark, root).count() == 2 and tables.load_version(spark, root, number=1).count() == 1


def test_class_folders(spark, tmp_path):
    for split, score, name in (("train", 1, "a"), ("train", 3, "b"), ("valid", 2, "c")):
        folder = tmp_path / "files" / split / str(score)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.png").write_bytes(png([[(1, 2, 3)]]))
    listed = tables.list_class_files(spark, str(tmp_path / "files")).collect()
    assert sorted((r.split, r.score) for r in listed) == [("train", 1), ("train", 3), ("valid", 2)]
    rows = spark.createDataFrame([("a", "x", "train", 1), ("b", "y", "valid", None), ("c", "z", "valid", 2)], schemas.REGISTRY)
    tables.write_class_folders(rows, str(tmp_path / "rows"))
    assert (tmp_path / "rows" / "split=train" / "score=1").is_dir()
    valid = tables.read_class_folders(spark, str(tmp_path / "rows"), "valid")
    assert [tuple(r) for r in valid.select("img_path", "score").collect()] == [("c", 2)]


def test_export_without_rows_is_empty(spark):
    gens = spark.createDataFrame([], schemas.GENERATION)
    assert tables.export_gens(gens, "s").count() == 0


def test_pages_and_id_filter(spark):
    df = spark.range(25).select(
        "id", F.timestamp_seconds(F.col("id") % 7).alias("request_at"), F.lit("s").alias("session_id"))
    order = [i for _, i in sorted(((i % 7, i) for i in range(25)), reverse=True)]
    assert [r.id for r in listing.session_page(df, "s", "request_at", 3, 10).collect()] == order[20:]
    assert len(listing.session_rows(df, "s", "request_at", ids=[]).collect()) == 25
    assert [r.id for r in listing.session_rows(df, "s", "request_at", ids=[3, 9]).collect()] == [3, 9]
    assert listing.session_rows(df, "other", "request_at").count() == 0


def test_status_and_rules(spark):
    df = spark.createDataFrame([("x", True), ("", True), (None, False), (None, None)], "r string, f boolean")
    got = [r.s for r in df.select(rules.status(F.col("r"), F.col("f")).alias("s")).collect()]
    assert got == ["response", "failed", "loading", "loading"]
    urls = ["https://a.example.com/x.png?q=1#f", "http://a.example:8080", "a.b/c", "http://", "", None, "http://no dots/", "ftp://h.org"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.e for r in df.select(rules.url_error(F.col("u")).alias("e")).collect()]
    assert got == [None, None, "Invalid image URL", "Invalid image URL", "No image URL provided", "No image URL provided",
                   "Invalid image URL", None]
    good = ["http://10.1.2.3/x.png", "http://[::1]/a.png", "https://[2001:db8::8a2e:370:7334]:8080/", "https://user:pw@example.org/a.png",
            "https://münchen.de/a.png", "https://xn--mnchen-3ya.de/", "http://localhost:3000/a", "https://例え.テスト/a"]
    bad = ["http://256.1.1.1/", "http://[::1", "http://[1:2:3]/", "http://a b.de/", "javascript://a.de", "http://-a.de/", "http://user@/x", "http://1.2.3/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad)], "i int, u string")
    got = [r.e is None for r in df.select("i", rules.url_error(F.col("u")).alias("e")).orderBy("i").collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_a_changed_model_answers_for_itself(spark):
    from quillspark.operators import scoring

    df = spark.createDataFrame([("a",), ("b",)], "img_path string").coalesce(1)
    for answer in ("A", "B", "A"):
        factory = lambda answer=answer: lambda values: [answer for _ in values]
        out = scoring.score_batch(df, factory, "m", ["img_path"], "img_path", "string")
        assert {r.answer for r in out.collect()} == {answer}


def test_two_writers_do_not_share_a_version(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "train", 1)], "img_path string, label string, split string, score int")
    root = str(tmp_path / "registry")
    assert tables.save_version(df, root) == 1
    (tmp_path / "registry" / "v000002").mkdir()  # another writer at work
    assert tables.save_version(df, root) == 3 and tables.versions(spark, root) == [1, 3]


def test_size_limit_counts_text_and_first_rule_wins(spark):
    df = spark.createDataFrame(
        [("a.PNG", "AAAA", 1, 1), ("a.txt", "!!", 1, 1), ("a.png", "!!", 9999, 1), ("a.gif", "AAAAAAAA", 9999, 1), ("b.bmp", "AAAA", 1, 4097),
         ("b.tiff", "AAAA", 4096, 4096)],
        "f string, b string, w int, h int")
    error = rules.upload_error(F.col("f"), F.col("b"), F.col("w"), F.col("h"), max_chars=4)
    assert [r.e for r in df.select(error.alias("e")).collect()] == [
        None, "Invalid file type. Please upload an image.", "Image cannot be decoded", "File size exceeds 20MB limit.",
        "Image dimensions exceed 4096x4096 pixels limit.", None]


def test_grid_equals_integer_arithmetic(spark):
    import math

    df = spark.range(1, 60).select(F.col("id").cast("int").alias("n"))
    cols = layout.grid_columns(F.col("n"))
    out = df.select("n", cols.alias("c"), layout.grid_rows(F.col("n"), cols).alias("r"), layout.tile_side(F.lit(3010), cols).alias("t"),
                    layout.jitter("x", layout.tile_side(F.lit(3010), cols), F.col("n")).alias("j"))
    for row in out.collect():
        c = math.ceil(math.sqrt(row.n))
        assert (row.c, row.r, row.t) == (c, math.ceil(row.n / c), 3010 // c)
        assert -row.t // 8 <= row.j <= row.t // 8


def test_scratch_is_the_shared_folder(spark):
    assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert session.scratch_folder(spark, "x").startswith(session.scratch_root(spark))


def test_jdbc_options_are_cut_by_id(spark):
    with pytest.raises(Exception):
        tables.read_jdbc(spark, "jdbc:nosuch://host/db", "gen", 0, 100, 4)
