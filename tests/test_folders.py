"""Folder trees and image headers: what is listed, what isn't, and what is refused without being decoded."""

import io
import os
import struct

import pytest
from pyspark.sql import functions as F

from curatrix.sources import catalog, folders, heads
from tests.test_sources import pictures, png  # noqa: F401


def tree(root):
    for name in ("a/x.txt", "a/.hidden/y.bin", "a/.Recovery/deep/z.txt", "a/b/c/w.TXT", "d/q.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    os.symlink(root / "d", root / "a" / "link")
    return str(root)


def short(rows, root):
    return sorted(r["path"].removeprefix(f"{root}/") for r in rows)


def test_entries_with_dates_kinds_and_what_cannot_be_read(spark, tmp_path):
    root = tree(tmp_path)
    os.utime(f"{root}/a/x.txt", (5, 7))
    found = folders.list_entries(spark, [f"{root}/a", f"{root}/a/b", f"{root}/A/b/c", f"{root}/none", f"{root}/a/link"]).collect()
    told = {r["path"].removeprefix(f"{root}/"): r for r in found}
    assert sorted(told) == ["a/.hidden", "a/.hidden/y.bin", "a/b", "a/b/c", "a/b/c/w.TXT", "a/link", "a/x.txt", "none"] and len(found) == len(told)
    x = told["a/x.txt"]
    assert (x["kind"], x["size"], x["modified_at"], x["accessed_at"], x["extension"], x["hidden"]) == ("file", 7, 7000, 5000, "txt", False) and x["created_at"] > 7000
    assert told["a/link"]["kind"] == "symlink" and told["a/.hidden"]["hidden"] and told["a/b/c/w.TXT"]["extension"] == "txt"
    assert told["none"]["error"] == "UNREADABLE"
    assert short(catalog.scan_catalog(spark, [root], recovery_dir=".x").collect(), root) == ["a/.Recovery/deep/z.txt", "a/.hidden/y.bin", "a/b/c/w.TXT", "a/x.txt", "d/q.txt"]
    assert tuple(catalog.scan_totals(spark, [f"{root}/a", f"{root}/none"], recovery_dir=".recovery").first()) == (3, 33, 1)


def test_a_pruned_folder_is_never_listed(tmp_path, monkeypatch):
    root, seen = tree(tmp_path), []
    listed = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: seen.append(p.removeprefix(f"{root}/")) or listed(p))
    for parts in (1, 3, 64):
        monkeypatch.setattr(folders, "PARTS", parts)
        reader = folders._Reader({"roots": root, "recovery": ".recovery"})
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(rows) == len({r[0] for r in rows}) == 10 and not any("Recovery" in r[0] for r in rows)
    assert seen and not any("Recovery" in p or "link" in p for p in seen)


def test_filters_are_applied_while_listing(spark, tmp_path):
    root = tree(tmp_path)
    plan = folders.list_entries(spark, [root], glob="*.t*", recovery_dir=".x").where("size >= 8 and kind = 'file'")
    assert short(plan.collect(), root) == ["a/.Recovery/deep/z.txt"]
    reader = folders._Reader({"roots": root})
    from pyspark.sql.datasource import GreaterThanOrEqual, StringContains

    kept = list(reader.pushFilters([GreaterThanOrEqual(("size",), 8), StringContains(("name",), "x")]))
    assert len(kept) == 1 and reader.filters[0][2] == 8


def bmp(width, height):
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54, 0, 54, 40, width, height, 1, 24, 0, 0, 0, 0, 0, 0)


def jpeg(width, height):
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 60_000) + bytes(59_998) + b"\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, height, width, 3)


IMAGES = {
    "png": struct.pack(">8sI4sIIBB", b"\x89PNG\r\n\x1a\n", 13, b"IHDR", 50_000, 50_000, 8, 2), "gif": b"GIF89a" + struct.pack("<HH", 320, 200) + b"\0\0", "bmp": bmp(20_000, 1), "jpeg": jpeg(640, 480),
    "webp": b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), "tiff": b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, 70, 0) + struct.pack(">HHII", 257, 4, 1, 30), "ico": struct.pack("<HHHBB", 0, 1, 1, 0, 48),
}
SIZES = {"png": (50_000, 50_000), "gif": (320, 200), "bmp": (20_000, 1), "jpeg": (640, 480), "webp": (100, 50), "tiff": (70, 30), "ico": (256, 48)}


@pytest.mark.parametrize("kind", sorted(IMAGES))
def test_sizes_of_headers(kind):
    data = IMAGES[kind] + bytes(32)
    assert heads.image_head(io.BytesIO(data))[:3] == (kind, *SIZES[kind])
    for n in (0, 1, 5, 11):
        assert heads.image_head(io.BytesIO(data[:n]))[1] is None


def test_large_images_are_refused_before_they_are_decoded(spark, pictures):  # noqa: F811
    (pictures / "claims.png").write_bytes(IMAGES["png"])
    (pictures / "wide.bmp").write_bytes(bmp(20_000, 1))
    (pictures / "words.jpg").write_text("this is not an image")
    (pictures / "heavy.png").write_bytes(b"\x89PNG" + bytes(3000))
    files = catalog.scan_catalog(spark, [str(pictures)])
    told = heads.image_heads(files, max_file_bytes=60_000)
    got = {r["path"].rpartition("/")[2]: r["error"] for r in told.collect()}
    assert got["claims.png"] == got["wide.bmp"] == "IMAGE_TOO_LARGE" and got["words.jpg"] == got["broken.png"] == got["heavy.png"] == "UNSUPPORTED_IMAGE" and got["scene.png"] is None
    assert {r["path"].rpartition("/")[2]: r["error"] for r in heads.image_heads(files.where("name = 'heavy.png'"), max_file_bytes=2000).collect()} == {"heavy.png": "IMAGE_TOO_LARGE"}
    images = catalog.read_images(spark, str(pictures), told)
    assert sorted(r["path"].rpartition("/")[2] for r in images.select("path").collect()) == ["clear.png", "scene.png"]
    assert images.where(F.col("height") < 0).isEmpty()
