"""Archives as a source: members, byte ranges, odd archives."""

import random
import zipfile

import pytest

from biblioloom.sources import archive, metadata


def lines_in(text):
    rows = text.split("\n")
    return rows[:-1] if rows[-1] == "" else rows


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_ranges_hold_every_line_once(tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(archive, "PIECE", 16)
    r = random.Random(range_bytes)
    texts = {f"m{i}": "\n".join("x" * r.choice([0, 1, 3, 20, 50]) + str(k) for k in range(12)) + r.choice(["", "\n", "\n\n"]) for i in range(6)}
    texts |= {"empty": "", "newline": "\n", "one": "no end", "é": "é\nü"}
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for k, (name, t) in enumerate(texts.items()):
            z.writestr(name, t, compress_type=zipfile.ZIP_DEFLATED if k % 3 == 0 else zipfile.ZIP_STORED)
        z.writestr("folder/", "")
    got = {name: [] for name in texts}
    for part in archive.parts_of(path, range_bytes):
        for batch in archive.lines_of(part):
            got[part.member] += batch.column(2).to_pylist()
    assert got == {name: lines_in(t) for name, t in texts.items()}


def test_archives_are_read_in_many_tasks(spark, tmp_path):
    rows = ['{"id": "%d", "categories": "cs.LG cs.AI", "update_date": "2020-01-%02d"}' % (i, i % 28 + 1) for i in range(3000)] + ["{"]
    folder = tmp_path / "zips"
    folder.mkdir()
    for name, kind in (("a.zip", zipfile.ZIP_STORED), ("b.zip", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(folder / name, "w", kind) as z:
            z.writestr("lines.json", "\n".join(rows))
    (folder / "note.txt").write_text("no archive")
    table = archive.read_archives(spark, str(folder), 40_000)
    assert table.rdd.getNumPartitions() > 4 and table.count() == 2 * len(rows)
    assert tuple(metadata.watermark(table.select("value")).first()) == (6000, 2, "2020-01-28")
    assert metadata.read_snapshot(spark, str(folder / "b.zip")).count() == 3000 and metadata.read_snapshot(spark, str(folder / "a.zip"), limit=10).count() == 10
    empty = tmp_path / "none"
    empty.mkdir()
    assert archive.read_archives(spark, str(empty)).count() == 0
