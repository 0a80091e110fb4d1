"""Delivered files: each file's encoding from all its bytes, different headers, rejected lines."""

import pytest

from tidemark.params import CSV_HEADERS
from tidemark.sources import readings as R

LONG = {short: full for full, short in CSV_HEADERS.items()}
DATE, HOUR, GVS = (f'"{LONG[c]}"' for c in ("date_raw", "hour_raw", "gvs_m3"))


@pytest.fixture
def folder(tmp_path):
    def write(name, text, encoding):
        (tmp_path / name).write_bytes(text.encode(encoding))

    write("a.csv", f"﻿{DATE},{HOUR},{GVS}\n01.02.2024,0–1,1.5\n\n01.02.2024,1–2,2.5\n", "utf-8")
    write("b.csv", f"{DATE},{HOUR},{GVS}\r\n02.02.2024,0–1,3.5\r\n", "cp1251")
    body = "".join(f"03.02.2024,{h}-{h + 1},{h}.5,plain\n" for h in range(20))
    write("c.csv", f"date_raw,hour_raw,gvs_m3,note\n{body}03.02.2024,3–4,7.5,последний\n", "cp1251")
    write("d.csv", "hour_raw,date_raw,weekday\n\"4–5\",04.02.2024,x\n", "utf-8")
    write("e.csv", "", "utf-8")
    return tmp_path


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_every_row_of_a_mixed_folder(spark, folder):
    got = R.read_readings_csv(spark, str(folder))
    assert got.columns == ["date_raw", "hour_raw", "gvs_m3", "note", "weekday"]
    assert rows(got, "date_raw", "hour_raw", "gvs_m3", "note", "weekday") == sorted([
        ("01.02.2024", "0–1", 1.5, None, None), ("01.02.2024", "1–2", 2.5, None, None),
        ("02.02.2024", "0–1", 3.5, None, None),
        *[("03.02.2024", f"{h}-{h + 1}", h + 0.5, "plain", None) for h in range(20)],
        ("03.02.2024", "3–4", 7.5, "последний", None),
        ("04.02.2024", "4–5", None, None, None),
    ], key=str)


def test_small_splits_find_the_header(spark, folder):
    """A file in many splits has one header, in the split that starts at 0."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64b")
    try:
        assert R.read_readings_csv(spark, str(folder)).count() == 25
    finally:
        spark.conf.set(name, before)


def test_rejected_lines_are_returned(spark, folder):
    (folder / "f.csv").write_bytes(
        b"date_raw,hour_raw\n05.02.2024,0-1\n05.02.2024\n05.02.2024,1-2,3,4\n06.02.2024,\x981\n"
    )
    (folder / "g.csv").write_bytes("date_raw,hour_raw\n07.02.2024,0–1\n07.02.2024\n".encode())
    bad = R.rejected_lines(spark, str(folder))
    assert sorted((r["file"][-5:], r["line"], r["problem"]) for r in bad.collect()) == [
        ("f.csv", "05.02.2024", "fields"), ("f.csv", "05.02.2024,1-2,3,4", "fields"),
        ("f.csv", "06.02.2024,\x981", "encoding"), ("g.csv", "07.02.2024", "fields"),
    ]
    assert R.read_readings_csv(spark, str(folder)).count() == 27


def test_an_explicit_encoding_holds_for_all_files(spark, folder):
    forced = R.read_readings_csv(spark, str(folder / "c.csv"), encoding="windows-1251")
    assert forced.where("hour_raw = '3–4'").count() == 1
    wrong = R.read_readings_csv(spark, str(folder / "c.csv"), encoding="utf-8")
    assert wrong.where("hour_raw = '3–4'").count() == 0 and wrong.count() == 21
    with pytest.raises(ValueError):
        R.read_readings_csv(spark, str(folder), encoding="koi8-r")


def test_too_many_layouts_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "MOST_LAYOUTS", 2)
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"date_raw,extra{i}\n01.02.2024,1\n")
    with pytest.raises(ValueError, match="headers"):
        R.read_readings_csv(spark, str(tmp_path))
