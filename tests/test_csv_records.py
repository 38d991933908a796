"""CSV with quoted line breaks over splits of any size against the csv module."""

import csv
import random

import pytest

from incident_signals.sources.csv_records import _lines, read_records, splits_inside_quotes
from incident_signals.sources.reports import read_reports_csv


def rows(n, seed):
    rng = random.Random(seed)
    marks = ["plain", 'a "quoted" word', "line\nbreak", "\n\n", "comma, here", '"', "é中", "", "end\n", '""\n"']
    return [[f"R{i}", " ".join(rng.choice(marks) for _ in range(rng.randrange(6))) or "x", str(i % 2)] for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    def write(files, line_end="\n"):
        for i, content in enumerate(files):
            with open(tmp_path / f"part-{i}.csv", "w", newline="", encoding="utf-8") as file:
                writer = csv.writer(file, lineterminator=line_end)
                writer.writerow(["report_id", "description", "sif_label"])
                writer.writerows(content)
        return str(tmp_path)

    return write


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = {n: spark.conf.get(n) for n in names}

    def of(size, batch):
        for name, value in zip(names, (str(size), "0", str(batch))):
            spark.conf.set(name, value)

    yield of
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("size, batch", [(31, 10_000), (97, 3), (400, 1), (10_000_000, 7)])
def test_records_over_splits(spark, folder, small_splits, size, batch):
    data = [rows(60, 1), rows(5, 2), []]
    path = folder(data)
    small_splits(size, batch)
    assert (_lines(spark, path).select("file", "block").distinct().count() > 10) == (size < 100)
    if size < 100:
        assert splits_inside_quotes(_lines(spark, path)).count() > 3
    got = read_records(spark, path)
    assert sorted(next(csv.reader([r.record])) for r in got.where("NOT first").collect() if "\n" not in r.record) == sorted(
        r for part in data for r in part if "\n" not in r[1]
    )
    assert got.where("first").count() == 3
    table = read_reports_csv(spark, path)
    found = sorted((r.report_id, r.description, r.sif_label) for r in table.collect())
    assert found == sorted((a, b, int(c)) for part in data for a, b, c in part)


def test_windows_line_ends_and_one_long_record(spark, folder, small_splits):
    text = "x" * 500 + "\n" * 300 + '"y"'
    path = folder([[["R1", text, "1"], ["R2", "short", "0"]]], "\r\n")
    small_splits(64, 5)
    got = {r.report_id: (r.description, r.sif_label) for r in read_reports_csv(spark, path).collect()}
    assert got == {"R1": (text, 1), "R2": ("short", 0)}
