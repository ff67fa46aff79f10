"""Line order when files are split over many tasks (D21): tiny splits force it."""

import os

import pytest

from benchlens.sources import files as S
from benchlens.sources.lines import file_lines


@pytest.fixture()
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_line_numbers_exact_across_splits(spark, tmp_out, tiny_splits):
    _w(f"{tmp_out}/l/big.log", "".join(f"row {i:05d}\n" for i in range(1, 3001)))
    _w(f"{tmp_out}/l/small.log", "a\nb\n")
    df = file_lines(spark, f"{tmp_out}/l")
    assert spark.read.text(f"{tmp_out}/l").rdd.getNumPartitions() > 10
    got = {(os.path.basename(r.file), r.line_no): r.text for r in df.collect()}
    assert all(got[("big.log", i)] == f"row {i:05d}" for i in range(1, 3001))
    assert got[("small.log", 1)] == "a" and got[("small.log", 2)] == "b" and len(got) == 3002


def test_header_bound_scan_across_splits(spark, tmp_out, tiny_splits):
    rows = "".join(f"p{i},{i}.5,0.99\n" for i in range(2000))
    _w(f"{tmp_out}/c/big.csv", "PROGNAME,CPUTIME,RSQR_TIME_FIT\n" + rows)
    got = S.scan_results(spark, f"{tmp_out}/c").collect()
    assert len(got) == 2000 and {r.program for r in got} == {f"p{i}" for i in range(2000)}
    assert all(r.cpu == float(r.program[1:]) + 0.5 for r in got)


def test_fasta_across_files_and_splits(spark, tmp_out, tiny_splits):
    seq = "".join("ACGT"[(i * 7) % 4] for i in range(6000))
    lines = [seq[i:i + 60] for i in range(0, len(seq), 60)]
    _w(f"{tmp_out}/f/part-0.fa", ">ONE x\n" + "\n".join(lines[:50]) + "\n")
    _w(f"{tmp_out}/f/part-1.fa", "\n".join(lines[50:]) + "\n>TWO y\nAC\n")
    got = S.scan_fasta(spark, f"{tmp_out}/f", ">ONE").orderBy("line_pos").collect()
    assert [r.line_pos for r in got] == list(range(1, len(lines) + 1))
    assert "".join(r.seq for r in got) == seq
