"""Running numbers of text lines: over files, blocks of files, restarts and repeats."""

import os

from pyspark.sql import functions as F

from skysonde.sources import landing, messages
from skysonde.sources.storage import fresh_folder


def written(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write("".join(line + "\n" for line in lines))


def test_lines_of_files_cut_into_blocks_are_numbered_in_file_order(spark):
    path = fresh_folder(spark, "lines")
    files = {f"part-{n}": [f"{'*' if i % 3 else '#'}{n}-{i}" for i in range(4000)] for n in range(3)}
    for name, lines in files.items():
        written(path, name, lines)
    kept = [line for name in sorted(files) for line in files[name] if line.startswith("*")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert spark.read.text(path).select("_metadata.file_block_start").distinct().count() > 6
        got = messages.read_numbered_lines(spark, path, F.startswith("line", F.lit("*")), before=10)
        rows = got.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in rows] == kept
    assert [r.seq for r in rows] == list(range(11, 11 + len(kept)))
    joined = messages.BROADCAST_BLOCKS
    messages.BROADCAST_BLOCKS = 0
    try:
        again = messages.read_numbered_lines(spark, path, F.startswith("line", F.lit("*")), before=10)
        assert again.exceptAll(got).count() == 0 and again.count() == len(kept)
    finally:
        messages.BROADCAST_BLOCKS = joined


def test_a_modes_capture_keeps_usable_lines(spark):
    path = fresh_folder(spark, "capture")
    long = "8D" * 14
    written(path, "a", [f"*{long};", "noise", "*8D;", f"  *{long[:22]};  ", ""])
    written(path, "b", [f"*{long}"])
    got = messages.read_modes_capture(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.hex) for r in got] == [(1, long), (2, long[:22]), (3, long)]


def test_no_lines(spark):
    path = fresh_folder(spark, "empty")
    written(path, "a", [])
    assert messages.read_numbered_lines(spark, path).count() == 0


def test_arrivals_go_on_from_each_other_over_restarts(spark):
    def run(files):
        landed, table, mark = (fresh_folder(spark, n) for n in ("landed", "table", "mark"))
        for n, lines in enumerate(files):
            written(landed, f"{9 - n}.txt", lines)  # names against the order of arrival
            os.utime(f"{landed}/{9 - n}.txt", (1_700_000_000 + n, 1_700_000_000 + n))
            assert landing.number_arrivals(spark, landed, table, mark, True, files=1).awaitTermination(90)
        return table, [(r.seq, r.line) for r in spark.read.parquet(table).orderBy("seq").collect()]

    files = [["a", "b"], [], ["c"], ["d", "e", "f"]]
    table, got = run(files)
    assert got == list(enumerate("abcdef", 1)) == run(files)[1]
    # the last batch again, as after a failure
    last = spark.read.parquet(table).agg(F.max("batch")).first()[0]
    again = fresh_folder(spark, "again")
    written(again, "6.txt", ["d", "e", "f"])
    landing._number(messages.with_place(spark.read.text(again)), last, table)
    assert [(r.seq, r.line) for r in spark.read.parquet(table).orderBy("seq").collect()] == got
