"""Large CSV files in chunks: whatever the cuts, the rows are those of one parse."""

import random

import pytest

from loomspan.sources import files


def rows_of(spark, path):
    return [r["cells"] for r in files.toggling_csv(spark, str(path)).orderBy("file", "block", "line").collect()]


@pytest.mark.parametrize("cut", [40, 1000, 1 << 20])
def test_any_cut_gives_the_same_rows(spark, tmp_path, cut):
    rng = random.Random(cut)
    pieces = ["a", "é,", ",", '"', '""', "\n", "\r\n", "\r", "long cell ", "🔥", '"quoted, ""text"" \n over lines"', "\n\n", " "]
    texts = ["\ufeff" + "".join(rng.choice(pieces) for _ in range(400)), "".join(rng.choice(pieces) for _ in range(300)), 'x,"never closed\n' + "y,z\n" * 60, "", "one", "plain,row\n" * 50, "\n\n,\n"]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for k, text in enumerate(texts):
            assert rows_of(spark, tmp_path / f"{k}.csv") == files.parse_csv(text), (cut, k)
        every = files.toggling_csv(spark, str(tmp_path))
        assert every.count() == sum(len(files.parse_csv(t)) for t in texts)
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


@pytest.mark.parametrize("sent", [0, 1 << 16])
def test_blocks_of_rows(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(files, "_CSV_BLOCK", 50)
    monkeypatch.setattr(files, "MAX_SENT", sent)
    text = "".join(f'{k},"x {k}\n",""\n' for k in range(300))
    (tmp_path / "b.csv").write_text(text)
    assert rows_of(spark, tmp_path / "b.csv") == files.parse_csv(text)
