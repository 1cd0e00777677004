"""Records of graph text by their places: byte ranges, long lines, and no byte read beside those asked for."""

import io

import pytest
from pyspark.errors import PySparkException

from graphloom.sources import gfa
from graphloom.sources import keyed_text as K


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


LINES = [b"H\tVN:Z:1.0", b"S\ta\tACGT\tLN:i:4", b"", b"S\tb\t*", b"L\ta\t+\tb\t+\t0M", b"S\tc\t" + b"G" * 500, b"S\tlong name\tTT\r", b"S\td"]


@pytest.mark.parametrize("chunk", [3, 7, 64, 1 << 20])
@pytest.mark.parametrize("split", [1, 5, 100, 10_000])
@pytest.mark.parametrize("end", [b"", b"\n"])
def test_every_line_once(monkeypatch, chunk, split, end):
    monkeypatch.setattr(K, "CHUNK", chunk)
    text = b"\n".join(LINES) + end
    found = [x for a in range(0, len(text), split) for x in K.lines_from(Bytes(text), len(text), a, min(len(text), a + split))]
    assert [text[o : o + n] for o, n, _ in found] == LINES and [h for *_, h in found] == LINES
    assert len({o for o, *_ in found}) == len(LINES)


def graph(n):
    return [f"S\tn{k}\t{'ACGT'[k % 4] * (1 + k % 50)}" for k in range(n)]


def test_same_as_a_scan(spark, tmp_path):
    rows = graph(3000) + ["S\tn7\tTWICE", "S\tstar\t*", "# c", "P\tp\tn1+\t*"]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.gfa").write_text("\n".join(rows[:1000]) + "\n")
    (tmp_path / "g" / "b.gfa").write_text("\n".join(rows[1000:]))
    path, index = f"{tmp_path}/g", f"{tmp_path}/index"
    K.write_index(spark, path, index, split=999)
    assert spark.read.parquet(index).count() == 3002
    wanted = spark.createDataFrame([("n7",), ("n2999",), ("n0",), ("n0",), ("star",), ("none",), (None,)], "name string")
    want = sorted(map(tuple, gfa.sequences_of(spark, path, wanted).collect()))
    assert sorted(map(tuple, K.sequences_of(spark, path, index, wanted).collect())) == want and len(want) == 4


def test_many_names_are_joined(spark, tmp_path, monkeypatch):
    (tmp_path / "a.gfa").write_text("\n".join(graph(200)))
    path, index = f"{tmp_path}/a.gfa", f"{tmp_path}/index"
    K.write_index(spark, path, index)
    wanted = spark.range(300).selectExpr("concat('n', id) as name")
    few = sorted(map(tuple, K.sequences_of(spark, path, index, wanted).collect()))
    monkeypatch.setattr(K, "FEW", 3)
    assert sorted(map(tuple, K.sequences_of(spark, path, index, wanted).collect())) == few and len(few) == 200


def test_only_their_own_bytes_are_read(spark, tmp_path):
    file = tmp_path / "a.gfa"
    file.write_text("\n".join(graph(20_000)) + "\n")
    path, index = str(file), f"{tmp_path}/index"
    K.write_index(spark, path, index, split=50_000)
    wanted = spark.createDataFrame([("n5",), ("n10000",), ("n10001",), ("n19999",)], "name string")
    rows = K.places(spark, index, wanted).collect()
    content = bytearray(file.read_bytes())
    kept = [(r["offset"], bytes(content[r["offset"] : r["offset"] + r["bytes"]])) for r in rows]
    content[:] = b"\xff" * len(content)  # whoever reads another byte sees no text
    for at, line in kept:
        content[at : at + len(line)] = line
    file.write_bytes(content)
    got = {r["name"]: r["seq"] for r in K.sequences_of(spark, path, index, wanted).collect()}
    assert got == {f"n{k}": "ACGT"[k % 4] * (1 + k % 50) for k in (5, 10000, 10001, 19999)}
    assert sum(len(line) for _, line in kept) < len(content) / 1000


def test_compressed_text_is_refused(spark, tmp_path):
    (tmp_path / "a.gfa.gz").write_bytes(b"x")
    with pytest.raises(PySparkException):
        K.write_index(spark, str(tmp_path), f"{tmp_path}/index")
