"""CSV files split anywhere: records, headers and types as when read whole."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from tablecheck.functions.scalars import NULL_TOKENS
from tablecheck.sources import csv as CSV
from tablecheck.sources.csvrecords import ends_inside, scan_blocks


@pytest.fixture()
def small_blocks(spark):
    """Files in blocks of 200 bytes, as a large file is in many blocks."""
    conf = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _write(folder, files):
    folder.mkdir()
    for k, text in enumerate(files):
        (folder / f"part-{k}.csv").write_bytes(text.encode())
    return str(folder)


def _whole(text):
    rows = list(csv.reader(io.StringIO(text, newline="")))
    return [dict(zip(rows[0], [None if v in NULL_TOKENS else v for v in r], strict=True)) for r in rows[1:] if r]


def _key(row):
    return sorted((k, v is None, v or "") for k, v in row.items())


def _plain_state(line, inside):
    """The state machine, byte by byte."""
    state = "quoted" if inside else "start"
    for c in line.decode():
        if state == "start":
            state = "quoted" if c == '"' else "start" if c == "," else "plain"
        elif state == "plain":
            state = "start" if c == "," else "plain"
        elif state == "quoted":
            state = "quote" if c == '"' else "quoted"
        else:  # a quote inside quotes
            state = "quoted" if c == '"' else "start" if c == "," else "plain"
    return state == "quoted"


def test_lines_are_functions_of_one_bit():
    rng = random.Random(4)
    for _ in range(20_000):
        line = "".join(rng.choice('a,"') for _ in range(rng.randint(0, 9))).encode()
        for inside in (False, True):
            assert ends_inside(line, inside) == _plain_state(line, inside), (line, inside)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_read_as_whole(spark, small_blocks, tmp_path, end):
    rng = random.Random(len(end))
    names = ["id", "text", "more, or less", 'say "x"']
    pieces = ["a", "b c", ",", '"', "\n", "\n\n", "日本", "x" * 40, " ", '","', '"\n"']
    files = []
    for k in range(3):
        own = names[k % 2:] + names[:k % 2]
        out = io.StringIO()
        writer = csv.DictWriter(out, own, lineterminator=end)
        writer.writeheader()
        for i in range(20):
            text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
            writer.writerow({"id": f"{k}.{i}", "text": text() or "-", names[2]: text() * rng.choice([1, 1, 1, 30]) or "q",
                             names[3]: "null" if i % 7 == 0 else f"v{i}"})
        files.append(out.getvalue())
    path = _write(tmp_path / "src", files)
    want = sorted((r for f in files for r in _whole(f)), key=_key)
    df = CSV.read_string_csv(spark, path)
    assert sorted(df.columns) == sorted(names)
    assert sorted((r.asDict() for r in df.collect()), key=_key) == want
    blocks = scan_blocks(spark, path)
    assert len(blocks.headers) == 3 and len(blocks.start) > 20 and 0 < blocks.inside.sum() < len(blocks.inside)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert sorted((r.asDict() for r in CSV.read_string_csv(spark, path).collect()), key=_key) == want


def test_a_record_over_many_blocks(spark, small_blocks, tmp_path):
    long = "\n".join(f'line {i}, "{i}"' for i in range(60))
    text = f'a,b\n1,"{long.replace(chr(34), chr(34) * 2)}"\n2,"x\ny"\n\n   \n3,5" pipe\n4,z\n'
    rows = {r.a: r.b for r in CSV.read_string_csv(spark, _write(tmp_path / "src", [text])).collect()}
    assert rows == {"1": long, "2": "x\ny", "3": '5" pipe', "4": "z"}


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    path = _write(tmp_path / "src", ["a,b\n1,x\n2,y\n", "b,a\r\nz,3\r\n", "\n\na,b\n4,w\n", "", "b,a\n"])
    for df in (CSV.read_typed_csv(spark, path), CSV.read_typed_csv(spark, path)):
        assert {f.name: f.dataType for f in df.schema} == {"a": T.LongType(), "b": T.StringType()}
        assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    other = _write(tmp_path / "other", ["a,b\n1,x\n", "a,c\n1,x\n"])
    with pytest.raises(ValueError, match="different columns"):
        CSV.read_string_csv(spark, other)
    assert CSV.read_typed_csv(spark, _write(tmp_path / "empty", [""])).columns == []
    headed = CSV.read_typed_csv(spark, _write(tmp_path / "headed", ["a,b\n"]))
    assert headed.columns == ["a", "b"] and headed.count() == 0


def test_typed_read_parses_the_text_once(spark, tmp_path):
    path = _write(tmp_path / "src", ["n,s\n1,a\n", "n,s\n2.5,b\n", "n,s\n,c\n"])
    df = CSV.read_typed_csv(spark, path)
    assert df.schema["n"].dataType == T.DoubleType() and df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "from_csv" not in plan and "parquet" in plan
