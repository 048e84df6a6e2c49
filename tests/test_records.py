import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramforge.queries.dealt import WAGE_RECORD
from gramforge.errors import InvalidOperation
from gramforge.sources.records import FieldSpec, Parser, parse_chunks, parse_lines, read_records

P = Parser(WAGE_RECORD)


def reason(line):
    return P.line(line)[1]


def test_reasons():
    good = ["1,2,3,0,x", "NA,.,NaN,NULL,", " 17.92 ,7,21,1,\"a, b\"", "1e3,12.0,70,1,\"a \"\"b\"\" c\"\r", '"5","12","3","0","line\nbreak"', "+1.,1.2e1,.0e5,0,x", "1,2,3,null,", "100000,30,70,1,a\tb", "1,-0,3,0,x"]
    assert [reason(x) for x in good] == [None] * len(good)
    assert {x: reason(x) for x in ("", None, "1,2,3,0", "1,2,3,0,a,b", "\r")} == {"": "column_count", None: "column_count", "1,2,3,0": "column_count", "1,2,3,0,a,b": "column_count", "\r": "column_count"}
    for x in ('1,2,3,0,a"b', '1,2,3,0,"a', '1,2,3,0,"a"b', '1,2,3,0, "a"', '1,2"', '"a""', '1,2,3,0,"a"b"'):
        assert reason(x) == "quoting", x
    for x in ("0,2,3,0,x", "-1,2,3,0,x", "100000.5,2,3,0,x", "1e-400x,2,3,0,x", "1,31,3,0,x", "1,2.5,3,0,x", "1,2,71,0,x", "1,2,3,2,x", "1,2,3,1.0,x", "1,2,3,f,x", "0x1F,2,3,0,x", "1_0,2,3,0,x", "inf,2,3,0,x", "１,2,3,0,x", "1,2,-1,0,x", "1,12.00000000000000000001,3,0,x", "1e999999,2,3,0,x", "1 2,2,3,0,x"):
        assert reason(x) == "invalid_value", x
    assert reason("1e-400,2,3,0,x") is None  # above 0, though too small for a double


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n é', max_size=6), min_size=1, max_size=6))
def test_round_trip_with_the_csv_module(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(fields)
    assert P.record(out.getvalue())[0] == fields


def test_recovery_at_anchors():
    text = '1,2,3,0,ok\n5,6,7,1,"broken\n2,3,4,1,fine\n3,4,5,0,"two\nlines"\nbad"quote,1\n9,9,9,9,x\n4,5,6,1,last'
    got = [(None if e is None else e.reason, text[a:b]) for a, b, _, e in P.text(text)]
    assert [r for r, _ in got] == [None, "quoting", None, None, "quoting", "invalid_value", None]
    assert "\n".join(raw for _, raw in got) == text


def test_errors_are_located():
    at = lambda x: P.line(x)[1:]
    assert at("1,2,3") == ("column_count", 5, 3) and at("1,2,3,0,a,b,c") == ("column_count", 10, 7) and at("") == ("column_count", 0, 1)
    assert at("1,99,3,0,a") == ("invalid_value", 2, 1) and at('"1",2,3, 5,a') == ("invalid_value", 8, 3)
    assert at('1,2,3,0,"a') == ("quoting", 8, 4) and at('1,2"') == ("quoting", 3, 1)


MESSY = ["1,2,3,0,ok", '5,6,7,1,"broken', "2,3,4,1,fine", '3,4,5,0,"two', 'more "" lines', 'end"', 'bad"quote,1', "9,9,9,9,x", '4,5,6,1,"', '7,5,6,1,""', "", '8,8,8,0,"last', 'one"']


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_chunks_give_the_records_of_the_whole_text(spark, size):
    text = "\n".join(MESSY) + "\n"
    want = sorted((v is not None, None if e is None else e.reason, tuple(v or [text[a:b]])) for a, b, v, e in P.text(text))
    rows = [(f, i // size, "".join(x + "\n" for x in MESSY[i : i + size])) for f in ("a", None) for i in range(0, len(MESSY), size)]
    df = spark.createDataFrame([*rows, ("a", 900, None), ("a", 901, "")], "name string, part int, body string")
    out = parse_chunks(df, WAGE_RECORD, file="name", chunk="part", text="body").collect()
    for f in ("a", None):
        got = sorted((r["reason"] is None, r["reason"], tuple([r["wage"], r["education"], r["experience"], r["female"], r["occupation"]] if r["reason"] is None else [r["raw_record"]])) for r in out if r["name"] == f)
        assert got == want
    rest = lambda c: "".join(t for f, k, t in rows if f == "a" and k >= c)
    for r in out:
        if r["reason"] is None and r["name"] == "a":
            assert rest(r["part"])[r["start_at"] :].startswith(f"{r['wage']:g},")


def test_chunk_edge_cases(spark):
    none = spark.createDataFrame([], "f string, c long, t string")
    assert parse_chunks(none, WAGE_RECORD, file="f", chunk="c", text="t").count() == 0
    df = spark.createDataFrame([("x", 0, "1,2,3,0,x\n" * 2 + "1,2,3,0," + "y" * 300_000 + "\n")], "f string, c long, t string")
    assert parse_chunks(df, WAGE_RECORD, file="f", chunk="c", text="t").where("reason is null").count() == 3
    with pytest.raises(InvalidOperation):
        parse_chunks(df, [FieldSpec("reason", "string")], file="f", chunk="c", text="t")


def test_parse_lines_keeps_all_rows(spark):
    lines = ["1,2,3,0,x", None, "", "a" * 200_000, '1,2,3,0,"' + "b" * 200_000 + '"', "1,2,3,0,x"]
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(lines)], "id int, raw string, Reason int")
    out = parse_lines(df, "raw", WAGE_RECORD)
    assert out.columns == ["id", "raw", "Reason", "wage", "education", "experience", "female", "occupation", "reason_", "error_at", "error_field"]
    assert [r["reason_"] for r in out.orderBy("id").collect()] == [None, "column_count", "column_count", "column_count", None, None]
    assert parse_lines(df.limit(0), "raw", WAGE_RECORD).count() == 0


def test_read_records_from_files(spark, tmp_path):
    rng = random.Random(1)
    for f in range(2):
        body = "".join(f"{rng.randint(1, 9)},2,3,0,x{i}\n" for i in range(50))
        (tmp_path / f"{f}.csv").write_text("wage,education,experience,female,occupation\n" + body + '1,2,3,0,"open\n')
    out = read_records(spark, str(tmp_path), WAGE_RECORD)
    assert out.where("reason is null").count() == 100
    assert [r["reason"] for r in out.where("reason is not null").collect()] == ["quoting"] * 2
    small = read_records(spark, str(tmp_path), WAGE_RECORD, chunk_chars=100)
    assert small.where("reason is null").count() == 100 and small.where("reason is not null").count() == 2
    assert small.select("chunk_no").distinct().count() > 3
    (tmp_path / "2.csv").write_text("x,2,3,0,bad\n1,2,3,0,good\n")
    more = read_records(spark, str(tmp_path / "2.csv"), WAGE_RECORD).collect()
    assert sorted((r["reason"] or "", r["raw_record"]) for r in more) == [("", None), ("invalid_value", "x,2,3,0,bad")]


def test_other_separators():
    p = Parser([FieldSpec("a", "string"), FieldSpec("b", "int")], sep=";", quote="'")
    assert p.line("'x;y';3")[0] == ["x;y", 3]
