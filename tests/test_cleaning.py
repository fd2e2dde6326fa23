import math
from datetime import date, datetime

import pytest

from demandkit.functions.cleaning import parse_date, parse_timestamp
from demandkit.operators import clean, dense
from demandkit.sources import files
from demandkit.spec import PanelSpec, detect_roles, require_columns, validate_horizon


def test_numeric_coercion_cases(spark):
    texts = ["", " 12 ", "1,000", "1.0d", "nan", "inf", "-3.5e2", None, "abc", ".5", "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "`PAY WEIGHT` string")
    got = [r[0] for r in clean.coerce_numeric(df).collect()]
    assert got[:5] == [0.0, 12.0, 0.0, 0.0, 0.0]
    assert math.isinf(got[5]) and got[5] > 0
    assert got[6:] == [-350.0, 0.0, 0.0, 0.5, 0.0]


def test_numeric_coercion_of_typed_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.5,)], "AMOUNT double")
    assert [r[0] for r in clean.coerce_numeric(df).collect()] == [0.0, 0.0, 2.5]


def test_categorical_fill_and_absent_columns(spark):
    df = spark.createDataFrame([(None, "X"), ("C", None)], "`CENTER NAME` string, ITEM string")
    out = clean.fill_categorical(df).collect()
    assert [tuple(r) for r in out] == [("Unknown", "X"), ("C", "Unknown")]


def test_dates_parse_drop_and_truncate(spark):
    rows = [("2024-01-05 10:30:00",), ("2024-01-05 18:00:00",), ("",), ("not a date",), (None,), ("01/07/2024",), ("2024-02-29",)]
    df = spark.createDataFrame(rows, "DATE string")
    got = [r[0] for r in clean.parse_dates(df, "DATE").collect()]
    assert got == [date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 7), date(2024, 2, 29)]
    kept = [r[0] for r in clean.parse_dates(df, "DATE", keep_time=True).collect()]
    assert kept[0] == datetime(2024, 1, 5, 10, 30) and kept[1] == datetime(2024, 1, 5, 18, 0)


def test_same_day_rows_merge_in_daily_aggregate(spark):
    spec = PanelSpec(measures=())
    rows = [("2024-01-05 10:30:00", "C", "I", "2"), ("2024-01-05 18:00:00", "C", "I", "3")]
    raw = spark.createDataFrame(rows, "DATE string, `CENTER NAME` string, ITEM string, `PAY WEIGHT` string")
    out = dense.daily_aggregate(clean.clean_sales(raw, spec), spec).collect()
    assert len(out) == 1 and out[0]["PAY WEIGHT"] == 5.0


def test_required_columns():
    require_columns(["DATE", "CENTER NAME", "ITEM", "PAY WEIGHT"], PanelSpec().required)
    with pytest.raises(KeyError, match="ITEM"):
        require_columns(["DATE", "CENTER NAME", "PAY WEIGHT"], PanelSpec().required)


def test_role_detection_first_match_wins():
    roles = detect_roles(["order_time", "store", "product_name", "qty", "Delivery Date"])
    assert roles == {"date": "order_time", "center": "store", "item": "product_name", "target": "qty"}
    assert detect_roles(["a", "b"])["target"] is None


def test_horizon_validation():
    validate_horizon(days=1)
    validate_horizon(months=24)
    with pytest.raises(ValueError):
        validate_horizon(days=0)
    with pytest.raises(ValueError):
        validate_horizon(months=25)


def test_csv_scan_all_strings_and_missing_path(spark, tmp_out):
    path = f"{tmp_out}/sales.csv"
    with open(path, "w") as fh:
        fh.write("DATE,CENTER NAME,ITEM,PAY WEIGHT,ICE/WATER\n2024-01-01,A,X,1.5,\n2024-01-02,,Y,bad,3\n")
    df = files.read_sales_csv(spark, path)
    assert df.columns == ["DATE", "CENTER NAME", "ITEM", "PAY WEIGHT", "ICE/WATER"]
    assert all(t == "string" for _, t in df.dtypes)
    cleaned = clean.clean_sales(df, PanelSpec(measures=())).orderBy("DATE").collect()
    assert [r["PAY WEIGHT"] for r in cleaned] == [1.5, 0.0]
    assert [r["ICE/WATER"] for r in cleaned] == [0.0, 3.0]
    assert cleaned[1]["CENTER NAME"] == "Unknown"
    with pytest.raises(FileNotFoundError):
        files.read_sales_csv(spark, f"{tmp_out}/missing.csv")


def test_history_filter_and_projection(spark):
    spec = PanelSpec(measures=(("AMOUNT", "sum"),))
    rows = [(date(2024, 1, d), "C", "I", float(d), 10.0 * d) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "DATE date, `CENTER NAME` string, ITEM string, `PAY WEIGHT` double, AMOUNT double")
    out = clean.history(df, spec, "2024-01-02", "2024-01-04", center="C", item="I").collect()
    assert [r["demand"] for r in out] == [2.0, 3.0, 4.0]
    assert [r["rate"] for r in out] == [0.0, 0.0, 0.0]  # absent measure reads as 0
    assert out[0]["amount"] == 20.0


def test_non_blank_filter(spark):
    df = spark.createDataFrame([("a",), ("  ",), (None,), ("b",)], "c string")
    assert [r[0] for r in clean.non_blank(df, "c").collect()] == ["a", "b"]


def test_map_roles_synthesizes_missing(spark):
    df = spark.createDataFrame([(3, 10.0), (1, 20.0), (2, 30.0)], "seq int, qty double")
    out, spec = clean.map_roles(df, as_of="2024-01-10", order_by=["seq"])
    rows = {r["demand"]: r for r in out.collect()}
    assert rows[20.0]["date"] == date(2024, 1, 7) and rows[10.0]["date"] == date(2024, 1, 9)
    assert rows[20.0]["center"] == "All Locations" and rows[20.0]["item"] == "All Products"
    none, _ = clean.map_roles(spark.createDataFrame([(1,)], "x int"))
    assert none is None


DATE_CASES = [
    ("2024-01-05", "2024-01-05 00:00:00"),
    ("2024-1-5", "2024-01-05 00:00:00"),
    ("2024/1/5", "2024-01-05 00:00:00"),
    ("1/5/2024", "2024-01-05 00:00:00"),
    ("01/05/24", "2024-01-05 00:00:00"),
    ("01/05/69", "1969-01-05 00:00:00"),
    ("05-01-2024", "2024-05-01 00:00:00"),
    ("05.01.2024", "2024-05-01 00:00:00"),
    ("25/12/2024", None),
    ("20240105", "2024-01-05 00:00:00"),
    ("Jan 5, 2024", "2024-01-05 00:00:00"),
    ("5 September 2024 7:08", "2024-09-05 07:08:00"),
    ("2024-01-05 10:30", "2024-01-05 10:30:00"),
    ("2024-01-05T10:30:00Z", "2024-01-05 10:30:00"),
    ("2024-01-05T10:30:00+05:30", "2024-01-05 10:30:00"),
    ("2024-01-05 10:30:00.123456789", "2024-01-05 10:30:00.123456"),
    ("2024-03-10 02:30:00", "2024-03-10 02:30:00"),
    ("2024-02-30", None),
    ("2024-01-05 25:00", None),
    ("Foo 5, 2024", None),
    ("not a date", None),
    ("", None),
    (None, None),
]


def test_date_layouts(spark):
    df = spark.createDataFrame([(t,) for t, _ in DATE_CASES], "d string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 2:30 on 10 March does not exist there
        got = [r[0] for r in df.select(parse_timestamp("d").cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [want for _, want in DATE_CASES]


def test_day_first_holds_for_every_separator(spark):
    df = spark.createDataFrame([("05-01-2024",), ("05.01.2024",), ("5/1/24",), ("25/12/2024",), ("12/25/2024",), ("2024-01-05",)], "d string")
    got = [str(r[0]) for r in df.select(parse_date("d", day_first=True)).collect()]
    assert got == ["2024-01-05"] * 3 + ["2024-12-25", "None", "2024-01-05"]


def test_rejected_dates_are_returned(spark):
    df = spark.createDataFrame([("2024-01-05", 1), ("soon", 2), ("", 3), (None, 4)], "DATE string, n int")
    kept, lost = clean.parse_dates(df, "DATE"), clean.date_rejects(df, "DATE")
    assert kept.count() + lost.count() == df.count()
    assert {r.n: r.reject_reason for r in lost.collect()} == {2: "unreadable date", 3: "missing date", 4: "missing date"}


def write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_csv_quotes_tokens_and_rejects(spark, tmp_out):
    path = f"{tmp_out}/quoted.csv"
    write(path, 'DATE,CENTER NAME,ITEM,PAY WEIGHT\n2024-01-01,A,"say ""hi"", x",1.5\n2024-01-02,NA,null,N/A\n2024-01-03,"",b,2,9,9\n2024-01-04,c\n')
    got = [tuple(r) for r in files.read_sales_csv(spark, path).collect()]
    assert got == [("2024-01-01", "A", 'say "hi", x', "1.5"), ("2024-01-02", None, None, None)]
    lost = files.csv_rejects(spark, path)
    assert lost.count() == 2 and {r.record for r in lost.collect()} == {'2024-01-03,"",b,2,9,9', "2024-01-04,c"}
    cleaned = clean.clean_sales(files.read_sales_csv(spark, path), PanelSpec(measures=())).collect()
    assert [(r["CENTER NAME"], r["ITEM"], r["PAY WEIGHT"]) for r in cleaned] == [("A", 'say "hi", x', 1.5), ("Unknown", "Unknown", 0.0)]


def test_csv_line_breaks_in_quotes(spark, tmp_out):
    path = f"{tmp_out}/lines.csv"
    write(path, 'DATE,CENTER NAME,ITEM,PAY WEIGHT\n2024-01-01,A,"two\nlines",1\n')
    assert [r["ITEM"] for r in files.read_sales_csv(spark, path, multi_line=True).collect()] == ["two\nlines"]
    assert files.read_sales_csv(spark, path).count() == 0 and files.csv_rejects(spark, path).count() == 2


def test_csv_headers_must_agree(spark, tmp_out):
    write(f"{tmp_out}/a.csv", "DATE,CENTER NAME,ITEM,PAY WEIGHT\n2024-01-01,A,X,1\n")
    write(f"{tmp_out}/b.csv", "DATE,ITEM,CENTER NAME,PAY WEIGHT\n2024-01-01,X,A,1\n")
    with pytest.raises(Exception, match="header"):
        files.read_sales_csv(spark, tmp_out).collect()
