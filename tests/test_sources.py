import pytest

from helpers import rows
from weighbridge.sources import (
    first_rows,
    read_csv,
    read_parquet,
    schema_profile,
    schemas,
    scratch,
    settle,
    write_result,
)


def write(path, text):
    path.write_bytes(text.replace("\n", "\r\n").encode())
    return str(path)


def test_csv_quotes_empty_fields_and_line_ends(spark, tmp_path):
    path = write(tmp_path / "gdp.csv", 'country,country_name,GDP_per_PPP_2022\nHKG,"Hong Kong, China",5.5\nXXX,,\nYYY,Y,NA\n')
    assert rows(read_csv(spark, path, schemas.GDP)) == [
        ("HKG", "Hong Kong, China", 5.5), ("XXX", None, None), ("YYY", "Y", None),
    ]


def test_csv_doubles_quotes_and_keeps_blanks(spark, frame, tmp_path):
    path = write(tmp_path / "q.csv", 'country,country_name,GDP_per_PPP_2022\nAAA,"Say ""x"", y",1.5\n')
    assert rows(read_csv(spark, path, schemas.GDP)) == [("AAA", 'Say "x", y', 1.5)]
    df = frame("country STRING, country_name STRING, GDP_per_PPP_2022 DOUBLE", ("A", 'a "q", b', 1.0), ("B", "  c\\ ", None))
    write_result(df, str(tmp_path / "w"), "csv")
    assert sorted(rows(read_csv(spark, str(tmp_path / "w"), schemas.GDP))) == sorted(rows(df))


def test_settled_tables_are_released(spark, frame):
    import os

    with scratch(spark):
        path = settle(frame("a INT", (1,))).inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(os.path.dirname(path)))


def test_csv_with_another_header_fails(spark, tmp_path):
    path = write(tmp_path / "gdp.csv", "land,country_name,GDP_per_PPP_2022\nHKG,H,5.5\n")
    with pytest.raises(Exception):
        read_csv(spark, path, schemas.GDP).collect()


def test_parquet_checks_the_schema(spark, frame, tmp_path):
    path = str(tmp_path / "p")
    frame("country STRING, country_name STRING, GDP_per_PPP_2022 DOUBLE, more INT", ("A", "a", 1.0, 1)).write.parquet(path)
    assert read_parquet(spark, path, schemas.GDP).columns == ["country", "country_name", "GDP_per_PPP_2022"]
    with pytest.raises(ValueError):
        read_parquet(spark, path, schemas.EXPENDITURE)


def test_year_partitions_are_pruned(spark, frame, tmp_path):
    path = str(tmp_path / "p")
    write_result(frame("v INT, year INT", (1, 2018), (2, 2022)), path, partition_by=["year"])
    df = read_parquet(spark, path).where("year = 2022")
    assert rows(df.select("v")) == [(2,)]
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString()


def test_csv_sink_and_unknown_format(spark, frame, tmp_path):
    df = frame("country STRING, year INT, percentage_education_on_gdp DOUBLE", ("A", 2020, 4.5), ("B", 2021, None))
    write_result(df, str(tmp_path / "c"), "csv")
    assert sorted(rows(read_csv(spark, str(tmp_path / "c"), schemas.EXPENDITURE))) == sorted(rows(df))
    with pytest.raises(ValueError):
        write_result(df, str(tmp_path / "d"), "xml")


def test_first_rows_and_schema_profile(frame):
    df = frame("a INT, b STRING", *[(i, "x") for i in range(9, 0, -1)])
    assert [r.a for r in first_rows(df, ["a"]).collect()] == [1, 2, 3, 4, 5, 6]
    assert rows(schema_profile(df)) == [(1, "a", "int"), (2, "b", "string")]


def test_settle_keeps_rows_and_cuts_the_plan(frame):
    df = frame("`Income group` STRING, x DOUBLE", ("a", 1.0), ("b", None))
    stored = settle(df.groupBy("Income group").sum("x").withColumnRenamed("sum(x)", "s"))
    assert sorted(rows(stored)) == [("a", 1.0), ("b", None)]
    assert "Aggregate" not in stored._jdf.queryExecution().executedPlan().toString()


def test_package_is_shipped_once(spark):
    from weighbridge.session import ship

    ship(spark)
    ship(spark)

    def found(batches):
        import weighbridge.functions  # noqa: F401

        yield from batches

    assert spark.range(3).mapInArrow(found, "id long").count() == 3


def test_damaged_csv_gives_rows_and_problems(spark, tmp_path):
    from weighbridge.sources import read_csv_with_problems

    text = 'country,country_name,GDP_per_PPP_2022\nHKG,"Hong Kong, China",5.5\nBAD,B,1.2.3\nCUT,C\nXTR,D,2.5,more\nQUO,"lost,3.5\nNUL,,NA\nEND,E, 7 \n'
    path = write(tmp_path / "gdp.csv", text)
    good, problems = read_csv_with_problems(spark, path, schemas.GDP)
    assert good.schema["GDP_per_PPP_2022"].dataType == schemas.GDP["GDP_per_PPP_2022"].dataType
    assert rows(good)[0] == ("HKG", "Hong Kong, China", 5.5)
    assert {r.country: r.GDP_per_PPP_2022 for r in good.collect()} == {"HKG": 5.5, "BAD": None, "CUT": None, "XTR": 2.5, "QUO": None, "NUL": None, "END": 7.0}
    found = {r.row_text: r for r in problems.collect()}
    assert set(found) == {"BAD,B,1.2.3", "CUT,C", "XTR,D,2.5,more", 'QUO,"lost,3.5'}
    value = found["BAD,B,1.2.3"]
    assert (value.column_name, value.expected, value.actual) == ("GDP_per_PPP_2022", "double", "1.2.3") and value.file.endswith("gdp.csv")
    assert found["CUT,C"].column_name is None and found["CUT,C"].expected == "3 fields"
    assert good.select("country").count() == 7 and problems.select("file").distinct().count() == 1


def test_problems_need_the_declared_header(spark, tmp_path):
    from weighbridge.sources import read_csv_with_problems

    path = write(tmp_path / "gdp.csv", "land,country_name,GDP_per_PPP_2022\nHKG,H,5.5\n")
    with pytest.raises(Exception):
        read_csv_with_problems(spark, path, schemas.GDP)[0].collect()
