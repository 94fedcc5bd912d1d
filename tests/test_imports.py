import pytest
from conftest import values

from pyspark.sql.types import StructType

from tallyglass.operators import imports
from tallyglass.sources.csv_files import malformed_lines, read_raw_csv
from tallyglass.sources.schemas import RAW_USER

HEADER = "ID,CREATED_DATE,BIRTH_DATE,STATE,LANGUAGE,GENDER\n"
GOOD = (
    '1,2020-01-01,,"Washington, DC",en,female\n'
    '2,2020-01-02,"",TX,en,"My gender isn\'t ""listed"""\n'
    "3,2020-01-03, ,CALIFORNIA Á,es-419,\n"
)


@pytest.fixture
def path(tmp_path):
    def write(text):
        file = tmp_path / "users.csv"
        file.write_text(HEADER + text, encoding="utf-8")
        return str(file)

    return write


def test_quotes_commas_blanks_and_accents(spark, path):
    df = read_raw_csv(spark, path(GOOD), RAW_USER)
    assert df.schema == RAW_USER
    assert values(df.select("STATE")) == ["CALIFORNIA Á", "TX", "Washington, DC"]
    assert values(df.where("ID = '2'").select("GENDER")) == ['My gender isn\'t "listed"']
    assert values(df.select("BIRTH_DATE")) == [None, None, " "]
    assert values(imports.delimiter_check(df, "STATE").select("ID")) == ["1"]
    assert imports.delimiter_check(df, "GENDER").count() == 0


def test_round_trip(spark, path, tmp_path):
    df = read_raw_csv(spark, path(GOOD), RAW_USER)
    df.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "again"))
    assert values(read_raw_csv(spark, str(tmp_path / "again"), RAW_USER)) == values(df)


@pytest.mark.parametrize("bad", ["4,2020-01-04,1990-01-01,TX,en,male,extra\n", "5,2020-01-05\n"])
def test_malformed_lines_stop_or_are_listed(spark, path, bad):
    file = path(GOOD + bad)
    with pytest.raises(Exception, match="MALFORMED"):
        read_raw_csv(spark, file, RAW_USER).select("ID").collect()
    assert read_raw_csv(spark, file, RAW_USER, on_malformed="keep").count() == 4
    assert values(malformed_lines(spark, file, RAW_USER)) == [bad.strip()]


def test_sizes_and_control_total(table):
    df = table("a b", ("1.50", "x"), (" ", "y"), (None, "z"), ("2.25", "y"))
    assert imports.row_count(df).first()[0] == 4
    assert tuple(imports.shape(df).first()) == (4, 2)
    total = imports.control_total(df, "a")
    assert total.dtypes == [("Total_a", "decimal(38,10)")] and float(total.first()[0]) == 3.75
    assert imports.preview(df, 2).count() == 2
    assert values(imports.preview(df, 1, columns=["b"], order_by=["b"])) == ["x"]


def test_header_names_and_line_breaks_in_quotes(spark, tmp_path):
    schema = StructType.fromDDL("a string, b string")
    broken, swapped = tmp_path / "broken.csv", tmp_path / "swapped.csv"
    broken.write_text('a,b\n"N\nY",2\n')
    swapped.write_text("b,a\n1,2\n")
    assert values(read_raw_csv(spark, str(broken), schema, multiline=True)) == [("N\nY", "2")]
    with pytest.raises(Exception, match="(?i)header"):
        read_raw_csv(spark, str(swapped), schema).collect()
    assert values(read_raw_csv(spark, str(swapped), schema, check_header=False)) == [("1", "2")]
