import duckdb
import pytest
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators.normalize import cap_rows, normalize, row_counts


def entity(spark, name, address, country="US"):
    return spark.createDataFrame(
        [("S1-1", name, address, country)],
        "entity_id string, business_name string, business_address string, country string",
    )


@pytest.mark.parametrize(
    "name, norm, core",
    [
        ("  Café & Co\tLtd  ", "caf   and  co ltd", "caf   and"),
        ("***", "", ""),
        ("acme inc and co 2co", "acme inc and co 2co", "acme  and  2co"),
        ("A&B", "a and b", "a and b"),
        (None, None, None),
        ("İstanbul Gıda", "istanbul g da", "istanbul g da"),
    ],
)
def test_names(spark, name, norm, core):
    row = normalize(entity(spark, name, "x")).first()
    assert row["name_raw"] == name
    assert (row["name_norm"], row["name_core"]) == (norm, core)


@pytest.mark.parametrize(
    "address, norm, house, postal",
    [
        ("  12 Main St, 12345-678", "12 main st  12345 678", "12", "12345"),
        ("tel 1234567890", "tel 1234567890", "", "123456"),
        ("\x0b7 Rue", "7 rue", "", ""),
        ("abc & co", "abc   co", "", ""),
        ("10001 Elm, 99999", "10001 elm  99999", "10001", "10001"),
        (None, None, None, None),
    ],
)
def test_addresses(spark, address, norm, house, postal):
    row = normalize(entity(spark, "x", address)).first()
    assert (row["address_norm"], row["house_number"], row["postal_code"]) == (norm, house, postal)


def test_every_letter_normalizes_as_in_sql(spark):
    """All code points of the basic plane, one string each."""
    letters = [chr(i) for i in range(1, 0xFFFF) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, "x" + c + "y") for i, c in enumerate(letters)], "i int, t string")
    ours = {r.i: r.n for r in df.select("i", text.name_norm(F.col("t")).alias("n")).collect()}
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (i INT, t VARCHAR)")
    connection.executemany(
        "INSERT INTO t SELECT unnest($1::INT[]), unnest($2::VARCHAR[])",
        [[list(range(len(letters))), ["x" + c + "y" for c in letters]]],
    )
    theirs = connection.execute(
        "SELECT i, trim(regexp_replace(replace(lower(t), '&', ' and '), '[^a-z0-9 ]', ' ', 'g')) FROM t"
    ).fetchall()
    assert [(letters[i], ours[i], n) for i, n in theirs if ours[i] != n] == []


def test_counts_and_cap(spark, normalized):
    counts = {r.table_name: r.n_rows for r in row_counts(normalized).collect()}
    assert counts == {"s1": 150, "s2": 100, "s3": 112}
    none = normalized["s1"].where("false")
    assert [r.n_rows for r in row_counts({"none": none}).collect()] == [0]
    assert cap_rows(normalized["s1"], 7).count() == 7
    assert cap_rows(normalized["s1"], 0).count() == 150


def test_normalize_is_one_narrow_projection(normalized, spark, sf_dir):
    from pairloom import fixtures

    plan = normalize(fixtures.entities(spark, sf_dir, "s1"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
