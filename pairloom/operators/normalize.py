"""Entity tables -> normalized tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text


def normalize(entities: DataFrame) -> DataFrame:
    """One narrow projection; no shuffle. The core name reads the normalized
    name, so each regular expression runs once per row."""
    address = F.col("business_address")
    return entities.select(
        "entity_id",
        F.col("business_name").alias("name_raw"),
        address.alias("address_raw"),
        "country",
        text.name_norm(F.col("business_name")).alias("name_norm"),
        text.address_norm(address).alias("address_norm"),
        text.house_number(address).alias("house_number"),
        text.postal_code(address).alias("postal_code"),
    ).select(
        "entity_id",
        "name_raw",
        "address_raw",
        "country",
        "name_norm",
        text.name_core(F.col("name_norm")).alias("name_core"),
        "address_norm",
        "house_number",
        "postal_code",
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows)``, one row per table, also for empty ones."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def cap_rows(entities: DataFrame, n: int) -> DataFrame:
    """Smoke-run row cap: the first ``n`` entities by id; 0 keeps every row."""
    return entities.orderBy("entity_id").limit(n) if n > 0 else entities
