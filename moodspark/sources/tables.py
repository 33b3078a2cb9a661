"""Reading the three tables from Parquet or a database."""

from pyspark.sql import DataFrame, SparkSession

from moodspark import schemas


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables under a folder. Schemas are given, so no file is opened to infer one."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in schemas.TABLES.items()}


def database_options(url: str, name: str, first_id: int, last_id: int, parts: int) -> dict[str, str]:
    """Options of a database read in ranges of the id. Rows outside the bounds are read too."""
    if name not in schemas.TABLES:
        raise ValueError(f"no such table: {name}")
    # Listing the columns keeps the password column where it is.
    columns = ", ".join(schemas.TABLES[name].fieldNames())
    return {
        "url": url,
        "dbtable": f"(SELECT {columns} FROM {name}) t",
        "partitionColumn": "id",
        "lowerBound": str(first_id),
        "upperBound": str(last_id),
        "numPartitions": str(parts),
        "fetchsize": "10000",
    }


def load_from_database(spark: SparkSession, url: str, name: str, first_id: int, last_id: int, parts: int) -> DataFrame:
    return spark.read.format("jdbc").options(**database_options(url, name, first_id, last_id, parts)).load()
