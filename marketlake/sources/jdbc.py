"""Database tables over JDBC."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000  # fixed value


def scan_options(
    url: str, table: str, properties: dict[str, str] | None = None, partition_column: str | None = None,
    bounds: tuple | None = None, partitions: int | None = None, fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Reader options. With a partition column the scan runs as ``partitions`` range queries in parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **(properties or {})}
    if partition_column:
        if not bounds or not partitions:
            raise ValueError("a partitioned scan needs bounds and a number of partitions")
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                    "numPartitions": str(partitions)}
    return options


def scan_table(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, **partitioning) -> DataFrame:
    """A whole table; filters and columns of later steps are pushed into the database's query."""
    return spark.read.format("jdbc").options(**scan_options(url, table, properties, **partitioning)).load()


def probe(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Result of a query the database itself runs, for instance a count used as an emptiness gate."""
    return spark.read.format("jdbc").options(**scan_options(url, f"({query}) t", properties)).load()


def key_bounds(spark: SparkSession, url: str, table: str, column: str, properties: dict[str, str] | None = None) -> tuple:
    """Smallest and largest key, computed by the database, for a partitioned scan."""
    row = probe(spark, url, f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}", properties).first()
    return row[0], row[1]


def refresh_table(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, connections: int = 8) -> None:
    """Full refresh: the table keeps its definition, its rows are truncated and written again."""
    (df.write.format("jdbc").mode("overwrite").option("truncate", True).option("batchsize", BATCH_ROWS)
     .option("numPartitions", connections).options(url=url, dbtable=table, **(properties or {})).save())


def replace_statement(table: str, columns: list[str], placeholder: str = "%s") -> str:
    """Insert that replaces a row with the same key."""
    return f"REPLACE INTO {table} ({', '.join(columns)}) VALUES ({', '.join([placeholder] * len(columns))})"


def replace_rows(df: DataFrame, connect: Callable, statement: str, batch_rows: int = BATCH_ROWS, connections: int = 8) -> None:
    """Send rows to a database in batches from the executors; nothing passes through the driver.

    ``connect`` returns a DB-API connection and is called once per partition. Replacing by key makes a retried
    partition harmless. ``connections`` bounds how many partitions write at once.
    """
    def send(rows: Iterator) -> None:
        connection = connect()
        try:
            cursor, batch = connection.cursor(), []
            for row in rows:
                batch.append(tuple(row))
                if len(batch) == batch_rows:
                    cursor.executemany(statement, batch)
                    batch = []
            if batch:
                cursor.executemany(statement, batch)
            connection.commit()
        finally:
            connection.close()

    df.repartition(connections).foreachPartition(send)
