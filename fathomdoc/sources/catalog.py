"""Tables of the session and of other databases."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomdoc.config import DEFAULTS

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def list_tables(spark: SparkSession) -> DataFrame:
    """table_schema and table_name of base tables, sorted; views and temporary tables are left out."""
    found = [
        (database.name, table.name)
        for database in spark.catalog.listDatabases() if database.name not in SYSTEM_SCHEMAS
        for table in spark.catalog.listTables(database.name)
        if not table.isTemporary and table.tableType in ("MANAGED", "EXTERNAL")
    ]
    return spark.createDataFrame(found, "table_schema string, table_name string").orderBy("table_schema", "table_name")


def table_count(tables: DataFrame) -> DataFrame:
    return tables.agg(F.count("*").alias("count"))


def jdbc_options(url: str, query: str, *, user: str | None = None, password: str | None = None,
                 timeout_ms: int = DEFAULTS.sql_timeout_ms, fetch_rows: int = 10000,
                 bounds: tuple[str, object, object, int] | None = None,
                 read_only: bool = True) -> dict[str, str]:
    """Options of a JDBC read. ``bounds`` is (column, lowest, highest, partitions) for a parallel read.

    The session is made read-only with statements PostgreSQL understands; pass read_only=False for others.
    """
    options = {"url": url, "queryTimeout": str(max(1, timeout_ms // 1000)), "fetchsize": str(fetch_rows)}
    if bounds:
        column, lowest, highest, partitions = bounds
        options |= {"dbtable": f"({query}) AS q", "partitionColumn": column, "lowerBound": str(lowest),
                    "upperBound": str(highest), "numPartitions": str(partitions)}
    else:
        options["query"] = query
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    if read_only:
        options["sessionInitStatement"] = (
            f"SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY; SET statement_timeout = {timeout_ms}")
    return options


def postgres_url(host: str, database: str, port: int = 5432, connect_timeout_s: int = 5) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}?connectTimeout={connect_timeout_s}"


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
