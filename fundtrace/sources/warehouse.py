"""Table registry: declared schemas, absent tables become empty ones (SRC1, FLT1)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fundtrace import schemas


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(ddl))


def conform(df: DataFrame, ddl: str, optional: set[str] = frozenset()) -> DataFrame:
    """Select and cast the declared columns; a missing one is null unless it is optional."""
    present = set(df.columns)
    wanted = []
    for field in StructType.fromDDL(ddl).fields:
        if field.name in present:
            wanted.append(F.col(f"`{field.name}`").cast(field.dataType).alias(field.name))
        elif field.name not in optional:
            wanted.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*wanted)


def is_absent(error: AnalysisException) -> bool:
    """Whether the error says that a path does not exist; any other one is a failure."""
    return error.getCondition() == "PATH_NOT_FOUND"


class Warehouse:
    """Lazy access to the warehouse tables.

    ``tables`` maps a table name to a DataFrame or to a function that builds one on first use.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
    ):
        self.spark = spark
        self._given = dict(tables)
        self._ready: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Warehouse:
        """Tables stored as ``<root>/<table>.parquet``; unknown paths are treated as absent."""

        def reader(name: str) -> Callable[[], DataFrame]:
            def read() -> DataFrame:
                try:
                    return spark.read.parquet(f"{root}/{name}.parquet")
                except AnalysisException as error:
                    if not is_absent(error):
                        raise
                    return empty(spark, schemas.TABLES[name])

            return read

        return cls(spark, {name: reader(name) for name in schemas.TABLES if name != "agreement_current"})

    def has(self, name: str) -> bool:
        return name in self._given

    def table(self, name: str) -> DataFrame:
        if name not in self._ready:
            ddl = schemas.TABLES[name]
            given = self._given.get(name)
            if given is None:
                self._ready[name] = empty(self.spark, ddl)
            else:
                df = given() if callable(given) else given
                self._ready[name] = conform(df, ddl, schemas.OPTIONAL_COLUMNS.get(name, set()))
        return self._ready[name]

    def with_tables(self, **tables: DataFrame) -> Warehouse:
        return Warehouse(self.spark, {**self._given, **tables})

    @property
    def entities(self) -> DataFrame:
        return self.table("entity_golden_records")

    @property
    def active_entities(self) -> DataFrame:
        """Golden records in force; every record where the deployment has no status column."""
        df = self.entities
        return df.filter(F.col("status") == "active") if "status" in df.columns else df

    @property
    def links(self) -> DataFrame:
        return self.table("entity_source_links")

    @property
    def directors(self) -> DataFrame:
        return self.table("cra_directors")

    @property
    def gifts(self) -> DataFrame:
        return self.table("cra_qualified_donees")

    @property
    def loops(self) -> DataFrame:
        return self.table("loops")

    @property
    def loop_edges(self) -> DataFrame:
        return self.table("loop_edges")
