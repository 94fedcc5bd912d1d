"""The three raw tables and everything derived from them, built on first use."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.casts import typed
from ..operators.colocated import read_lines, write_lines
from ..operators.imports import load_measures
from ..operators.keys import conflicting_keys
from ..operators.master import add_products, add_users, build_master, expected_fanout, key_overlap
from ..operators.staging import (
    TRANSACTION_TYPES,
    rejected_rows,
    split_staged,
    stage_products,
    stage_transactions,
    stage_users,
)
from ..sources import star_tables
from ..sources.csv_files import read_raw_csv
from ..sources.schemas import (
    MASTER,
    PRODUCT_COLUMNS,
    RAW_PRODUCTS,
    RAW_TRANSACTION,
    RAW_USER,
    STAGE_PRODUCTS,
    STAGE_TRANSACTION,
    STAGE_USER,
)
from ..sources.scratch import exists, remove, scratch_scope, store
from ..sources.stored import read_parquet, write_parquet

Source = DataFrame | Callable[[], DataFrame]


class RetailTables:
    """Raw, stage and master tables. A raw table is a DataFrame or a function that makes one.

    ``transactions``, ``users``, ``products`` and ``master`` are lazy and carry no row numbers, so
    a question that needs none never pays for a sort. The ``numbered_...`` tables add them.

    Key overlaps and conflicting barcodes are intermediates that several reports ask for. Inside
    ``with tables:`` the first use of one stores it and every later one reads what was stored; at
    the end, or on ``close()``, they and all other scratch tables made inside are removed. Outside,
    each report works them out for itself. ``save`` writes them beside the tables.
    """

    def __init__(
        self,
        raw_transactions: Source,
        raw_users: Source,
        raw_products: Source,
        read_from_files: bool = True,
    ):
        self._sources = {"transactions": raw_transactions, "users": raw_users, "products": raw_products}
        self._read_from_files = read_from_files
        self._kept: dict[str, DataFrame] = {}
        self._life: ExitStack | None = None

    def __enter__(self) -> RetailTables:
        if self._life is None:
            self._life = ExitStack()
            self._life.enter_context(scratch_scope(SparkSession.active()))
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        """Remove what was stored since ``with`` began; derived tables are made anew after that."""
        if self._life is None:
            return
        life, self._life = self._life, None
        self._kept = {name: df for name, df in self._kept.items() if name in self._saved}
        for name in [n for n in self.__dict__ if isinstance(getattr(type(self), n, None), cached_property)]:
            if name not in self._saved:
                del self.__dict__[name]
        life.close()

    #: Names of the tables that come from a folder and outlive a scope.
    _saved: frozenset[str] = frozenset()

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The intermediate of that name: read if it is saved or stored, else stored or only planned."""
        if name not in self._kept:
            if self._life is None:
                return make()
            self._kept[name] = store(make(), name)
        return self._kept[name]

    @classmethod
    def from_csv(
        cls, spark: SparkSession, transactions: str, users: str, products: str, on_malformed: str = "fail", **options
    ) -> RetailTables:
        """Raw tables from CSV files; ``options`` are those of ``read_raw_csv``."""
        return cls(
            lambda: read_raw_csv(spark, transactions, RAW_TRANSACTION, on_malformed, **options),
            lambda: read_raw_csv(spark, users, RAW_USER, on_malformed, **options),
            lambda: read_raw_csv(spark, products, RAW_PRODUCTS, on_malformed, **options),
        )

    @classmethod
    def from_star(cls, spark: SparkSession, sf_dir: str, unreadable: bool = False) -> RetailTables:
        """Raw tables derived by joins from a folder of star-schema Parquet tables.

        ``unreadable`` puts dates, numbers and barcodes among them that no cast can read.
        """
        lines, goods = star_tables.raw_transaction, star_tables.raw_products
        if unreadable:
            lines, goods = star_tables.unreadable_transaction, star_tables.unreadable_products
        return cls(
            lambda: lines(spark, sf_dir),
            lambda: star_tables.raw_user(spark, sf_dir),
            lambda: goods(spark, sf_dir),
            read_from_files=False,
        )

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> RetailTables:
        """Tables written by ``save``: everything typed, numbered and joined is read, not redone.

        If it was saved with ``buckets``, lines meet users, and products, where they lie: neither
        side of these joins is shuffled, and the wide table shuffles its lines for one join, not two.
        """

        def saved(name: str, schema: StructType) -> DataFrame:
            return read_parquet(spark, f"{folder}/{name}", schema)

        tables = cls(
            lambda: saved("raw_transactions", RAW_TRANSACTION),
            lambda: saved("raw_users", RAW_USER),
            lambda: saved("raw_products", RAW_PRODUCTS),
        )
        tables.numbered_transactions = saved("transactions", STAGE_TRANSACTION)
        tables.numbered_users = saved("users", STAGE_USER)
        tables.numbered_products = saved("products", STAGE_PRODUCTS)
        tables.transactions = tables.numbered_transactions.drop("row_id")
        tables.users = tables.numbered_users.drop("row_id")
        tables.products = tables.numbered_products.drop("row_id")
        if exists(spark, f"{folder}/buckets"):
            buckets = read_parquet(spark, f"{folder}/buckets", BUCKETS).first()["buckets"]
            with_users, with_products = read_lines(spark, folder, buckets, tables.users, tables.products)
            tables.lines_with_users = with_users.drop("row_id")
            tables.lines_with_products = with_products.drop("row_id")
            wide = add_products(with_users.withColumnRenamed("row_id", "DUPE_CHECK"), tables.products)
            tables.traced_master = wide.select([c for c in MASTER.fieldNames() if c != "row_id"])
        else:
            tables.numbered_master = saved("master", MASTER)
            tables.traced_master = tables.numbered_master.drop("row_id")
        tables.master = tables.traced_master.drop("DUPE_CHECK")
        if "numbered_master" in tables.__dict__:
            # The stored table prunes unused columns itself; no join is left to leave out.
            tables.lines_with_users = tables.lines_with_products = tables.master
        tables._kept = {name: read_parquet(spark, f"{folder}/{name}") for name in INTERMEDIATES}
        tables._kept["load_totals"] = saved("load_totals", LOAD_TOTALS)
        tables._saved = frozenset([*tables._kept, *tables.__dict__])
        return tables

    def save(self, folder: str, buckets: int | None = None) -> RetailTables:
        """Write raw, stage and master tables as Parquet and return the tables that read them.

        Each step reads what the step before it wrote, so the CSV files are parsed once.

        With ``buckets`` the wide table is not written. Lines and users are hashed to that many
        buckets by user instead, lines and products by barcode (``operators.colocated``), which
        suits tables whose users or products are often replaced. Choose it so that a bucket of
        lines is a few hundred MB.
        """

        def written(df: DataFrame, name: str, schema: StructType) -> DataFrame:
            write_parquet(df, f"{folder}/{name}")
            return read_parquet(df.sparkSession, f"{folder}/{name}", schema)

        measured = []

        def loaded(name: str, schema: StructType) -> DataFrame:
            # Measured by the tasks that write, whose work counts once for each partition, so the
            # totals are those of the files that were read.
            seen = Observation()
            df = self._raw(name)
            out = written(df.observe(seen, *load_measures(df, CONTROL_COLUMNS[name])), f"raw_{name}", schema)
            measured.append((name, len(df.columns), *[seen.get[c] for c in LOAD_TOTALS.fieldNames()[2:]]))
            return out

        raw = RetailTables(
            loaded("transactions", RAW_TRANSACTION),
            loaded("users", RAW_USER),
            loaded("products", RAW_PRODUCTS),
        )
        spark = raw.raw_users.sparkSession
        write_parquet(spark.createDataFrame(measured, LOAD_TOTALS).coalesce(1), f"{folder}/load_totals")
        lines = written(raw.numbered_transactions, "transactions", STAGE_TRANSACTION)
        users = written(raw.numbered_users, "users", STAGE_USER)
        products = written(raw.numbered_products, "products", STAGE_PRODUCTS)
        if buckets is None:
            remove(spark, f"{folder}/buckets")  # of an earlier save
            written(build_master(lines, users, products), "master", MASTER)
        else:
            write_lines(lines, users, products, folder, buckets)
            write_parquet(spark.createDataFrame([(buckets,)], BUCKETS).coalesce(1), f"{folder}/buckets")
        staged = RetailTables(raw.raw_transactions, raw.raw_users, raw.raw_products)
        staged.transactions, staged.users, staged.products = lines, users, products
        for name, make in INTERMEDIATES.items():
            write_parquet(make(staged), f"{folder}/{name}")
        return RetailTables.from_folder(lines.sparkSession, folder)

    def _raw(self, name: str) -> DataFrame:
        source = self._sources[name]
        return source if isinstance(source, DataFrame) else source()

    @cached_property
    def raw_transactions(self) -> DataFrame:
        return self._raw("transactions")

    @cached_property
    def raw_users(self) -> DataFrame:
        return self._raw("users")

    @cached_property
    def raw_products(self) -> DataFrame:
        return self._raw("products")

    def _for_numbering(self, raw: DataFrame, name: str) -> DataFrame:
        # Numbering breaks ties by arrival order, which only repeats when read from files.
        return raw if self._read_from_files else store(raw, name)

    @cached_property
    def transactions(self) -> DataFrame:
        return stage_transactions(self.raw_transactions, row_id=False)

    @cached_property
    def users(self) -> DataFrame:
        return stage_users(self.raw_users, row_id=False)

    @cached_property
    def products(self) -> DataFrame:
        return stage_products(self.raw_products, row_id=False)

    @cached_property
    def _split_transactions(self) -> tuple[DataFrame, DataFrame]:
        return split_staged(self.raw_transactions)

    @property
    def accepted_transactions(self) -> DataFrame:
        """Staged lines all of whose values cast, without numbers.

        Inside ``with tables:`` these and the rejected lines come from one scan, stored on first use.
        """
        if self._life is None:
            return stage_transactions(self.raw_transactions, "quarantine", row_id=False)
        return self._split_transactions[0]

    @property
    def rejected_transactions(self) -> DataFrame:
        """Raw lines with a value that does not cast, and the columns at fault."""
        if self._life is None:
            return rejected_rows(self.raw_transactions, TRANSACTION_TYPES)
        return self._split_transactions[1]

    @cached_property
    def numbered_transactions(self) -> DataFrame:
        return stage_transactions(self._for_numbering(self.raw_transactions, "raw_transactions"))

    @cached_property
    def numbered_users(self) -> DataFrame:
        return stage_users(self._for_numbering(self.raw_users, "raw_users"))

    @cached_property
    def numbered_products(self) -> DataFrame:
        return stage_products(self._for_numbering(self.raw_products, "raw_products"))

    @cached_property
    def master(self) -> DataFrame:
        return build_master(self.transactions, self.users, self.products, row_id=False)

    @cached_property
    def lines_with_users(self) -> DataFrame:
        """Enough where product columns are not used and repeats do not count."""
        return add_users(self.transactions, self.users)

    @cached_property
    def lines_with_products(self) -> DataFrame:
        """Enough where user columns are not used and repeats do not count."""
        return add_products(self.transactions, self.products)

    @cached_property
    def traced_master(self) -> DataFrame:
        """The master table with the transaction number of each row, but no number of its own."""
        return build_master(self.numbered_transactions, self.users, self.products, row_id=False)

    @cached_property
    def numbered_master(self) -> DataFrame:
        return build_master(self.numbered_transactions, self.users, self.numbered_products)

    @property
    def fanout(self) -> DataFrame:
        """Transaction rows that the joins multiply, from the keys alone."""
        return expected_fanout(self.numbered_transactions, self.users, self.products)

    @property
    def load_totals(self) -> DataFrame:
        """Rows, columns, control total and stray commas of each raw table.

        ``save`` takes them while it writes and keeps them, so a saved folder answers without
        a scan; otherwise each raw table is aggregated once.
        """
        return self.kept("load_totals", self._count_load_totals)

    def _count_load_totals(self) -> DataFrame:
        parts = []
        for name, amount in CONTROL_COLUMNS.items():
            raw = getattr(self, f"raw_{name}")
            counted = raw.agg(*load_measures(raw, amount))
            parts.append(
                counted.select(
                    F.lit(name).alias("table"), F.lit(len(raw.columns)).alias("TotalColumns"), *counted.columns
                )
            )
        return reduce(DataFrame.unionByName, parts)

    @property
    def user_overlap(self) -> DataFrame:
        return self.kept("user_overlap", lambda: INTERMEDIATES["user_overlap"](self))

    @property
    def barcode_overlap(self) -> DataFrame:
        return self.kept("barcode_overlap", lambda: INTERMEDIATES["barcode_overlap"](self))

    @property
    def barcode_conflicts(self) -> DataFrame:
        return self.kept("barcode_conflicts", lambda: INTERMEDIATES["barcode_conflicts"](self))


#: The numeric column of each raw table whose sum is compared with the source file.
CONTROL_COLUMNS: dict[str, str | None] = {"transactions": "FINAL_SALE", "users": None, "products": "BARCODE"}

LOAD_TOTALS = StructType(
    [
        StructField("table", StringType()),
        StructField("TotalColumns", IntegerType()),
        StructField("TotalRows", LongType()),
        StructField("CommasInLast", LongType()),
        StructField("ControlTotal", DecimalType(38, 10)),
        StructField("UnreadableAmounts", LongType()),
    ]
)

#: Into how many buckets the lines of a folder are hashed; stored only if they are.
BUCKETS = StructType([StructField("buckets", IntegerType())])

#: Intermediates that are kept for several reports, by the name of their table.
INTERMEDIATES: dict[str, Callable[[RetailTables], DataFrame]] = {
    "user_overlap": lambda t: key_overlap(
        t.users, t.transactions, "USER_ID", "User_Table_Match", "Transaction_Table_Match"
    ),
    "barcode_overlap": lambda t: key_overlap(
        t.products, t.transactions, "BARCODE", "Products_Table_Match", "Transaction_Table_Match"
    ),
    "barcode_conflicts": lambda t: conflicting_keys(
        t.raw_products, typed("BARCODE", "bigint"), PRODUCT_COLUMNS
    ),
}
