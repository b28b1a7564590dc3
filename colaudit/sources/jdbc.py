"""Relational targets over JDBC, read only."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guard import ReadOnlyViolation, assert_read

_DRIVERS = {"postgresql": ("jdbc:postgresql", "org.postgresql.Driver", 5432), "mysql": ("jdbc:mysql", "com.mysql.cj.jdbc.Driver", 3306)}
#: Each session is forced read only before any statement, and gives up locks and idle transactions soon.
_INIT = {
    "postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY; SET statement_timeout = '{statement}s'; SET lock_timeout = '{lock}s'; SET idle_in_transaction_session_timeout = '{idle}s'",
    "mysql": "SET SESSION transaction_read_only = 1, SESSION max_execution_time = {statement}000, SESSION lock_wait_timeout = {lock}, SESSION innodb_lock_wait_timeout = {lock}, SESSION wait_timeout = {idle}",
}
#: Privileges of MySQL that change data or definitions.
_WRITES = ("INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "INDEX", "TRIGGER", "REFERENCES", "CREATE VIEW", "CREATE ROUTINE", "ALTER ROUTINE", "EVENT", "CREATE TEMPORARY TABLES", "FILE", "SUPER")


def load_env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines; what the environment already has is not overwritten."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
    return {k: os.environ.get(k, v) for k, v in found.items()}


@dataclass(frozen=True)
class TargetConfig:
    dialect: str = "postgresql"
    host: str = "localhost"
    port: int | None = None
    database: str = ""
    user: str = ""
    password: str = ""

    @classmethod
    def from_env(cls, env_file: str = ".env", **overrides) -> TargetConfig:
        """Arguments over AUDIT_DB_* variables over the file over the defaults."""
        env = load_env_file(env_file) | dict(os.environ)
        found = {f: env[f"AUDIT_DB_{f.upper()}"] for f in cls.__dataclass_fields__ if f"AUDIT_DB_{f.upper()}" in env}
        found |= {k: v for k, v in overrides.items() if v is not None}
        if found.get("port"):
            found["port"] = int(found["port"])
        return cls(**found)

    @property
    def url(self) -> str:
        if self.dialect not in _DRIVERS:
            raise ValueError(f"unknown dialect {self.dialect!r}")
        prefix, _, port = _DRIVERS[self.dialect]
        return f"{prefix}://{self.host}:{self.port or port}/{self.database}"

    def __repr__(self) -> str:  # no password
        return f"TargetConfig({self.dialect}://{self.user}@{self.host}/{self.database})"

    def options(self, timeout_s: int = 30, lock_s: int = 5, idle_s: int = 60) -> dict[str, str]:
        """What each connection is opened with; Spark closes it after its part of the scan, committed or not, so nothing stays open."""
        init = _INIT[self.dialect].format(statement=timeout_s, lock=lock_s, idle=idle_s)
        return {"url": self.url, "driver": _DRIVERS[self.dialect][1], "user": self.user, "password": self.password, "sessionInitStatement": init, "queryTimeout": str(timeout_s)}


@dataclass(frozen=True)
class ReadOnlyReport:
    superuser: bool = False
    can_create: bool = False
    session_read_only: bool = True
    writable_tables: tuple[str, ...] = ()
    probe_blocked: bool | None = None  # None: no write probe has run

    @property
    def ok(self) -> bool:
        return not self.superuser and not self.can_create and self.session_read_only and not self.writable_tables and self.probe_blocked is not False

    def summary(self) -> str:
        return f"read only: {'yes' if self.ok else 'NO'} (superuser {self.superuser}, create {self.can_create}, session {self.session_read_only}, writable {len(self.writable_tables)}, probe blocked {'not run' if self.probe_blocked is None else self.probe_blocked})"


class ReadOnlyReader:
    """Reads tables of one target and nothing else; refuses an account that could write."""

    def __init__(self, spark: SparkSession, config: TargetConfig, strict: bool = True):
        self.spark, self.config = spark, config
        self.report = self.verify()
        if strict and not self.report.ok:
            raise ReadOnlyViolation(self.report.summary())

    def query(self, sql: str) -> DataFrame:
        assert_read(sql)
        return self.spark.read.format("jdbc").options(**self.config.options()).option("query", sql).load()

    def table(self, name: str, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 16) -> DataFrame:
        """A scan, split into ranges of a column where bounds are given."""
        reader = self.spark.read.format("jdbc").options(**self.config.options()).option("dbtable", name)
        if partition_column and bounds:
            reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
        return reader.load()

    def verify(self) -> ReadOnlyReport:
        """What the account may do, by the target's own catalogue."""
        if self.config.dialect == "mysql":
            return self._verify_mysql()
        who = self.query("SELECT rolsuper, has_database_privilege(current_database(), 'CREATE') AS can_create, current_setting('transaction_read_only') AS ro FROM pg_roles WHERE rolname = current_user").first()
        writable = self.query("SELECT schemaname || '.' || tablename AS t FROM pg_tables WHERE schemaname NOT IN ('pg_catalog', 'information_schema') AND has_table_privilege(schemaname || '.' || tablename, 'INSERT, UPDATE, DELETE')").limit(100).collect()
        return ReadOnlyReport(who["rolsuper"], who["can_create"], who["ro"] == "on", tuple(r["t"] for r in writable))

    def _verify_mysql(self) -> ReadOnlyReport:
        """Privileges on the server, the schema and single tables and columns; a grant on the whole schema counts as a writable table ``schema.*``."""
        me = "grantee = concat('\\'', substring_index(current_user(), '@', 1), '\\'@\\'', substring_index(current_user(), '@', -1), '\\'')"
        held = " UNION ALL ".join(
            f"SELECT {place} AS place, privilege_type AS privilege FROM information_schema.{kind}_privileges WHERE {me}"
            for kind, place in (("user", "'*.*'"), ("schema", "concat(table_schema, '.*')"), ("table", "concat(table_schema, '.', table_name)"), ("column", "concat(table_schema, '.', table_name)"))
        )
        changing = [(r["place"], r["privilege"]) for r in self.query(held).where(F.col("privilege").isin(*_WRITES)).distinct().limit(1_000).collect()]
        ro = self.query("SELECT @@session.transaction_read_only AS ro").first()["ro"]
        writes = sorted({place for place, p in changing if p in ("INSERT", "UPDATE", "DELETE")})
        return ReadOnlyReport(("*.*", "SUPER") in changing, any(p.startswith("CREATE") for _, p in changing), bool(ro), tuple(writes))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False
