"""The session: SQL in, privatized DataFrames out."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ddl
from .catalog import Link, PrivacyCatalog, PrivacyError, TableMeta, plain
from .config import PrivacyConfig
from .functions import sqltext
from .operators import derived, diff
from .operators.clip import ClipCompiler
from .operators.elastic import ElasticCompiler
from .operators.worlds_compiler import WorldsCompiler
from .plans.check import Lineage, check, private_scans
from .plans.ir import Node, Reader, fingerprint
from .session import ship

_CTAS = re.compile(r"^CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+([\w.`]+)\s+(?:USING\s+\w+\s+)?AS\s+(.*)$", re.I | re.S)
_INSERT = re.compile(r"^INSERT\s+(INTO|OVERWRITE)\s+(?:TABLE\s+)?([\w.`]+)\s+(SELECT\b.*|WITH\b.*)$", re.I | re.S)
_PRAGMA = re.compile(r"^(?:PRAGMA|CALL)\s+(save|load|clear)_privacy_metadata\s*(?:\(\s*'?([^')]*)'?\s*\))?$", re.I)
_SET = re.compile(r"^(SET|RESET)\s+((?:pac|privacy|dp)_\w+)\s*(?:=|TO)?\s*(.*)$", re.I)


class PrivacySession:
    """Runs statements under the declared policy.

    `metadata` is a JSON file that is loaded if it exists and rewritten after each declaration."""

    def __init__(self, spark: SparkSession, config: PrivacyConfig | None = None, metadata: str | None = None):
        self.spark, self.config, self.metadata = spark, config or PrivacyConfig(), metadata
        self.catalog = PrivacyCatalog.load(metadata) if metadata and os.path.exists(metadata) else PrivacyCatalog()
        ship(spark)

    # statements

    def sql(self, text: str) -> DataFrame:
        text = ddl.clean(text)
        if m := _PRAGMA.match(text):
            return self.pragma(m[1].lower(), m[2])
        if m := _SET.match(text):
            return self.setting(m[1].upper(), m[2].lower(), m[3].strip())
        if (statement := ddl.parse(text)) is not None:
            return self.declare(statement)
        if m := re.match(r"^DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?([\w.`]+)$", text, re.I):
            out = self.spark.sql(text)
            self.catalog.drop(m[1])
            self._save()
            return out
        if m := re.match(r"^EXPLAIN\s+(?:EXTENDED\s+|FORMATTED\s+)?(.*)$", text, re.I | re.S):
            return self.spark.createDataFrame([(self.explain(m[1]),)], "plan string")
        if m := _CTAS.match(text):
            return self.create_as(plain(m[1]), m[2])
        if m := _INSERT.match(text):
            return self.insert(plain(m[2]), m[3], m[1].upper() == "OVERWRITE")
        return self.query(text)

    def setting(self, verb: str, name: str, value: str) -> DataFrame:
        if verb == "RESET":
            parsed = getattr(PrivacyConfig(), name)
        else:
            raw = value.strip("'\"")
            current = getattr(PrivacyConfig(), name, None)
            low = raw.lower()
            if low == "null":
                parsed = None
            elif low in ("true", "false"):
                parsed = low == "true"
            elif isinstance(current, str) or name in ("pac_diffcols", "privacy_mode"):
                parsed = raw
            else:
                parsed = float(raw) if re.search(r"[.eE]", raw) else int(raw)
        self.config.set(name, parsed)
        return self.spark.createDataFrame([(name, str(parsed))], "name string, value string")

    def pragma(self, action: str, path: str | None) -> DataFrame:
        path = path or self.metadata
        if action == "clear":
            self.catalog.tables.clear()
            if path and os.path.exists(path):
                os.remove(path)
        elif not path:
            raise PrivacyError(f"{action}_privacy_metadata needs a path")
        elif action == "save":
            self.catalog.save(path)
        else:
            self.catalog = PrivacyCatalog.load(path)
        return self.spark.createDataFrame([(True,)], "success boolean")

    def columns_of(self, table: str) -> list[str] | None:
        return self.spark.table(table).columns if self.spark.catalog.tableExists(table) else None

    def declare(self, s: ddl.Statement) -> DataFrame:
        created = False
        if s.sql and not (s.if_not_exists and self.columns_of(s.table) is not None):
            self.spark.sql(s.sql)
            created = True
        try:
            ddl.apply(self.catalog, s, self.columns_of)
        except PrivacyError:
            if created:
                self.spark.sql(f"DROP TABLE {s.table}")
            raise
        self._save()
        return self.spark.range(0).selectExpr("true AS success")

    def _save(self) -> None:
        if self.metadata:
            self.catalog.save(self.metadata)

    # queries

    def read(self, text: str) -> Node:
        return Reader(self.spark).read(self.spark.sql(ddl.clean(text)))

    def query(self, text: str, keep_counters: bool = False) -> DataFrame:
        cfg = self.config
        if sqltext.aggregates(text):
            return self.own_counters(text)
        with self.shadowed(text):
            exact = sqltext.analysed(self.spark, text, cfg)[0] if sqltext.calls(text) else self.spark.sql(text)
        root = Reader(self.spark).read(exact)
        if not cfg.pac_rewrite:
            return exact
        if derived.reads_counters(root, self.catalog):
            if cfg.pac_check:
                check(root, self.catalog, cfg.pac_conservative_mode)
            return derived.read(self, root, exact)
        try:
            verdict = check(root, self.catalog, cfg.pac_conservative_mode)
        except PrivacyError:
            if cfg.pac_check:
                raise
            return exact
        if not verdict.rewrite:
            return exact
        if cfg.privacy_mode == "pac" and cfg.privacy_noise is False and not keep_counters:
            return exact
        private = self.compiled(root, exact, keep_counters)
        if cfg.pac_diffcols:
            return diff.utility_diff(private, exact, root, cfg)
        return private

    @contextmanager
    def shadowed(self, text: str) -> Iterator[None]:
        """While a text is analysed, counter columns of derived tables look like the numbers they are read as."""
        names = [m.name for m in self.catalog.tables.values() if self.config.pac_rewrite and m.derived and m.counter_columns and re.search(rf"\b{re.escape(m.name)}\b", text, re.I)]
        names = [n for n in names if self.spark.catalog.tableExists(n)]
        for name in names:
            counters, df = {c.lower() for c in self.catalog.get(name).counter_columns}, self.spark.table(name)
            df.select(*[F.get(f"`{c}`", F.lit(0)).cast("double").alias(c) if c.lower() in counters else F.col(f"`{c}`") for c in df.columns]).createOrReplaceTempView(name)
        try:
            yield
        finally:
            for name in names:
                self.spark.catalog.dropTempView(name)

    def own_counters(self, text: str) -> DataFrame:
        """A query that calls the counters itself is released as written, if no private row gets out beside them."""
        cfg = self.config
        shape, lists = None, ()
        for lists in sqltext.readings(text):
            try:
                shape = Reader(self.spark).read(self.spark.sql(sqltext.outline(text, cfg, lists)))
                salted = cfg.for_query(fingerprint(shape))
                exact = sqltext.analysed(self.spark, text, salted, [lists])[0]
                break
            except AnalysisException:
                shape = None
        if shape is None:
            exact, _ = sqltext.analysed(self.spark, text, cfg)  # raises what the analyser has to say
            shape = Reader(self.spark).read(exact)
        if cfg.pac_rewrite and cfg.pac_check:
            check(shape, self.catalog, cfg.pac_conservative_mode, own=True)
        if any(c in sqltext.CLIPPED for c in sqltext.calls(text)):
            root = Reader(self.spark).read(exact)
            out = ClipCompiler(self.spark, self.catalog, salted).emit(root, set()).df
            return out.select([u for u, _, _ in root.output]).toDF(*exact.columns)
        return exact

    def compiled_config(self, text: str) -> PrivacyConfig:
        """The settings that a query is compiled with."""
        return self.config.for_query(fingerprint(self.read(text)))

    def compiled(self, root: Node, exact: DataFrame, keep_counters: bool = False) -> DataFrame:
        cfg = self.config.for_query(fingerprint(root))
        if cfg.privacy_mode == "dp_elastic":
            out = ElasticCompiler(self.spark, self.catalog, cfg).compile_root(root)
        else:
            out = WorldsCompiler(self.spark, self.catalog, cfg, keep_counters).compile_tree(root)
        return out.select([u for u, _, _ in root.output]).toDF(*exact.columns)

    def explain(self, text: str, mode: str = "extended") -> str:
        return self.query(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    # tables from queries

    def create_as(self, table: str, text: str) -> DataFrame:
        exact = self.spark.sql(text)
        root = Reader(self.spark).read(exact)
        private = bool(private_scans(root, self.catalog)) and self.config.pac_rewrite
        aggregated = any(n.kind == "aggregate" for n in root.walk())
        if private and not aggregated:
            meta = self._copied(table, root)
            exact.write.saveAsTable(table)
            self.catalog.tables[meta.name] = meta
        elif private:
            out = self.query(text, keep_counters=True)
            out.write.saveAsTable(table)
            meta = self.catalog.ensure(table)
            meta.derived = True
            meta.counter_columns = [f.name for f in out.schema.fields if f.dataType.simpleString() == "array<float>"]
            if self.config.pac_ctas:
                self._inherit(meta, root)
        else:
            exact.write.saveAsTable(table)
        self._save()
        return self.spark.table(table)

    def _copied(self, table: str, root: Node) -> TableMeta:
        """What is declared of a table of private rows: renamed links and protected columns; a unit's rows link to their
        unit by its key. Rows with protected columns that can't be tied to their unit are refused."""
        lineage, meta = Lineage(root, self.catalog), TableMeta(plain(table))
        named = {next(iter(o)): name for u, name, _ in root.output if len(o := lineage.origin.get(u, set())) == 1}
        for scan in {plain(n.table) for n in private_scans(root, self.catalog)}:
            own = self.catalog.get(scan)
            ways = [(x.local, x.table, x.remote) for x in own.links] if own else []
            if self.catalog.is_pu(scan):
                ways.append((tuple(self.catalog.keys_of(scan)), scan, tuple(self.catalog.keys_of(scan))))
            for local, to, remote in ways:
                names = tuple(named.get((scan, c.lower()), "") for c in local)
                if all(names):
                    meta.links.append(Link(names, to, remote))
        self._inherit(meta, root)
        if meta.protected and not any(self.catalog.units_of(x.table) for x in meta.links):
            raise PrivacyError(f"Table '{meta.name}' would hold protected columns without the key or link of their privacy unit")
        return meta

    def _inherit(self, meta: TableMeta, root: Node) -> None:
        """Protected columns that pass through a query stay protected, under their new names."""
        lineage = Lineage(root, self.catalog)
        for u, name, _ in root.output:
            for source, column in sorted(lineage.origin.get(u, set())):
                if column in self.catalog.protected_of(source) and name not in meta.protected:
                    meta.protected.append(name)

    def insert(self, table: str, text: str, overwrite: bool) -> DataFrame:
        meta = self.catalog.get(table)
        out = self.query(text, keep_counters=bool(meta and meta.derived))
        out.write.insertInto(table, overwrite=overwrite)
        return self.spark.createDataFrame([], "success boolean")

    def drop_table(self, table: str) -> None:
        self.sql(f"DROP TABLE IF EXISTS {table}")
