"""Derived tables: stored counter lists are finalised when read, and compared world by world when filtered."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import PrivacyCatalog, PrivacyError
from ..config import PrivacyConfig
from ..functions import noise, worlds
from ..plans.check import private_scans
from ..plans.ir import Node
from .emit import Emitted, Emitter, call, conjuncts, each_world, group_outputs

if TYPE_CHECKING:
    from ..engine import PrivacySession

def reads_counters(root: Node, catalog: PrivacyCatalog) -> bool:
    return any(n.kind == "scan" and n.table and (m := catalog.get(n.table)) and m.derived and m.counter_columns for n in root.walk())


class DerivedReader(Emitter):
    """Scans of derived tables give one finalised value for each counter list, and keep the list beside it. Conditions on such
    values are evaluated in each world, and the worlds decide by vote; aggregates reduce the lists and are finalised then."""

    def __init__(self, spark: SparkSession, catalog: PrivacyCatalog, config: PrivacyConfig):
        super().__init__(spark, catalog, config)
        self.lists: dict[str, str] = {}  # finalised column -> its list

    def scan(self, n: Node) -> DataFrame:
        meta = self.catalog.get(n.table)
        base = self.spark.table(n.table)
        counters = {c.lower() for c in meta.counter_columns} if meta and meta.derived else set()
        keys = [F.col(f"`{name}`") for _, name, _ in n.output if name.lower() not in counters]
        cols = []
        for u, name, _ in n.output:
            c = F.col(f"`{name}`")
            if name.lower() in counters:
                self.lists[u] = f"__raw_{u}"
                cols += [noise.pac_finalize(c, self.config, f"{n.table}.{name}", keys).alias(u), c.cast("array<double>").alias(self.lists[u])]
            else:
                cols.append(c.alias(u))
        return base.select(*cols)

    def raw(self, n: Node) -> DataFrame:
        if reads_counters(n, self.catalog):
            raise PrivacyError(f"PAC rewrite: a {n.kind} node is not supported above a derived table")
        return super().raw(n)

    def emit(self, n: Node, units: set[str]) -> Emitted:
        if n.kind == "filter" and not n.cond.subs:
            e = self.emit(n.children[0], units)
            used = [r for r in n.cond.refs if self.lists.get(r) in e.df.columns]
            for part in conjuncts(n.cond.text) if used else [n.cond.text]:
                own = [u for u in used if f"`{u}`" in part]
                text = part
                for u in own:
                    text = text.replace(f"`{u}`", f"`{self.lists[u]}`")
                self.n_hash += 1
                visible = [F.col(f"`{u}`") for u, _, _ in n.children[0].output if u not in self.lists]
                e = Emitted(e.df.filter(worlds.pac_filter(each_world(text, [self.lists[u] for u in own], "BOOLEAN"), self.config, tag=f"read{self.n_hash}", keys=visible) if own else part))
            return e
        if n.kind in ("distinct", "union", "expand"):
            children = [self.emit(c, units).df.select(*[u for u, _, _ in c.output]) for c in n.children]
            plain = {id(c): df for c, df in zip(n.children, children)}
            return _Given(self, plain).emit(n, units)
        return super().emit(n, units)

    def project(self, e: Emitted, n: Node) -> Emitted:
        out = {}
        for x, u in n.exprs:
            if x.attr in self.lists and self.lists[x.attr] in e.df.columns:
                self.lists[u] = f"__raw_{u}"
                out[self.lists[u]] = self.lists[x.attr]
        named = super().project(Emitted(e.df), n).df.columns
        text = {u: x for x, u in n.exprs}
        if any(x.subs for x in text.values()):
            return super().project(e, n)
        return Emitted(e.df.select(*[F.expr(text[u].text).alias(u) for u in named], *[F.col(f"`{old}`").alias(new) for new, old in out.items() if new not in named]))

    def aggregate(self, df: DataFrame, n: Node, extra: list[str] = ()) -> DataFrame:
        own = [a for x, _ in n.exprs for a in x.aggs if a.arg is not None and a.arg.attr in self.lists and a.func in _LISTS and not a.distinct and a.where is None and self.lists[a.arg.attr] in df.columns]
        if not own:
            return super().aggregate(df, n, extra)
        keys = [F.expr(g.text).alias(f"__g{k}") for k, g in enumerate(n.groups)]
        calls = {id(a): f"__d{k}" for k, a in enumerate(a for x, _ in n.exprs for a in x.aggs)}
        made = [(_LISTS[a.func](F.col(f"`{self.lists[a.arg.attr]}`")) if any(a is b for b in own) else F.expr(call(a))).alias(calls[id(a)]) for x, _ in n.exprs for a in x.aggs]
        rows = df.select("*", *keys)
        names = [f"__g{k}" for k in range(len(keys))]
        out = rows.groupBy(*names).agg(*made)
        group = [F.col(k) for k in names]
        values = [noise.pac_finalize(F.col(calls[id(a)]), self.config, f"agg{calls[id(a)]}", group).alias(calls[id(a)] + "v") for a in own]
        out = out.select("*", *values)
        mine = {id(a) for a in own}
        return out.select("*", *[F.expr(x.fill([f"`{calls[id(a)]}{'v' if id(a) in mine else ''}`" for a in x.aggs])).cast(x.type.lower()).alias(u) for x, u in n.exprs if x.aggs]).select(*group_outputs(n))


class _Given(Emitter):
    """Emits one node over children that are there already."""

    def __init__(self, reader: DerivedReader, given: dict[int, DataFrame]):
        super().__init__(reader.spark, reader.catalog, reader.config)
        self.given = given

    def emit(self, n: Node, units: set[str]) -> Emitted:
        return Emitted(self.given[id(n)]) if id(n) in self.given else super().emit(n, units)


#: Aggregates of counter columns are those of their lists, world by world.
_LISTS = {"sum": worlds.pac_sum_list, "min": worlds.pac_min_list, "max": worlds.pac_max_list}


def read(session: PrivacySession, root: Node, exact: DataFrame) -> DataFrame:
    open_ = [n.table for n in private_scans(root, session.catalog) if not session.catalog.get(n.table) or not session.catalog.get(n.table).derived]
    if open_:
        raise PrivacyError(f"PAC rewrite: a derived table can't be read beside private tables ({', '.join(sorted(set(open_)))})")
    e: Emitted = DerivedReader(session.spark, session.catalog, session.config.for_query(0)).emit(root, set())
    return e.df.select([u for u, _, _ in root.output]).toDF(*[name for _, name, _ in root.output])


def filter_counters(df: DataFrame, column: str, op: str, value: float, config, tag: str = "derived") -> DataFrame:
    """Rows of a derived table whose counters compare with a value in enough worlds."""
    flipped = {"<": "gt", "<=": "gte", ">": "lt", ">=": "lte", "=": "eq", "<>": "neq"}[op]
    return df.filter(worlds.pac_filter_cmp(flipped, F.lit(float(value)), F.col(column), config, tag=tag))


__all__ = ["DerivedReader", "filter_counters", "read", "reads_counters"]
