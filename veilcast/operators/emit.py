"""Turns plan trees back into DataFrames, with the privacy unit's hash beside the rows where it is asked for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import PrivacyCatalog, PrivacyError, plain
from ..config import PrivacyConfig
from ..functions import pu_hash
from ..functions.worlds import WORLDS, pack
from ..plans.ir import Expr, Node, Sub


@dataclass
class Emitted:
    df: DataFrame
    #: privacy unit -> (hash column, hops to the unit, key columns that decide the hash)
    hashes: dict[str, tuple[str, int, tuple[str, ...]]] = field(default_factory=dict)
    #: columns that hold a list of 64 counters in place of a value
    counters: frozenset[str] = frozenset()


def only_one(c: Column) -> Column:
    """The value of a scalar subquery: null without rows, and an error for several."""
    return F.when(F.count("*") > 1, F.raise_error(F.lit("a scalar subquery returned more than one row"))).otherwise(F.first(c))


def member(name: str) -> Column:
    """x IN (subquery) as SQL has it: unknown where nothing matches and x, or a value of a subquery with rows, is null."""
    unknown = F.coalesce(name + "s", F.lit(False)) & (F.col(name + "n").isNull() | F.coalesce(name + "u", F.lit(False)))
    return F.when(F.col(name), F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))


class Emitter:
    def __init__(self, spark: SparkSession, catalog: PrivacyCatalog, config: PrivacyConfig):
        self.spark, self.catalog, self.config = spark, catalog, config
        self.n_hash = 0
        self.compile = None  # set by the compiler: compiles a tree that holds private aggregates

    # scans and links

    def scan(self, n: Node) -> DataFrame:
        base = self.spark.table(n.table)
        return base.select(*[F.col(f"`{name}`").alias(u) for u, name, _ in n.output])

    def hashed_scan(self, n: Node, units: set[str]) -> Emitted:
        """A scan joined along its links as far as the last table that still names the unit's key."""
        found = {u: p for u, p in self.catalog.units_of(n.table).items() if u in units}
        out = Emitted(self.scan(n))
        by_name = {name.lower(): u for u, name, _ in n.output}
        for unit, path in sorted(found.items()):
            df = out.df
            if path:
                at = [by_name.get(c.lower()) for c in path[0].local]
                if None in at:
                    raise PrivacyError(f"Column(s) {path[0].local} of table '{n.table}' must be part of the scan")
            else:
                keys = self.catalog.keys_of(unit)
                if not keys:
                    raise PrivacyError(f"Privacy unit table '{unit}' has no PRIVACY_KEY defined")
                at = [by_name[k.lower()] for k in keys]
            decides = tuple(at)
            stop = len(path) - 1 if self.config.pac_join_elimination else len(path)
            for k in range(stop):
                link, after = path[k], path[k + 1].local if k + 1 < len(path) else tuple(self.catalog.keys_of(unit))
                self.n_hash += 1
                tag = f"__l{self.n_hash}"
                parent = self.spark.table(link.table)
                right = parent.select(*[F.col(f"`{c}`").alias(f"{tag}_r{i}") for i, c in enumerate(link.remote)], *[F.col(f"`{c}`").alias(f"{tag}_n{i}") for i, c in enumerate(after)])
                on = [F.col(f"`{a}`") == F.col(f"{tag}_r{i}") for i, a in enumerate(at)]
                cond = on[0]
                for x in on[1:]:
                    cond = cond & x
                df = df.join(right, cond, "inner").drop(*[f"{tag}_r{i}" for i in range(len(link.remote))])
                at = [f"{tag}_n{i}" for i in range(len(after))]
            self.n_hash += 1
            name = f"__pu{self.n_hash}"
            df = df.withColumn(name, pu_hash([F.col(f"`{c}`") for c in at], self.config)).drop(*[c for c in at if c.startswith("__l")])
            out.df = df
            out.hashes[unit] = (name, len(path), decides)
        return out

    def counters_of(self, n: Node, keys: list[str]) -> DataFrame | None:
        """The counter lists of a private scalar aggregate by correlated columns, where a compiler can make them."""
        return None

    def counter_side(self, n: Node) -> Emitted | None:
        """A private aggregate beside private rows with its counters as columns, where a compiler can make them."""
        return None

    # subqueries

    def with_subqueries(self, e: Emitted, x: Expr, private: bool) -> tuple[Emitted, Expr]:
        """Joins the subqueries of a condition to the rows; returns the condition over the joined columns."""
        subs = []
        for s in x.subs:
            self.n_hash += 1
            name = f"__s{self.n_hash}"
            if s.outer:
                e = self.correlated(e, s, name)
                subs.append(f"`{name}`")
                continue
            inner = self.plain_or_compiled(s.plan)
            u = inner.columns[0]
            if s.kind == "scalar":
                one = inner.agg(only_one(F.col(f"`{u}`")).alias(name))
                e = replace(e, df=e.df.crossJoin(F.broadcast(one)))  # one row
                subs.append(f"`{name}`")
            elif s.kind == "exists":
                one = inner.limit(1).agg((F.count("*") > 0).alias(name))
                e = replace(e, df=e.df.crossJoin(F.broadcast(one)))  # one row
                subs.append(f"`{name}`")
            else:
                values = inner.select(F.col(f"`{u}`").alias(name + "k"))
                keys = values.filter(F.col(name + "k").isNotNull()).distinct().withColumn(name, F.lit(True))
                about = values.agg((F.count("*") > 0).alias(name + "s"), F.coalesce(F.bool_or(F.col(name + "k").isNull()), F.lit(False)).alias(name + "u"))
                needed = e.df.withColumn(name + "n", F.expr(s.needle.fill()))
                joined = needed.join(keys, F.col(name + "n") == F.col(name + "k"), "left").crossJoin(F.broadcast(about))  # one row
                e = replace(e, df=joined.withColumn(name, member(name)).drop(*[name + c for c in "knsu"]))
                subs.append(f"`{name}`")
        return e, Expr(x.fill(x_aggs(x), subs), x.refs, x.type, x.attr)

    def correlated(self, e: Emitted, s: Sub, name: str) -> Emitted:
        """A subquery correlated by equalities: computed for all values of the inner columns, then joined."""
        plan, pairs = decorrelate(s)
        inner = self.plain_or_compiled(plan)
        keys = [F.col(f"`{u}`").alias(f"{name}k{k}") for k, u in enumerate([u for u, _, _ in plan.output][-len(pairs) :])]
        cond = F.lit(True)
        for k, (_, outer) in enumerate(pairs):
            cond = cond & (F.col(f"`{outer}`") == F.col(f"{name}k{k}"))
        value, names = F.col(f"`{plan.output[0][0]}`"), [f"{name}k{k}" for k in range(len(keys))]
        if s.kind == "scalar":
            right = inner.select(*keys, value.alias(name))
            below = plan
            while below.kind == "project":
                below = below.children[0]
            if below.kind != "aggregate":  # grouped by its correlated columns, it has one row for each of their values
                right = right.groupBy(*names).agg(only_one(F.col(name)).alias(name))
            return replace(e, df=e.df.join(right, cond, "left").drop(*names))
        if s.kind == "exists":
            right = inner.select(*keys).distinct().withColumn(name, F.lit(True))
            return replace(e, df=e.df.join(right, cond, "left").drop(*names).withColumn(name, F.coalesce(name, F.lit(False))))
        values = inner.select(*keys, value.alias(name + "k"))
        about = values.groupBy(*names).agg(F.lit(True).alias(name + "s"), F.bool_or(F.col(name + "k").isNull()).alias(name + "u"))
        matched = values.filter(F.col(name + "k").isNotNull()).distinct().withColumn(name, F.lit(True))
        df = e.df.withColumn(name + "n", F.expr(s.needle.fill())).join(about, cond, "left").drop(*names)
        df = df.join(matched, cond & (F.col(name + "n") == F.col(name + "k")), "left").drop(*names)
        return replace(e, df=df.withColumn(name, member(name)).drop(*[name + c for c in "knsu"]))

    def plain_or_compiled(self, n: Node) -> DataFrame:
        return self.compile(n) if self.compile else self.emit(n, set()).df

    # trees

    def emit(self, n: Node, units: set[str]) -> Emitted:
        if n.kind == "scan":
            if n.table is None:
                raise PrivacyError("files must be registered as tables or views to be queried here")
            return self.hashed_scan(n, units) if units else Emitted(self.scan(n))
        if n.kind == "filter":
            e = self.emit(n.children[0], units)
            if e.counters & set(n.cond.refs):
                if n.cond.subs:
                    raise PrivacyError("PAC rewrite: a condition may compare counters or hold subqueries, not both")
                parts = conjuncts(n.cond.text)
                by_world = [x for x in parts if any(f"`{c}`" in x for c in e.counters)]
                for x in parts:
                    if x not in by_world:
                        e = replace(e, df=e.df.filter(x))
                return self.in_worlds(e, " AND ".join(f"({x})" for x in by_world))
            if n.cond.subs:  # all that needs no subquery first: it may hold the keys of a join below
                parts = conjuncts(n.cond.text)
                for part in parts:
                    if "{S" not in part:
                        e = replace(e, df=e.df.filter(part))
                text = " AND ".join(f"({x})" for x in parts if "{S" in x)
                n = Node("filter", n.children, n.output, cond=Expr(text, n.cond.refs, n.cond.type, None, n.cond.aggs, n.cond.subs, n.cond.outer))
                if units and (masked := self.masked_filter(e, n.cond)):
                    return masked
            e, cond = self.with_subqueries(e, n.cond, bool(units))
            return replace(e, df=e.df.filter(cond.text))
        if n.kind == "project":
            e = self.emit(n.children[0], units)
            return self.project(e, n)
        if n.kind == "join":
            return self.join(n, units)
        if n.kind == "aggregate":
            return self.inner_aggregate(n, units)
        if n.kind == "union":
            parts = [self.emit(c, units) for c in n.children]
            names = [u for u, _, _ in n.output]
            keep: dict = {}
            for unit in units:
                if all(unit in p.hashes for p in parts):
                    keep[unit] = f"__un{unit}"
            frames = []
            for c, p in zip(n.children, parts):
                cols = [F.col(f"`{u}`").alias(new) for (u, _, _), new in zip(c.output, names)]
                frames.append(p.df.select(*cols, *[F.col(p.hashes[u][0]).alias(x) for u, x in keep.items()]))
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f)
            return Emitted(df, {u: (x, 0, ()) for u, x in keep.items()})
        if n.kind == "distinct":
            e = self.emit(n.children[0], units)
            return Emitted(e.df.distinct(), e.hashes)
        if n.kind == "sort":
            e = self.emit(n.children[0], units)
            return replace(e, df=e.df.orderBy(*self.sort_columns(n)))
        if n.kind == "limit":
            e = self.emit(n.children[0], units)
            return replace(e, df=e.df.limit(n.n))
        if n.kind == "offset":
            e = self.emit(n.children[0], units)
            return replace(e, df=e.df.offset(n.n))
        if n.kind == "expand":
            e = self.emit(n.children[0], units)
            rows = [F.struct(*[F.expr(x.text).cast(t.lower()).alias(u) for x, (u, _, t) in zip(row, n.output)]) for row in n.rows]
            hashes = [h[0] for h in e.hashes.values()]
            return Emitted(e.df.select(F.explode(F.array(*rows)).alias("__e"), *hashes).select("__e.*", *hashes), e.hashes)
        if units:
            raise PrivacyError(f"PAC rewrite: a {n.kind} node is not supported below a private aggregate")
        return Emitted(self.raw(n))

    def raw(self, n: Node) -> DataFrame:
        """A subtree that is left to Spark as it is."""
        df = DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, n.java), self.spark)
        return df.toDF(*[u for u, _, _ in n.output])

    def sort_columns(self, n: Node) -> list:
        out = []
        for e, asc, first in n.orders:
            c = F.expr(e.fill())
            out.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if asc else (c.desc_nulls_first() if first else c.desc_nulls_last()))
        return out

    def project(self, e: Emitted, n: Node) -> Emitted:
        cols = []
        hashes, counters = {}, set()
        moved = {x.attr: u for x, u in n.exprs if x.attr}
        for x, u in {u: (x, u) for x, u in reversed(n.exprs)}.values():  # a column may be named twice
            if x.subs:
                e, x = self.with_subqueries(e, x, False)
            used = e.counters & set(x.refs)
            if used:
                counters.add(u)
            cols.append((each_world(x.text, used) if used and not x.attr else F.expr(x.text)).alias(u))
        for unit, (name, hops, keys) in e.hashes.items():
            hashes[unit] = (name, hops, tuple(moved.get(k, k) for k in keys))
        return Emitted(e.df.select(*cols, *[h[0] for h in e.hashes.values()]), hashes, frozenset(counters))

    def join(self, n: Node, units: set[str]) -> Emitted:
        one_sided = n.how in ("left_semi", "left_anti")
        if n.cond is not None and n.how in ("inner", "cross") and (n.cond.subs or units and any(map(self.counter_side, n.children))):
            parts = conjuncts(n.cond.text)  # what compares counters is a filter above the join
            counters = {c for child in n.children if units and (side := self.counter_side(child)) for c in side.counters}
            later = [x for x in parts if "{S" in x or any(f"`{c}`" in x for c in counters)]
            if later:
                text = lambda xs: " AND ".join(f"({x})" for x in xs)
                cond = Expr(text([x for x in parts if x not in later]), n.cond.refs, "BOOLEAN") if len(later) < len(parts) else None
                inner = Node("join", n.children, n.output, how=n.how, cond=cond)
                return self.emit(Node("filter", [inner], n.output, cond=Expr(text(later), n.cond.refs, "BOOLEAN", None, n.cond.aggs, n.cond.subs, n.cond.outer)), units)
        if n.cond is not None and n.cond.subs:
            raise PrivacyError("subqueries in the condition of an outer join are not supported")
        left = (units and self.counter_side(n.children[0])) or self.emit(n.children[0], units)
        right = (units and not one_sided and self.counter_side(n.children[1])) or self.emit(n.children[1], set() if one_sided else units)
        hashes, drop = dict(left.hashes), []
        for unit, h in right.hashes.items():
            mine = hashes.get(unit)
            # an outer join's hash must come from the side whose rows all stay; the other's is null where nothing matched
            if mine is None or n.how == "right" or (h[1] < mine[1] and n.how != "left"):
                if mine is not None:
                    drop.append(mine[0])
                hashes[unit] = h
            else:
                drop.append(h[0])
        if n.cond is None:
            df = left.df.crossJoin(right.df)  # the query's own
        else:
            df = left.df.join(right.df, F.expr(n.cond.text), "inner" if n.how == "cross" else n.how)
        return Emitted(df.drop(*drop), hashes, left.counters | right.counters)

    def inner_aggregate(self, n: Node, units: set[str]) -> Emitted:
        """An aggregate by the unit's key keeps each unit apart, so it stays exact and its hash passes through as a
        further group key. Any other inner aggregate can't be followed."""
        e = self.emit(n.children[0], units)
        if e.counters & {r for x in n.expressions() for r in x.refs}:
            raise PrivacyError("PAC rewrite: counters beside private rows may be compared, not aggregated again")
        if not units:
            return Emitted(self.aggregate(e.df, n))
        groups = {g.attr for g in n.groups}
        ok = {u: h for u, h in e.hashes.items() if h[2] and set(h[2]) <= groups}
        if set(ok) != set(e.hashes) or not ok:
            raise PrivacyError("PAC rewrite: an aggregate below a private aggregate must group by the privacy unit's key")
        moved = {x.attr: u for x, u in n.exprs if x.attr}
        df = self.aggregate(e.df, n, [h[0] for h in ok.values()])
        return Emitted(df, {u: (h[0], h[1], tuple(moved.get(k, k) for k in h[2])) for u, h in ok.items()})

    def aggregate(self, df: DataFrame, n: Node, extra: list[str] = ()) -> DataFrame:
        keyed = [F.expr(g.text).alias(f"__g{k}") for k, g in enumerate(n.groups)]
        aggs = [F.expr(x.fill([call(a) for a in x.aggs])).alias(u) for x, u in n.exprs if x.aggs] or [F.count("*").alias("__n")]
        out = df.select("*", *keyed).groupBy(*[f"__g{k}" for k in range(len(keyed))], *extra).agg(*aggs)
        return out.select(*group_outputs(n), *extra)

    def masked_filter(self, e: Emitted, cond: Expr) -> Emitted | None:
        """A condition on an uncorrelated scalar subquery over private data, below a private aggregate: rows
        keep the worlds in which it holds, and go if none is left."""
        if not (self.config.pac_select and self.config.pac_categorical) or len(cond.subs) != 1 or cond.subs[0].kind != "scalar":
            return None
        s = cond.subs[0]
        plan, pairs = decorrelate(s) if s.outer else (s.plan, [])
        counters = self.counters_of(plan, [i for i, _ in pairs])
        if counters is None:
            return None
        if pairs:
            match = F.lit(True)
            for inner, outer in pairs:
                match = match & (F.col(f"`{outer}`") == F.col(f"__k_{inner}"))
            df = e.df.join(counters.withColumnRenamed("c", "__c"), match, "inner").drop(*[f"__k_{i}" for i, _ in pairs])
        else:
            df = e.df.crossJoin(F.broadcast(counters.withColumnRenamed("c", "__c")))  # one row
        world = cond.fill([], ["`__c`"])
        out = self.in_worlds(replace(e, df=df, counters=e.counters | {"__c"}), world)
        return replace(out, df=out.df.drop("__c"), counters=e.counters)

    def in_worlds(self, e: Emitted, cond: str) -> Emitted:
        """Private rows keep the worlds in which a condition on counters holds, and go if none is left."""
        if not e.hashes:
            raise PrivacyError("PAC rewrite: counters can only be compared with rows of a privacy unit here")
        mask, df = pack(each_world(cond, e.counters, "BOOLEAN")), e.df
        for name, _, _ in e.hashes.values():
            df = df.withColumn(name, F.col(name).bitwiseAND(mask))
        first = next(iter(e.hashes.values()))[0]
        return replace(e, df=df.filter(F.col(first) != 0))


def each_world(text: str, counters, kind: str = "DOUBLE") -> Column:
    """An expression evaluated in each world, where these columns hold lists of counters."""
    for c in counters:
        text = text.replace(f"`{c}`", f"element_at(`{c}`, CAST(__j AS INT) + 1)")
    return F.expr(f"transform(sequence(0, {WORLDS - 1}), __j -> CAST({text} AS {kind}))")


def conjuncts(text: str) -> list[str]:
    """The parts of a conjunction."""
    text = text.strip()
    while text.startswith("(") and _closes(text) == len(text) - 1:
        text = text[1:-1].strip()
    depth, parts, at = 0, [], 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and text[k : k + 5] == " AND ":
            parts.append(text[at:k])
            at = k + 5
    parts.append(text[at:])
    return parts if len(parts) == 1 else [x for p in parts for x in conjuncts(p)]


def _closes(text: str) -> int:
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return k
    return -1


def decorrelate(s: Sub) -> tuple[Node, list[tuple[str, str]]]:
    """The subquery's plan without its correlation, whose inner columns are further outputs (and groups), with
    the pairs (inner, outer) of columns that have to be equal."""
    pairs: list[tuple[str, str]] = []

    def strip(n: Node) -> Node:
        kept = []
        if n.kind == "filter" and set(n.cond.outer):
            for part in conjuncts(n.cond.text):
                m = re.fullmatch(r"\(*`(\w+)` = `(\w+)`\)*", part.strip())
                if m and (m[2] in s.outer) != (m[1] in s.outer):
                    pairs.append((m[1], m[2]) if m[2] in s.outer else (m[2], m[1]))
                elif any(f"`{o}`" in part for o in s.outer):
                    raise PrivacyError("a correlated subquery may refer to outer columns by equality only")
                else:
                    kept.append(part)
            child = strip(n.children[0])
            return child if not kept else Node("filter", [child], n.output, cond=Expr(" AND ".join(f"({k})" for k in kept), n.cond.refs, "BOOLEAN", None, [], n.cond.subs))
        if n.kind not in ("filter", "project", "aggregate", "join"):
            return n
        before = len(pairs)
        children = [strip(c) for c in n.children]
        new = pairs[before:]
        out = Node(n.kind, children, list(n.output), n.table, list(n.exprs), list(n.groups), n.grouping_sets, n.cond, n.how, n.orders, n.n)
        for inner, _ in new:
            x, kind = Expr(f"`{inner}`", [inner], "", inner), next((t for c in children for u, _, t in c.output if u == inner), "")
            if n.kind in ("project", "aggregate"):
                out.exprs.append((x, inner))
                out.output.append((inner, inner, kind))
            if n.kind == "aggregate":
                out.groups.append(x)
        return out

    plan = strip(s.plan)
    if not pairs:
        raise PrivacyError("a correlated subquery needs an equality with an outer column")
    if plan.kind not in ("project", "aggregate"):
        names = [(Expr(f"`{u}`", [u], t, u), u) for u, _, t in plan.output] + [(Expr(f"`{i}`", [i], "", i), i + "__k") for i, _ in pairs]
        plan = Node("project", [plan], [(u, u, "") for _, u in names], exprs=names)
    return plan, pairs


def group_outputs(n: Node) -> list:
    """The output columns of a grouped result: its aggregates by name, all else over the group keys __g0, __g1, ..."""
    texts = {g.text: f"`__g{k}`" for k, g in enumerate(n.groups)}
    out = []
    for x, u in n.exprs:
        text = x.text
        if not x.aggs:
            for t in sorted(texts, key=len, reverse=True):
                text = text.replace(t, texts[t])
        out.append(F.col(f"`{u}`") if x.aggs else F.expr(text).alias(u))
    return out


def x_aggs(x: Expr) -> list[str]:
    return [f"{{A{k}}}" for k in range(len(x.aggs))]


def call(a) -> str:
    """An aggregate as SQL."""
    arg = "*" if a.arg is None else a.arg.fill()
    text = f"{a.func}({'DISTINCT ' if a.distinct else ''}{arg})"
    return text + (f" FILTER (WHERE {a.where.fill()})" if a.where else "")


__all__ = ["Emitter", "Emitted", "call", "plain"]
