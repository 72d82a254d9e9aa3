"""Compiles aggregate queries so that each answer is computed in 64 possible worlds and released with noise.

Rows of one privacy unit share a hash, so a query is first aggregated by (group, hash) with plain SUM, COUNT, MIN and
MAX, and the 64 counters are made from those far fewer rows. Counters stay columns of doubles until the release.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import PrivacyCatalog, PrivacyError
from ..config import PrivacyConfig
from ..functions import noise, worlds
from ..plans.check import ALLOWED, private_scans
from ..plans.ir import Agg, Expr, Node
from .clip import clip_branch
from .counting import world_table
from .emit import Emitted, Emitter, call, each_world, group_outputs

NUMERIC = ("INT", "BIGINT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL", "BOOLEAN", "DATE", "TIMESTAMP")


@dataclass
class Cell:
    """Counters of one aggregate call in a grouped DataFrame."""

    counters: str  # column of array<double>, unscaled
    mask: str
    scale: float
    scaled: bool
    type: str


class WorldsCompiler(Emitter):
    def __init__(self, spark: SparkSession, catalog: PrivacyCatalog, config: PrivacyConfig, keep_counters: bool = False):
        super().__init__(spark, catalog, config)
        self.compile = self.compile_tree
        self.keep_counters = keep_counters
        self.tag, self.correction, self.keys, self.extra, self.guarded = 0, 1.0, [], [], False

    # where to compile

    def direct(self, n: Node) -> list[Node]:
        """Scans below an aggregate with no other aggregate between."""
        if n.kind == "scan":
            return [n]
        return [s for c in n.children if c.kind != "aggregate" for s in self.direct(c)]

    def passes_key(self, n: Node) -> bool:
        """Whether an aggregate groups by a key or link column of a private scan below it."""
        names = {}
        for s in n.walk():
            if s.kind == "scan" and s.table:
                for unit, path in self.catalog.units_of(s.table).items():
                    cols = path[0].local if path else self.catalog.keys_of(unit)
                    ids = {name.lower(): u for u, name, _ in s.output}
                    names[tuple(ids.get(c.lower()) for c in cols)] = unit
        groups = {g.attr for g in n.groups}
        return any(set(k) <= groups for k in names)

    def is_target(self, n: Node) -> bool:
        if n.kind != "aggregate":
            return False
        if any(s.table and self.catalog.units_of(s.table) for s in self.direct(n)):
            return True
        inner = [c for c in n.walk() if c.kind == "aggregate" and c is not n]
        return bool(inner) and private_scans(n, self.catalog) != [] and all(self.passes_key(c) for c in inner if private_scans(c, self.catalog))

    def compile_tree(self, n: Node) -> DataFrame:
        if not private_scans(n, self.catalog):
            return self.emit(n, set()).df
        if n.kind == "limit" and self.config.pac_pushdown_topk and (top := self.top_k(n)) is not None:
            return top
        if self.is_target(n):
            return self.release(*self.counted(n))
        if n.kind == "filter":
            if (by_world := self.voted_filter(n)) is not None:
                return by_world
            e, cond = self.with_subqueries(Emitted(self.compile_tree(n.children[0])), n.cond, False)
            return e.df.filter(cond.text)
        if n.kind == "project":
            return self.project(Emitted(self.compile_tree(n.children[0])), n).df
        if n.kind == "aggregate":
            return self.aggregate(self.compile_tree(n.children[0]), n)
        if n.kind == "join":
            left, right = self.compile_tree(n.children[0]), self.compile_tree(n.children[1])
            return left.crossJoin(right) if n.cond is None else left.join(right, F.expr(n.cond.text), "inner" if n.how == "cross" else n.how)
        if n.kind == "union":
            names = [u for u, _, _ in n.output]
            frames = [self.compile_tree(c).toDF(*names) for c in n.children]
            df = frames[0]
            for f in frames[1:]:
                df = df.union(f)
            return df
        if n.kind in ("sort", "limit", "offset", "distinct"):
            df = self.compile_tree(n.children[0])
            return {"sort": lambda: df.orderBy(*self.sort_columns(n)), "limit": lambda: df.limit(n.n), "offset": lambda: df.offset(n.n), "distinct": df.distinct}[n.kind]()
        if n.kind == "scan":
            return self.scan(n)
        if n.kind == "window":
            df = self.compile_tree(n.children[0])
            return df.select("*", *[F.expr(x.fill([call(a) for a in x.aggs])).alias(u) for x, u in n.exprs])
        raise PrivacyError(f"PAC rewrite: a {n.kind} node is not supported above a private aggregate")

    def voted_filter(self, n: Node) -> DataFrame | None:
        """A filter by a private scalar aggregate with no private aggregate above: the condition is evaluated in each world,
        and the worlds decide by vote."""
        cfg, s = self.config, n.cond.subs[0] if len(n.cond.subs) == 1 else None
        if not cfg.pac_categorical or s is None or s.kind != "scalar" or s.outer or not private_scans(s.plan, self.catalog):
            return None
        counters = self.counters_of(s.plan, [])
        if counters is None:
            return None
        self.n_hash += 1
        name = f"__v{self.n_hash}"
        df = self.compile_tree(n.children[0]).crossJoin(F.broadcast(counters.withColumnRenamed("c", name)))  # one row
        bits = each_world(n.cond.fill([], [f"`{name}`"]), [name], "BOOLEAN")
        return df.filter(worlds.pac_filter(bits, cfg, self.correction, name, [F.col(f"`{u}`") for u, _, _ in n.children[0].output])).drop(name)

    def counter_side(self, n: Node) -> Emitted | None:
        below = n
        while below.kind in ("project", "sort"):
            below = below.children[0]
        if below.kind != "aggregate" or not private_scans(below, self.catalog) or not self.config.pac_categorical:
            return None
        if self.passes_key(below) or not self.is_target(below) or any(a.func not in ALLOWED for x, _ in below.exprs for a in x.aggs):
            return None
        if n.kind == "sort":
            return self.counter_side(n.children[0])
        if n.kind == "project":
            inner = self.counter_side(n.children[0])
            return inner and self.project(inner, n)
        keep, keys, extra = self.correction, self.keys, self.extra  # of the aggregate that this one is beside
        df, _, outs = self.counted(n)
        self.extra = []
        made = {u: self.per_world(x, cells) for x, u, cells in outs if x.aggs}
        df = df.select("*", *[c.alias(name) for name, c in self.extra])
        df = df.select("*", *[c.alias(u) for u, c in made.items()]).select(*group_outputs(n))
        self.correction, self.keys, self.extra = keep, keys, extra
        return Emitted(df, {}, frozenset(made))

    def counters_of(self, n: Node, keys: list[str]) -> DataFrame | None:
        """(c, __k_<key>, ...): the counter list of a private scalar aggregate, by its correlated columns, for
        comparison world by world. A projection above the aggregate is evaluated in each world."""
        top: Expr | None = None
        while n.kind in ("project", "sort", "limit") and len(n.children) == 1:
            if n.kind == "project":
                own = [(x, u) for x, u in n.exprs if u not in keys]
                if len(own) != 1 or top is not None and own[0][0].attr is None:
                    return None
                top = own[0][0] if own[0][0].attr is None else top
            n = n.children[0]
        own = [(x, u) for x, u in n.exprs if u not in keys] if n.kind == "aggregate" else []
        if not self.is_target(n) or len(n.groups) != len(keys) or len(own) != 1:
            return None
        df, _, outs = self.counted(n)
        found = next(o for o in outs if o[1] == own[0][1])
        self.extra = []
        made = self.per_world(found[0], found[2])
        df = df.select("*", *[c.alias(name) for name, c in self.extra]).withColumn("c", made)
        if top is not None:
            df = df.withColumn("__inner", F.col("c")).withColumn("c", F.expr(f"transform(sequence(0, 63), __j -> double({top.text.replace(f'`{own[0][1]}`', 'element_at(__inner, CAST(__j AS INT) + 1)')}))"))
        groups = {g.attr: f"__g{k}" for k, g in enumerate(n.groups)}
        return df.select("c", *[F.col(groups[i]).alias(f"__k_{i}") for i in keys])

    # counting

    def counted(self, n: Node) -> tuple[DataFrame, Node, list]:
        """(grouped rows with counters, the aggregate, for each output its expression, name and cells)."""
        units = {u for s in private_scans(n, self.catalog) for u in self.catalog.units_of(s.table)}
        below = self.emit(n.children[0], units)
        if set(below.hashes) != units:
            raise PrivacyError(f"PAC rewrite: table(s) must be joined with the privacy unit table {sorted(units - set(below.hashes))}")
        names = [h[0] for h in below.hashes.values()]
        h = F.col(names[0])
        for other in names[1:]:
            h = h.bitwiseAND(F.col(other))
        self.correction = float(2 ** (len(names) - 1))
        rows = below.df.select("*", h.alias("__h"), *[F.expr(g.text).alias(f"__g{k}") for k, g in enumerate(n.groups)])
        keys = [f"__g{k}" for k in range(len(n.groups))]
        calls: list[Agg] = []
        for x, _ in n.exprs:
            for a in x.aggs:
                if a.func not in ALLOWED:
                    raise PrivacyError(f"PAC rewrite: unsupported aggregate function: {a.func}")
                if a.func in ("min", "max") and not a.arg.type.upper().startswith(NUMERIC):
                    raise PrivacyError(f"PAC rewrite: {a.func} of {a.arg.type} is not implemented")
                if not any(a is c for c in calls):
                    calls.append(a)
        plain_calls = [a for a in calls if not a.distinct or a.func in ("min", "max")]
        by_arg: dict[tuple[str, str | None], list[Agg]] = {}
        for a in calls:
            if a.distinct and a.func not in ("min", "max"):
                by_arg.setdefault((a.arg.fill(), a.where and a.where.fill()), []).append(a)
        branches, cells = [], {}
        if plain_calls or not by_arg:
            branches.append(self.plain_branch(rows, keys, plain_calls, cells))
        for (arg, where), own in by_arg.items():
            branches.append(self.distinct_branch(rows, keys, arg, where, own, cells))
        df = branches[0]
        for other in branches[1:]:
            df = self.beside(df, other, keys)
        outs = [(x, u, [cells[id(a)] for a in x.aggs]) for x, u in n.exprs]
        self.keys = [F.col(c) for c in keys]
        return df, n, outs

    def plain_branch(self, rows: DataFrame, keys: list[str], calls: list[Agg], cells: dict) -> DataFrame:
        """Counters by way of one row for each (group, unit hash)."""
        first = [F.count("*").alias("__u")]
        for k, a in enumerate(calls):
            value = F.lit(1) if a.arg is None else F.expr(a.arg.fill())
            v = value if a.where is None else F.when(F.expr(a.where.fill()), value)
            number = self.number(v, a)
            if a.func in ("sum", "avg"):
                first += [F.sum(number).alias(f"__v{k}"), F.count(v).alias(f"__n{k}")]
            elif a.func == "count":
                first += [F.count(v).alias(f"__n{k}")]
            else:
                first += [(F.min if a.func == "min" else F.max)(number).alias(f"__v{k}")]
        per_unit = rows.filter("__h IS NOT NULL").groupBy(*keys, "__h").agg(*first)
        clipped: list[tuple] = []
        specs: list[tuple] = []

        def made(k: int, c: str, m: str, value: Column, func: str, column: str) -> None:
            if self.config.pac_clip_support is not None:
                clipped.append((f"__{c}{k}", f"__{m}{k}", func, f"CASE WHEN {column} > 0 THEN {column} END" if column.startswith("__n") else column))
            else:
                specs.append((f"__{c}{k}", f"__{m}{k}", func, value))

        for k, a in enumerate(calls):
            v, n = F.col(f"__v{k}"), F.col(f"__n{k}")
            some = F.when(n > 0, n)
            if a.func in ("min", "max"):
                made(k, "c", "m", F.col(f"__v{k}"), a.func, f"__v{k}")
                cells[id(a)] = Cell(f"__c{k}", f"__m{k}", 1, False, a.type)
            elif a.func == "sum":
                made(k, "c", "m", v, "sum", f"__v{k}")
                cells[id(a)] = Cell(f"__c{k}", f"__m{k}", 2, True, a.type)
            elif a.func == "count":
                made(k, "c", "m", some, "sum", f"__n{k}")
                cells[id(a)] = Cell(f"__c{k}", f"__m{k}", 2, True, a.type)
            else:
                made(k, "c", "m", v, "sum", f"__v{k}")
                made(k, "d", "e", some, "sum", f"__n{k}")
                cells[id(a)] = (Cell(f"__c{k}", f"__m{k}", 2, True, "DOUBLE"), Cell(f"__d{k}", f"__e{k}", 2, True, "DOUBLE"))
        df = world_table(per_unit, keys, specs, F.col("__u"))
        for counters, mask, func, column in clipped:
            part = clip_branch(per_unit.withColumn("__x", F.expr(column)), keys, "__x", func, self.config, counters, mask)
            df = self.beside(df, part, keys)
        return df

    def beside(self, df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        """Columns of another result of the same groups."""
        self.n_hash += 1
        tag = f"__r{self.n_hash}_"
        renamed = other.select(*[F.col(c).alias(tag + c) for c in keys], *[c for c in other.columns if c not in keys])
        if not keys:
            return df.crossJoin(renamed)  # one row each
        cond = F.lit(True)
        for c in keys:
            cond = cond & F.col(c).eqNullSafe(F.col(tag + c))
        return df.join(renamed, cond, "left").drop(*[tag + c for c in keys])

    def distinct_branch(self, rows: DataFrame, keys: list[str], arg: str, where: str | None, calls: list[Agg], cells: dict) -> DataFrame:
        """DISTINCT calls of one argument and filter: a value is in a world if any unit that has it is."""
        b = len(cells)
        taken = rows.withColumn("__x", F.expr(arg)).filter("__x IS NOT NULL AND __h IS NOT NULL")
        if where is not None:
            taken = taken.filter(where)
        values = taken.groupBy(*keys, "__x").agg(F.bit_or("__h").alias("__h"))
        x, specs = self.number(F.col("__x"), calls[0]), []
        if any(a.func in ("sum", "avg") for a in calls):
            specs.append((f"__ds{b}", f"__dm{b}", "sum", x))
        if any(a.func in ("count", "avg") for a in calls):
            specs.append((f"__dc{b}", f"__dn{b}", "sum", F.lit(1.0)))
        for a in calls:
            s, c = Cell(f"__ds{b}", f"__dm{b}", 2, True, a.type), Cell(f"__dc{b}", f"__dn{b}", 2, True, a.type)
            cells[id(a)] = (s, c) if a.func == "avg" else s if a.func == "sum" else c
        return world_table(values, keys, specs).drop("__updates")

    @staticmethod
    def number(v: Column, a: Agg) -> Column:
        kind = a.arg.type.upper() if a.arg is not None else "INT"
        if kind == "DATE":
            return F.unix_date(v).cast("double")
        if kind.startswith("TIMESTAMP"):
            return F.unix_micros(v.cast("timestamp")).cast("double")
        return v.cast("double")

    # releasing

    def per_world(self, x: Expr, cells: list) -> Column:
        """The expression evaluated on the counters of each world."""
        parts = {}
        for k, c in enumerate(cells):
            own = c if isinstance(c, tuple) else (c,)
            lists = [self.scaled(y) for y in own]
            parts[f"p{k}"] = worlds.pac_div(*lists) if len(lists) == 2 else lists[0]
        if x.text == "{A0}":
            return parts["p0"]
        self.n_hash += 1
        named = [(f"__w{self.n_hash}_{k}", c) for k, c in enumerate(parts.values())]
        self.extra += named  # a lambda's SQL text needs its lists as columns: they are projected first
        text = x.fill([f"element_at(`{name}`, CAST(__j AS INT) + 1)" for name, _ in named])
        return F.expr(f"transform(sequence(0, 63), __j -> CAST({text} AS DOUBLE))")

    def scaled(self, c: Cell) -> Column:
        factor = float(c.scale * (self.correction if c.scaled else 1.0))
        return F.transform(F.col(c.counters), lambda v: v * factor)

    def release(self, df: DataFrame, n: Node, outs: list) -> DataFrame:
        cfg = self.config
        track = cfg.pac_ptracking and cfg.pac_mi > 0 and not self.keep_counters and any(x.text == "{A0}" for x, _, _ in outs)
        if not track:  # tracking sees all groups itself
            df = self.guard(df, n)
        if self.keep_counters:
            return self.stored(df, n, outs)
        self.extra = []
        made: dict[str, Column] = {}
        tracked: list[tuple] = []
        for x, u, cells in outs:
            if not x.aggs:
                continue
            self.tag += 1
            tag = f"{self.tag}"
            if x.text == "{A0}":
                c = cells[0]
                if isinstance(c, tuple):
                    if track:
                        tracked += [(f"__t{u}s", c[0]), (f"__t{u}n", c[1])]
                        made[u] = noise.ratio(F.col(f"__t{u}s"), F.col(f"__t{u}n"))
                    else:
                        s, m = [self.one(y, f"{tag}:{i}") for i, y in enumerate(c)]
                        made[u] = noise.ratio(s, m)
                elif track:
                    tracked.append((f"__t{u}", c))
                    made[u] = self.typed(F.col(f"__t{u}"), c.type)
                else:
                    made[u] = self.typed(self.one(c, tag), c.type)
            elif x.type.upper().startswith(NUMERIC) and cfg.pac_categorical:
                made[u] = self.typed(noise.pac_noised(self.per_world(x, cells), cfg, tag, self.keys), x.type)
            else:
                singles = []
                for k, c in enumerate(cells):
                    name = f"__o{u}_{k}"
                    own = c if isinstance(c, tuple) else (c,)
                    parts = [self.one(y, f"{tag}:{k}:{i}") for i, y in enumerate(own)]
                    self.extra.append((name, noise.ratio(*parts) if len(parts) == 2 else self.typed(parts[0], c.type)))
                    singles.append(f"`{name}`")
                made[u] = F.expr(x.fill(singles))
        if tracked:
            watch = ("__updates", "__m0", "__c0") if {"__updates", "__c0"} <= set(df.columns) and not self.guarded else None
            df = noise.release_tracked(df, [(t, c.counters, c.mask, self.correction, c.scale, c.scaled) for t, c in tracked], [f"__g{k}" for k in range(len(n.groups))], cfg, watch)
        if self.extra:
            df = df.select("*", *[c.alias(name) for name, c in self.extra])
        df = df.select("*", *[c.alias(u) for u, c in made.items()])
        return df.select(*group_outputs(n))

    def one(self, c: Cell, tag: str) -> Column:
        return noise.release(F.col(c.counters), F.col(c.mask), self.config, self.correction, c.scale, tag, self.keys, c.scaled)

    @staticmethod
    def typed(x: Column, kind: str) -> Column:
        kind = kind.upper()
        if kind in ("BIGINT", "INT", "SMALLINT", "TINYINT"):
            return noise.whole(x).cast(kind.lower())
        if kind == "DATE":
            return F.date_from_unix_date(noise.whole(x).cast("int"))
        if kind.startswith("TIMESTAMP"):
            return F.timestamp_micros(noise.whole(x).cast("long")).cast(kind.lower())
        return x.cast(kind.lower())

    def guard(self, df: DataFrame, n: Node) -> DataFrame:
        """Fails, when the result is computed, if most groups look like single units."""
        if self.guarded or "__updates" not in df.columns or "__c0" not in df.columns:
            return df
        odd, sound = noise.diversity(F.col("__updates"), F.col("__m0"), F.col("__c0"))
        bad = (F.col("__tu") >= noise.FEWEST_UPDATES) & (F.col("__to") > 2 * F.col("__ts"))
        ok = F.when(bad, F.raise_error(F.lit(noise.NO_DIVERSITY)).cast("boolean")).otherwise(F.lit(True))
        if not n.groups:  # the one row has its own totals
            totals = df.select("*", F.col("__updates").alias("__tu"), odd.cast("long").alias("__to"), sound.cast("long").alias("__ts"))
            return totals.filter(ok).drop("__tu", "__to", "__ts")
        totals = df.agg(F.sum("__updates").alias("__tu"), F.sum(odd.cast("long")).alias("__to"), F.sum(sound.cast("long")).alias("__ts"))
        return df.crossJoin(F.broadcast(totals.select(ok.alias("__ok")))).filter("__ok").drop("__ok")  # one row

    def stored(self, df: DataFrame, n: Node, outs: list) -> DataFrame:
        """Raw counters instead of answers, for derived tables."""
        self.extra = []
        made = {u: self.per_world(x, cells) for x, u, cells in outs if x.aggs}
        if self.extra:
            df = df.select("*", *[c.alias(name) for name, c in self.extra])
        df = df.select("*", *[F.transform(c, lambda v: v.cast("float")).alias(u) for u, c in made.items()])
        return df.select(*group_outputs(n))

    # top k

    def top_k(self, n: Node) -> DataFrame | None:
        """ORDER BY an aggregate LIMIT k: the k groups are chosen by their mean over worlds, and only they are
        released; with an expansion factor more are, and sorted again by what was released."""
        offset = 0
        at = n.children[0]
        if at.kind == "offset":
            offset, at = at.n, at.children[0]
        if at.kind != "sort":
            return None
        sort, names, below = at, {}, at.children[0]
        while below.kind == "project" and all(e.attr for e, _ in below.exprs):
            renames = {u: e.attr for e, u in below.exprs}
            names = {k: renames.get(v, v) for k, v in names.items()} | {u: e for u, e in renames.items() if u not in names}
            below = below.children[0]
        if not self.is_target(below):
            return None
        outs_by = {u: x for x, u in below.exprs if x.aggs}
        target = lambda e: names.get(e.attr, e.attr)
        if not any(e.attr and target(e) in outs_by for e, _, _ in sort.orders) or not all(e.attr for e, _, _ in sort.orders):
            return None
        df, node, outs = self.counted(below)
        df = self.guard(df, node)
        self.extra, order = [], []
        for e, asc, first in sort.orders:
            found = next((o for o in outs if o[1] == target(e)), None)
            c = worlds.pac_mean(self.per_world(found[0], found[2])) if found and found[0].aggs else None
            if c is None:
                c = next(F.expr(x.text) if not x.aggs else None for x, u in [(x, u) for x, u, _ in outs] if u == target(e))
                for k, g in enumerate(node.groups):
                    if g.attr == target(e) or any(x.text == g.text and u == target(e) for x, u, _ in outs):
                        c = F.col(f"__g{k}")
            order.append((c, asc, first))
        if self.extra:
            df = df.select("*", *[c.alias(name) for name, c in self.extra])
        sorts = [(c.asc_nulls_first() if f else c.asc_nulls_last()) if a else (c.desc_nulls_first() if f else c.desc_nulls_last()) for c, a, f in order]
        wanted = math.ceil(self.config.pac_topk_expansion * (n.n + offset))
        chosen = df.orderBy(*sorts).limit(wanted)
        self.guarded = True  # over all groups, not the chosen ones
        out = self.release(chosen, node, outs)
        self.guarded = False
        projects, at = [], sort.children[0]
        while at is not below:
            projects.append(at)
            at = at.children[0]
        for p in reversed(projects):
            out = self.project(Emitted(out), p).df
        out = out.orderBy(*self.sort_columns(sort))
        if offset:
            out = out.offset(offset)
        return out.limit(n.n)
