"""The function names in SQL text: calls are expanded to built-in expressions before the query is parsed.

Spark has no way to declare an aggregate in SQL, so `pac_sum(h, v)` and its kin become the expressions that
the Column functions of this package make. Arguments are repeated, so they should be plain columns.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import PrivacyError
from ..config import PrivacyConfig
from .hashing import _repair_series

_CMP = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "<>"}
AGGREGATES = ("pac_count", "pac_sum", "pac_min", "pac_max", "pac_avg", "pac_noised_count", "pac_noised_sum", "pac_noised_min", "pac_noised_max", "pac_noised_avg", "pac_clip_count", "pac_noised_clip_count")
#: Aggregates that need each unit's own sum or extreme first; operators/clip.py computes them for whole group-bys.
CLIPPED = {"pac_clip_sum": "sum", "pac_clip_min": "min", "pac_clip_max": "max", "pac_noised_clip_sum": "sum", "pac_noised_clip_sumcount": "sum", "pac_noised_clip_min": "min", "pac_noised_clip_max": "max"}
LISTS = ("pac_count", "pac_sum", "pac_min", "pac_max", "pac_avg", "pac_clip_count", "pac_clip_sum", "pac_clip_min", "pac_clip_max", "pac_div", "pac_coalesce")
REPAIR = "veilcast_repair"
_ONE = "CAST(1 AS BIGINT)"


def _bit(h: str, j) -> str:
    return f"(shiftrightunsigned({h}, {j}) & {_ONE}) = {_ONE}"


class Expander:
    """`lists` says, for each count of one argument in the order of expansion, whether it counts lists."""

    def __init__(self, config: PrivacyConfig, lists: tuple[bool, ...] = ()):
        self.config, self.n, self.lists, self.counts = config, 0, lists, 0

    # noise

    def _uniform(self, tag: str, *keys: str) -> str:
        return f"((shiftrightunsigned(xxhash64(CAST({self.config.query_hash_signed} AS BIGINT), '{tag}'{''.join(', ' + k for k in keys)}), 11) + 0.5D) / 9007199254740992D)"

    def release(self, counters: str, mask: str, correction: str, scale: float, scaled: bool, nulling: bool = True) -> str:
        cfg = self.config
        self.n += 1
        tag, factor = f"sql{self.n}", f"double({correction})" if scaled else "1D"
        vals = f"transform({counters}, (c, j) -> if({_bit(mask, 'j')}, coalesce(double(c), 0D) * {factor}, 0D))"
        if cfg.pac_mi <= 0:
            out = f"(get({vals}, 0) * {scale}D)"
            absent = f"bit_count({mask}) * double({correction}) < 1"
        else:
            total = f"aggregate({vals}, 0D, (s, x) -> s + x)"
            var = f"(aggregate({vals}, 0D, (s, x) -> s + (x - {total} / 64) * (x - {total} / 64)) / {63 * 2 * cfg.pac_mi!r}D)"
            draw = f"sqrt(-2 * ln({self._uniform(tag + 'r', 'to_json(' + counters + ')')})) * cos({2 * math.pi!r}D * {self._uniform(tag + 'a', 'to_json(' + counters + ')')})"
            out = f"((get({vals}, {cfg.secret_world}) + if({var} > 0, sqrt({var}) * {draw}, 0D)) * {scale}D)"
            tau = cfg.privacy_min_group_count
            if tau is not None and not math.isnan(tau) and nulling:  # withheld as drowned in its noise
                z = f"abs({out}) / sqrt({var} * {scale * scale}D)"
                keep = f"1 / (1 + exp(greatest(-30D, least(30D, -3 * ({z} - {float(tau)!r}D)))))"
                out = f"if({var} > 0 AND {self._uniform(tag + 'k', 'to_json(' + counters + ')')} >= {keep}, NULL, {out})"
            absent = f"(64 - bit_count({mask})) > floor({self._uniform(tag + 'n', 'to_json(' + counters + ')')} * greatest(1, floor(64 * double({correction}))))"
        return f"if({absent}, NULL, {out})" if nulling else out

    # aggregates

    def _worlds(self, h: str, v: str, f: str) -> str:
        return "array(" + ", ".join(f"coalesce({f}(CASE WHEN {_bit(h, j)} THEN double({v}) END), 0D)" for j in range(64)) + ")"

    def _seen(self, h: str, v: str | None) -> str:
        return f"coalesce(bit_or({h if v is None else f'if({v} IS NOT NULL, {h}, NULL)'}), {'CAST(0 AS BIGINT)'})"

    def _aggregate(self, name: str, args: list[str]) -> str:
        noised = name.startswith("pac_noised_")
        func = name.rsplit("_", 1)[1]
        counted = False
        if len(args) == 1 and func == "count" and not noised:
            counted = self.counts < len(self.lists) and self.lists[self.counts]
            self.counts += 1
        if len(args) == 1 and (func != "count" or counted) or not args:
            if counted:  # elements that are there, in each world
                each = [f"count(get({args[0]}, {j}))" for j in range(64)]
                return f"if(count({args[0]}) > 0, array({', '.join(f'if({x} > 0, double({x}), NULL)' for x in each)}), NULL)"
            if len(args) == 1:  # a list of counters
                pick = {"sum": "sum", "min": "min", "max": "max"}.get(func)
                if pick and not noised:
                    return f"if(count({args[0]}) > 0, array({', '.join(f'{pick}(double(get({args[0]}, {j})))' for j in range(64))}), NULL)"
            raise PrivacyError(f"{name} needs a hash and a value")
        h = args[0]
        number = lambda a: re.fullmatch(r"[\d.]+", a.strip()) is not None
        rest = args[1:]
        correction = rest.pop() if rest and number(rest[-1]) and (len(rest) == 2 or func == "count" and noised) else "1"
        v = rest[0] if rest else None
        if func == "avg":
            s, c = self._aggregate(name[:-3] + "sum", [h, v]), self._aggregate(name[:-3] + "count", [h, v])
            return f"({s} / double({c}))" if noised else self.scalar("pac_div", [s, c])
        value = "1" if func == "count" and v is None else f"if({v} IS NOT NULL, 1, NULL)" if func == "count" else v
        counters, mask = self._worlds(h, value, {"count": "sum", "sum": "sum"}.get(func, func)), self._seen(h, v)
        summed = func in ("sum", "count")
        if not noised:
            scale = f"{2 if summed else 1} * double({correction})" if summed else "1D"
            return f"transform({counters}, (c, j) -> if({_bit(mask, 'j')}, c * {scale}, 0D))"
        out = self.release(counters, mask, correction, 2.0 if summed else 1.0, summed)
        return f"CAST({out} AS BIGINT)" if func == "count" else out

    # scalars

    def _pack(self, bits: str) -> str:
        return f"aggregate(transform({bits}, (b, j) -> if(b, shiftleft({_ONE}, j), CAST(0 AS BIGINT))), CAST(0 AS BIGINT), (m, x) -> m | x)"

    def scalar(self, name: str, a: list[str]) -> str:
        cfg = self.config
        if name == "pac_hash":
            mixed = f"({a[0]} ^ CAST({cfg.query_hash_signed} AS BIGINT))"
            return f"{REPAIR}({mixed})" if cfg.pac_hash_repair else mixed
        if name == "pac_select":
            return f"({a[0]} & {self._pack(a[1])})"
        if (m := re.fullmatch(r"pac_select_(\w+)", name)) and m[1] in _CMP:
            return f"if({a[1]} IS NULL OR {a[2]} IS NULL, NULL, {a[0]} & {self._pack(f'transform({a[2]}, c -> float({a[1]}) {_CMP[m[1]]} float(c))')})"
        if name == "pac_filter":
            pop = f"bit_count({self._pack(a[0])})"
            correction = a[1] if len(a) > 1 else "1"
            self.n += 1
            passes = f"{pop} * double({correction}) >= 32" if cfg.pac_mi <= 0 else f"{pop} > floor({self._uniform(f'f{self.n}', f'to_json({a[0]})')} * floor(64 / double({correction})))"
            return f"coalesce(size({a[0]}) > 0 AND {passes}, FALSE)"
        if (m := re.fullmatch(r"pac_filter_(\w+)", name)) and m[1] in _CMP:
            return self.scalar("pac_filter", [f"transform({a[1]}, c -> float({a[0]}) {_CMP[m[1]]} float(c))", *a[2:]])
        if name == "pac_coalesce":
            return f"coalesce({a[0]}, array_repeat(CAST(NULL AS DOUBLE), 64))"
        if name == "pac_div":
            return f"zip_with({a[0]}, {a[1]}, (x, y) -> if(y = 0, if(x IS NULL, NULL, if(x = 0, double('NaN'), if(x > 0, double('Infinity'), double('-Infinity')))), double(x) / double(y)))"
        if name == "pac_noised_div":
            return self.scalar("pac_noised", [self.scalar("pac_div", a)])
        if name in ("pac_noised", "pac_finalize"):
            return f"if(size({a[0]}) = 64, {self.release(a[0], 'CAST(-1 AS BIGINT)', '1', 1.0, False, name == 'pac_noised')}, NULL)"
        if name == "pac_mean":
            kept = f"filter({a[0]}, x -> x IS NOT NULL)"
            return f"if(size({kept}) > 0, aggregate({kept}, 0D, (s, x) -> s + double(x)) / size({kept}), NULL)"
        if name == "dp_laplace_noise":
            u = f"({self._uniform('laplace', f'double({a[0]})', f'double({a[1]})')} - 0.5D)"
            return f"if({a[1]} > 0, double({a[0]}) - double({a[1]}) * signum({u}) * log1p(-2 * abs({u})), double({a[0]}))"
        raise PrivacyError(f"unknown function {name}")

    def clipped(self, name: str, args: list[str]) -> str:
        """A stand-in that keeps the arguments of a clipped aggregate in the plan, with a field of its type."""
        if len(args) not in (2, 3):
            raise PrivacyError(f"{name} needs a hash, a value and perhaps a correction")
        kind = "ARRAY<DOUBLE>" if name in LISTS else "BIGINT" if name.endswith("sumcount") else "DOUBLE"
        return f"any_value(named_struct('f', '{name}', 'h', {args[0]}, 'v', double({args[1]}), 'c', double({args[2] if len(args) > 2 else 1}), 'r', CAST(NULL AS {kind}))).r"

    def call(self, name: str, args: list[str]) -> str:
        if name in CLIPPED and len(args) > 1:
            return self.clipped(name, args)
        if name in CLIPPED:  # of a list: as without clipping
            name = name.replace("_clip", "")
        return self._aggregate(name.replace("_clip_count", "_count"), args) if name in AGGREGATES else self.scalar(name, args)


_NAME = re.compile(r"\b(pac_\w+|dp_laplace_noise)\s*\(", re.I)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"[^\"]*\"|`[^`]*`")


def _calls(text: str) -> list[re.Match]:
    """Calls outside of quotes."""
    hidden = _QUOTED.sub(lambda m: "'" * len(m[0]), text)
    return list(_NAME.finditer(hidden))


def calls(text: str) -> list[str]:
    return [m[1].lower() for m in _calls(text)]


def aggregates(text: str) -> bool:
    """Whether a text calls the library's aggregates."""
    return any(c in AGGREGATES or c in CLIPPED for c in calls(text))


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose parenthesis opens before `at`, and where it ends."""
    hidden = _QUOTED.sub(lambda m: "'" * len(m[0]), text)
    depth, start, args = 1, at, []
    while depth:
        if at >= len(text):
            raise PrivacyError("a call's parenthesis is not closed")
        c = hidden[at]
        depth += (c == "(") - (c == ")")
        if depth == 1 and c == "," or depth == 0:
            args.append(text[start:at].strip())
            start = at + 1
        at += 1
    return [a for a in args if a], at


def expand(text: str, config: PrivacyConfig, lists: tuple[bool, ...] = ()) -> str:
    """The text with all calls of the library's functions, innermost first, as built-in expressions."""
    expander: Expander = Expander(config, lists)
    build: Callable[[str, list[str]], str] = expander.call
    while found := _calls(text):
        m = found[-1]  # the last call has no call of the library behind it, so none inside
        args, end = _arguments(text, m.end())
        text = text[: m.start()] + build(text[m.start() : m.end()].split("(")[0].strip().lower(), args) + text[end:]
    return text


def outline(text: str, config: PrivacyConfig, lists: tuple[bool, ...] = ()) -> str:
    """The text with each outermost call that holds a counter aggregate replaced by a stand-in of its type, which is
    always null and refers to what the aggregates hash: for the policy check."""
    done = 0
    while found := [m for m in _calls(text) if m.start() >= done]:
        m = found[0]
        args, end = _arguments(text, m.end())
        inner, name = text[m.start() : end], m[1].lower()
        own = [x for x in _calls(inner) if x[1].lower() in AGGREGATES or x[1].lower() in CLIPPED]
        if not own:
            done = m.end()
            continue
        hashes = [a[0] for x in own if (a := _arguments(inner, x.end())[0]) and not aggregates(a[0])]
        kind = "ARRAY<DOUBLE>" if name in LISTS else "DOUBLE"
        test = " OR ".join(f"({expand(h, config, lists)}) IS NULL" for h in hashes)
        stand = f"any_value(IF({test}, CAST(NULL AS {kind}), CAST(NULL AS {kind})))"
        text = text[: m.start()] + stand + text[end:]
        done = m.start() + len(stand)
    return expand(text, config, lists)


def readings(text: str) -> list[tuple[bool, ...]]:
    """The ways to take counts of one argument: each of a hash, or of lists."""
    single = sum(c in ("pac_count", "pac_clip_count") for c in calls(text))
    return list(itertools.product((False, True), repeat=min(single, 6)))


def analysed(spark: SparkSession, text: str, config: PrivacyConfig, among: list[tuple[bool, ...]] | None = None) -> tuple[DataFrame, tuple[bool, ...]]:
    """The expanded query, in the first reading that the analyser accepts."""
    if config.pac_hash_repair:
        spark.udf.register(REPAIR, F.pandas_udf(_repair_series, "long"))
    failed = None
    for lists in among or readings(text):
        try:
            return spark.sql(expand(text, config, lists)), lists
        except AnalysisException as e:
            failed = failed or e
    raise failed
