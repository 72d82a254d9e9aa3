"""The privacy clauses of CREATE and ALTER TABLE: parsing, validation and their effect on the catalogue."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .catalog import Link, PrivacyCatalog, PrivacyError, plain

_NAMES = r"\(\s*([\w`\s,]+?)\s*\)"
_LINK = re.compile(rf"PRIVACY_LINK\s*{_NAMES}\s*REFERENCES\s+([\w.`]+)\s*{_NAMES}", re.I)
_KEY = re.compile(rf"PRIVACY_KEY\s*{_NAMES}", re.I)
_PROTECTED = re.compile(rf"\bPROTECTED\s*{_NAMES}", re.I)
_CREATE = re.compile(r"^CREATE\s+(OR\s+REPLACE\s+)?(PU\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`]+)\s*\(", re.I)
_ALTER = re.compile(r"^ALTER\s+(PU\s+)?TABLE\s+([\w.`]+)\s+(ADD|DROP|SET\s+PU|UNSET\s+PU)\b\s*(.*)$", re.I | re.S)
KEY_NEEDED = "CREATE PU TABLE requires a PRIVACY_KEY clause to identify the privacy unit"
LINK_SYNTAX = "Invalid PRIVACY_LINK syntax. Use PRIVACY_LINK (col) REFERENCES table(ref_col)."


@dataclass
class Statement:
    """What is left for the host to run, and what to declare."""

    action: str  # create, add, drop, set, unset
    table: str
    pu: bool = False
    sql: str | None = None
    keys: list[str] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    protected: list[str] = field(default_factory=list)
    if_not_exists: bool = False


#: Quoted text, which stays as it is; hints, which are no comments; comments; blanks.
_TOKEN = re.compile(r"""(?P<kept>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|/\*\+.*?\*/)|(?:/\*(?!\+).*?\*/|--[^\n]*|\s)+""", re.S)


def clean(sql: str) -> str:
    """Without comments, closing semicolon and runs of blanks, except inside quotes."""
    sql = _TOKEN.sub(lambda m: m["kept"] or " ", sql).strip()
    return re.sub(r"[;\s]+$", "", sql)


def _list(text: str) -> list[str]:
    return [c.strip().strip("`") for c in text.split(",") if c.strip()]


def _clauses(body: str) -> tuple[list[str], list[Link], list[str]]:
    keys = [c for m in _KEY.finditer(body) for c in _list(m[1])]
    links = [Link(tuple(_list(m[1])), plain(m[2]), tuple(_list(m[3]))) for m in _LINK.finditer(body)]
    protected = [c for m in _PROTECTED.finditer(body) for c in _list(m[1])]
    for link in links:
        if len(link.local) != len(link.remote):
            raise PrivacyError("PRIVACY_LINK needs as many referenced columns as local ones")
    return keys, links, protected


def _hint(sql: str) -> None:
    for word in ("KEY", "LINK"):
        if re.search(rf"\bPAC\s+{word}\b|\bPRIVACY\s+{word}\b", sql, re.I):
            raise PrivacyError(f"Did you mean PRIVACY_{word} (with underscore)?")


def _split_top(body: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for k, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(body[at:k])
            at = k + 1
    return [p.strip() for p in [*parts, body[at:]] if p.strip()]


def parse(sql: str) -> Statement | None:
    """A privacy statement, or None if the text is none."""
    sql = clean(sql)
    if m := _CREATE.match(sql):
        start, depth, end = m.end(), 1, len(sql)
        for k in range(start, len(sql)):
            depth += (sql[k] == "(") - (sql[k] == ")")
            if depth == 0:
                end = k
                break
        body, rest = sql[start:end], sql[end + 1 :]
        words = re.search(r"\bPRIVACY_KEY\b|\bPRIVACY_LINK\b|\bPROTECTED\b", body, re.I)
        if not m[2] and not words:
            if re.search(r"\bPAC\s+(KEY|LINK)\b|\bPRIVACY\s+(KEY|LINK)\b", body, re.I):
                _hint(body)
            return None
        columns = []
        for part in _split_top(body):
            if _LINK.fullmatch(part) or _KEY.fullmatch(part) or _PROTECTED.fullmatch(part):
                continue
            if re.match(r"PRIVACY_LINK\b", part, re.I):
                raise PrivacyError(LINK_SYNTAX)
            if re.match(r"PRIVACY_KEY\b", part, re.I):
                raise PrivacyError(KEY_NEEDED)
            if re.search(r"\bPROTECTED\b", part, re.I):
                raise PrivacyError("Invalid PROTECTED syntax. Use PROTECTED (col1, col2).")
            columns.append(part)
        keys, links, protected = _clauses(body)
        if m[2] and not keys:
            _hint(body)
            raise PrivacyError(KEY_NEEDED)
        head = f"CREATE {m[1] or ''}TABLE {m[3] or ''}{m[4]}"
        return Statement("create", plain(m[4]), bool(m[2]), f"{head} ({', '.join(columns)}){rest}", keys, links, protected, bool(m[3]))
    if m := _ALTER.match(sql):
        action, body = m[3].upper(), m[4]
        if action.endswith("PU"):
            return Statement("set" if action.startswith("SET") else "unset", plain(m[2]))
        if not re.search(r"\bPRIVACY_KEY\b|\bPRIVACY_LINK\b|\bPROTECTED\b", body, re.I):
            if re.search(r"\bPAC\s+(KEY|LINK)\b|\bPRIVACY\s+(KEY|LINK)\b", body, re.I):
                _hint(body)
            return None
        if action == "ADD":
            keys, links, protected = _clauses(body)
            if re.search(r"\bPRIVACY_LINK\b", body, re.I) and not links:
                raise PrivacyError(LINK_SYNTAX)
            if re.search(r"\bPROTECTED\b", body, re.I) and not protected:
                raise PrivacyError("Invalid PROTECTED syntax. Use PROTECTED (col1, col2).")
            return Statement("add", plain(m[2]), bool(m[1]), None, keys, links, protected)
        links = [Link(tuple(_list(x[1])), "", ()) for x in re.finditer(rf"PRIVACY_LINK\s*{_NAMES}", body, re.I)]
        return Statement("drop", plain(m[2]), bool(m[1]), None, [], links, [c for x in _PROTECTED.finditer(body) for c in _list(x[1])])
    return None


def _missing(columns: list[str], have: list[str] | None, where: str, tail: str = "") -> None:
    known = {c.lower() for c in have or []}
    gone = [c for c in columns if c.lower() not in known]
    if len(gone) == 1:
        raise PrivacyError(f"Column '{gone[0]}' does not exist in {where}" + tail)
    if gone:
        raise PrivacyError(f"Columns {', '.join(repr(c) for c in gone)} do not exist in {where}" + tail)


def apply(catalog: PrivacyCatalog, s: Statement, columns_of: Callable[[str], list[str] | None]) -> None:
    """Validates a statement whole and then declares it. columns_of gives a table's columns, or None."""
    have = columns_of(s.table)
    if have is None:
        raise PrivacyError(f"Table '{s.table}' does not exist")
    meta = catalog.get(s.table)
    is_pu = bool(meta and meta.is_pu)
    if s.action in ("set", "unset"):
        if s.action == "set":
            if not meta or not meta.keys:
                raise PrivacyError("ALTER TABLE SET PU requires a PRIVACY_KEY. Add one with ALTER TABLE ... ADD PRIVACY_KEY first.")
            _no_unit_links(catalog, s.table, meta.links)
        catalog.ensure(s.table).is_pu = s.action == "set"
        return
    if s.action == "drop":
        _drop(catalog, s, is_pu)
        return
    if s.action == "add" and (s.links or s.protected):
        if s.pu and not is_pu:
            raise PrivacyError(f"Table '{s.table}' is not a privacy unit. Use ALTER TABLE (without PU) for non-PU tables.")
        if is_pu and not s.pu:
            raise PrivacyError(f"Table '{s.table}' is a privacy unit. Use ALTER PU TABLE for PU tables.")
    seen = set()
    for c in s.protected:
        if c.lower() in seen:
            raise PrivacyError(f"Duplicate protected column '{c}' in ALTER PU TABLE statement")
        seen.add(c.lower())
    where = f"table '{s.table}'"
    _missing(s.keys, have, where)
    _missing(s.protected, have, where, ". No protected columns were added." if len(s.protected) > 1 and sum(c.lower() not in {h.lower() for h in have} for c in s.protected) > 1 else "")
    for link in s.links:
        _missing(list(link.local), have, where)
        if s.action == "add":
            remote = columns_of(link.table)
            if remote is None:
                raise PrivacyError(f"Referenced table '{link.table}' does not exist")
            _missing(list(link.remote), remote, f"referenced table '{link.table}'")
    becomes_pu = is_pu or s.pu and s.action == "create"
    if becomes_pu:
        _no_unit_links(catalog, s.table, s.links)
    if meta:
        for c in s.protected:
            if c.lower() in {p.lower() for p in meta.protected}:
                raise PrivacyError(f"Column '{c}' is already marked as protected")
        for link in s.links:
            for old in meta.links:
                if [c.lower() for c in old.local] == [c.lower() for c in link.local] and old != link:
                    raise PrivacyError(f"Column(s) already have a PRIVACY_LINK defined: {', '.join(link.local)}")
    meta = catalog.ensure(s.table)
    meta.is_pu = becomes_pu
    meta.keys += [k for k in s.keys if k.lower() not in {x.lower() for x in meta.keys}]
    meta.links += [x for x in s.links if x not in meta.links]
    meta.protected += s.protected


def _no_unit_links(catalog: PrivacyCatalog, table: str, links: list[Link]) -> None:
    for link in links:
        if catalog.is_pu(link.table):
            raise PrivacyError(f"Cannot create PAC LINK from PAC table '{table}' to PAC table '{link.table}'. PAC tables cannot link to other PAC tables (cycles not supported).")


def _drop(catalog: PrivacyCatalog, s: Statement, is_pu: bool) -> None:
    meta = catalog.get(s.table)
    if meta is None:
        raise PrivacyError(f"Table '{s.table}' does not have any PAC metadata to drop")
    if s.pu and not is_pu:
        raise PrivacyError(f"Table '{s.table}' is not a privacy unit. Use ALTER TABLE (without PU) for non-PU tables.")
    if is_pu and not s.pu:
        raise PrivacyError(f"Table '{s.table}' is a privacy unit. Use ALTER PU TABLE for PU tables.")
    links, protected = list(meta.links), list(meta.protected)
    for want in s.links:
        found = [x for x in links if [c.lower() for c in x.local] == [c.lower() for c in want.local]]
        if not found:
            if len(want.local) == 1:
                raise PrivacyError(f"No PAC LINK found on column '{want.local[0].lower()}'")
            raise PrivacyError(f"No PAC LINK found on columns ({', '.join(repr(c.lower()) for c in want.local)})")
        links.remove(found[0])
    for c in s.protected:
        found = [p for p in protected if p.lower() == c.lower()]
        if not found:
            raise PrivacyError(f"Column '{c}' is not marked as protected")
        protected.remove(found[0])
    meta.links, meta.protected = links, protected
