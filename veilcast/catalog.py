"""What is declared about tables: privacy units, their keys, links to them and protected columns."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import asdict, dataclass, field


class PrivacyError(Exception):
    """A statement or query that the policy rejects."""


@dataclass(frozen=True)
class Link:
    local: tuple[str, ...]
    table: str
    remote: tuple[str, ...]


@dataclass
class TableMeta:
    name: str
    is_pu: bool = False
    keys: list[str] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    protected: list[str] = field(default_factory=list)
    derived: bool = False
    counter_columns: list[str] = field(default_factory=list)


def plain(name: str) -> str:
    """Tables are matched without qualifier or case."""
    return name.replace("`", "").split(".")[-1].lower()


class PrivacyCatalog:
    def __init__(self):
        self.tables: dict[str, TableMeta] = {}

    def get(self, name: str) -> TableMeta | None:
        return self.tables.get(plain(name))

    def ensure(self, name: str) -> TableMeta:
        return self.tables.setdefault(plain(name), TableMeta(plain(name)))

    def is_pu(self, name: str) -> bool:
        meta = self.get(name)
        return bool(meta and meta.is_pu)

    def drop(self, name: str) -> None:
        """Forgets a table and all links that point at it."""
        self.tables.pop(plain(name), None)
        for meta in self.tables.values():
            meta.links = [x for x in meta.links if plain(x.table) != plain(name)]

    def keys_of(self, pu: str) -> list[str]:
        """The declared key, or the columns that the first link to the table names."""
        meta = self.get(pu)
        if meta and meta.keys:
            return meta.keys
        for other in self.tables.values():
            for link in other.links:
                if plain(link.table) == plain(pu):
                    return list(link.remote)
        return []

    def path_to(self, start: str, pu: str) -> list[Link] | None:
        """The shortest chain of links from a table to a privacy unit; [] for the unit itself."""
        if plain(start) == plain(pu):
            return []
        seen, queue = {plain(start)}, deque([(plain(start), [])])
        while queue:
            at, path = queue.popleft()
            for link in self.tables.get(at, TableMeta(at)).links:
                to = plain(link.table)
                if to == plain(pu):
                    return [*path, link]
                if to not in seen:
                    seen.add(to)
                    queue.append((to, [*path, link]))
        return None

    def units_of(self, table: str) -> dict[str, list[Link]]:
        """Every privacy unit that a table is or links to, with the path."""
        found = {}
        for name, meta in self.tables.items():
            if meta.is_pu and (path := self.path_to(table, name)) is not None:
                found[name] = path
        return found

    def protected_of(self, table: str) -> set[str]:
        """Protected columns: declared ones, keys of units, and both ends of links on a way to a unit."""
        meta = self.get(table)
        out = {c.lower() for c in meta.protected} if meta else set()
        if meta and meta.is_pu:
            out |= {c.lower() for c in self.keys_of(table)}
        if meta:
            for link in meta.links:
                if self.units_of(link.table):
                    out |= {c.lower() for c in link.local}
        for other in self.tables.values():
            for link in other.links:
                if plain(link.table) == plain(table) and self.units_of(table):
                    out |= {c.lower() for c in link.remote}
        return out

    def cyclic(self, start: str) -> bool:
        """Whether following links from a table can come back to one on the way."""

        def walk(at: str, trail: frozenset) -> bool:
            if at in trail:
                return True
            return any(walk(plain(x.table), trail | {at}) for x in self.tables.get(at, TableMeta(at)).links)

        return walk(plain(start), frozenset())

    def to_json(self) -> str:
        return json.dumps({"tables": [asdict(t) for t in self.tables.values()]}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> PrivacyCatalog:
        out = cls()
        for t in json.loads(text)["tables"]:
            t["links"] = [Link(tuple(x["local"]), x["table"], tuple(x["remote"])) for x in t["links"]]
            out.tables[t["name"]] = TableMeta(**t)
        return out

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> PrivacyCatalog:
        with open(path) as f:
            return cls.from_json(f.read())
