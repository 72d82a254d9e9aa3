import pytest

from veilcast import ddl
from veilcast.catalog import Link, PrivacyCatalog, PrivacyError

TABLES = {"t": ["id", "name", "value"], "r": ["id"], "ref": ["ref1", "ref2"], "comp": ["id1", "id2", "v"], "u": ["id", "x"]}


def run(catalog, *lines):
    for line in lines:
        ddl.apply(catalog, ddl.parse(line), TABLES.get)


def refused(part, catalog, *lines):
    with pytest.raises(PrivacyError, match=part.replace("(", r"\(").replace(")", r"\)")):
        run(catalog, *lines)


def test_create_is_stripped():
    s = ddl.parse("CREATE PU TABLE x (id INTEGER, /* key */ v INT, PRIVACY_KEY(id), PROTECTED(v), PRIVACY_LINK(v) REFERENCES r(id)); -- end")
    assert s.sql == "CREATE TABLE x (id INTEGER, v INT)" and s.pu and s.keys == ["id"] and s.protected == ["v"] and s.links == [Link(("v",), "r", ("id",))]


def test_plain_statements_are_left_alone():
    assert ddl.parse("CREATE TABLE x (id INT)") is None and ddl.parse("ALTER TABLE x ADD COLUMN (y INT)") is None and ddl.parse("SELECT 1") is None


@pytest.mark.parametrize(
    "sql,part",
    [
        ("CREATE PU TABLE a (id INTEGER, name VARCHAR)", "requires a PRIVACY_KEY clause"),
        ("CREATE PU TABLE a (id INTEGER, PRIVACY_KEY)", "requires a PRIVACY_KEY clause"),
        ("CREATE PU TABLE a (id INTEGER, PRIVACY_KEY())", "requires a PRIVACY_KEY clause"),
        ("CREATE PU TABLE a (id INTEGER, PAC KEY (id))", "Did you mean PRIVACY_KEY"),
        ("CREATE PU TABLE a (id INTEGER PROTECTED, PRIVACY_KEY(id))", "Invalid PROTECTED syntax"),
        ("ALTER TABLE t ADD PRIVACY_LINK (id) REFERENCES", "Invalid PRIVACY_LINK syntax"),
    ],
)
def test_syntax_errors(sql, part):
    with pytest.raises(PrivacyError, match=part):
        ddl.parse(sql)


def test_validation_errors():
    c = PrivacyCatalog()
    refused("Table 'gone' does not exist", c, "ALTER TABLE gone ADD PRIVACY_KEY (id)")
    refused("Column 'zz' does not exist in table 't'", c, "ALTER TABLE t ADD PROTECTED (name, zz)")
    refused("Columns 'a', 'b' do not exist in table 't'. No protected columns were added.", c, "ALTER TABLE t ADD PROTECTED (a, b)")
    refused("Referenced table 'gone' does not exist", c, "ALTER TABLE t ADD PRIVACY_LINK (id) REFERENCES gone(id)")
    refused("Column 'zz' does not exist in referenced table 'r'", c, "ALTER TABLE t ADD PRIVACY_LINK (id) REFERENCES r(zz)")
    refused("Duplicate protected column 'name'", c, "ALTER TABLE t ADD PROTECTED (name, name)")
    refused("does not have any PAC metadata to drop", c, "ALTER TABLE t DROP PROTECTED (name)")
    refused("SET PU requires a PRIVACY_KEY", c, "ALTER TABLE t SET PU")
    assert not c.get("t")


def test_add_and_drop():
    c = PrivacyCatalog()
    run(c, "ALTER TABLE t ADD PRIVACY_KEY (id)", "ALTER TABLE t ADD PROTECTED (name)", "ALTER TABLE t ADD PRIVACY_LINK (value) REFERENCES r(id)", "ALTER TABLE t ADD PRIVACY_LINK (value) REFERENCES r(id)")
    assert len(c.get("t").links) == 1
    refused("already marked as protected", c, "ALTER TABLE t ADD PROTECTED (NAME)")
    refused("already have a PRIVACY_LINK defined", c, "ALTER TABLE t ADD PRIVACY_LINK (value) REFERENCES u(id)")
    refused("is not marked as protected", c, "ALTER TABLE t DROP PROTECTED (value)")
    refused("No PAC LINK found on column 'id'", c, "ALTER TABLE t DROP PRIVACY_LINK (id)")
    run(c, "ALTER TABLE t DROP PRIVACY_LINK (value)", "ALTER TABLE t DROP PROTECTED (name)")
    assert not c.get("t").links and not c.get("t").protected


def test_units_and_links():
    c = PrivacyCatalog()
    run(c, "ALTER TABLE r ADD PRIVACY_KEY (id)", "ALTER TABLE r SET PU", "ALTER TABLE t ADD PRIVACY_KEY (id)")
    refused("is not a privacy unit. Use ALTER TABLE (without PU)", c, "ALTER PU TABLE t ADD PROTECTED (name)")
    refused("is a privacy unit. Use ALTER PU TABLE", c, "ALTER TABLE r ADD PROTECTED (id)")
    run(c, "ALTER TABLE t ADD PRIVACY_LINK (value) REFERENCES r(id)", "ALTER TABLE u ADD PRIVACY_LINK (x) REFERENCES t(id)")
    refused("PAC tables cannot link to other PAC tables", c, "ALTER TABLE t SET PU")
    assert [x.table for x in c.path_to("u", "r")] == ["t", "r"] and c.protected_of("t") == {"value", "id"}
    again = PrivacyCatalog.from_json(c.to_json())
    assert again.tables == c.tables
    c.drop("t")
    assert c.path_to("u", "r") is None and not c.cyclic("u")
