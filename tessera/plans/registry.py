"""Where queries and their DuckDB texts are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _plain_counts(sql: str) -> str:
    """``count_if(x)`` as a count of BIGINT type, which DuckDB's own isn't."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _plain_counts(sql)
        return f

    return keep


#: Nets that hit the invented prose of the test documents.
DEMO_NETS = {"alpha": ("theor", "heon"), "beta": ("atth", "leoi"), "gamma": ("schun", "eaux."), "delta": ("ción de",)}


def sql_net(col: str, words) -> str:
    from tessera.functions import nets

    return f"regexp_matches(lower({col}), '{nets.pattern(words)}')"


def sql_first(col: str, table: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_net(col, w)} THEN '{n}'" for n, w in table.items()) + f" ELSE '{default}' END"


def _person_sql() -> str:
    from tessera.functions import entity

    return "lower(trim(regexp_extract({text}, '(?i)(?:^|[,;\\n])\\s*(?:" + "|".join(entity.KEYS) + ")\\s*[:=]\\s*([^,;\\n]+)', 1)))"


#: The value of a text's first person key, in lower case; a form with the place ``text``.
PERSON_SQL = _person_sql()
