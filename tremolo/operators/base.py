"""Operators written as declarative SQL over DataFrames.

An operator is a query with named inputs (``{spikes}``) and parameters (``$bin``). Called with
DataFrames it gives a lazy DataFrame that Catalyst plans as a whole; ``oracle`` gives the same
query as DuckDB text over named tables, for checks. Few functions differ between the two; they
are written as macros.
"""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import DataFrame

# macro -> (Spark, DuckDB); $1, $2 are its arguments
_MACROS = {
    "SERIES": ("explode(sequence($1, $2))", "unnest(generate_series($1, $2))"),
    "MICROS": ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST($1 AS TIMESTAMP_NTZ))", "(epoch_us($1) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))"),
    "YMD": ("to_date($1, 'yyMMdd')", "CAST(strptime($1, '%y%m%d') AS DATE)"),
    "DAYS": ("datediff($1, $2)", "date_diff('day', $2, $1)"),
    "MONTHNO": ("CAST(year($1) * 12 + month($1) AS INT)", "CAST(year($1) * 12 + month($1) AS INT)"),
    "SPLITTED": ("explode(split($1, $2))", "unnest(string_split($1, $2))"),
    "POSLIST": ("posexplode($1) AS ($2, $3)", "unnest(range(len($1))) AS $2, unnest($1) AS $3"),
    "AT": ("element_at($1, $2)", "$1[$2]"),
    "JSONINT": ("CAST(get_json_object($1, $2) AS BIGINT)", "CAST(json_extract($1, $2) AS BIGINT)"),
    "IDIV": ("(($1) DIV ($2))", "(($1) // ($2))"),
    "LIST": ("sort_array(collect_list($1))", "list_sort(list($1))"),
    "CBRT": ("cbrt($1)", "cbrt($1)"),
}
_CALL = re.compile(r"@([A-Z]+)\(")


def expand(sql: str, which: int) -> str:
    """Query text with its macros filled in: 0 for Spark, 1 for DuckDB."""
    while m := _CALL.search(sql):
        depth, at, start, args, quoted = 1, m.end(), m.end(), [], False
        while depth:
            c = sql[at]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            if (c == "," and depth == 1 and not quoted) or not depth:
                args.append(sql[start:at].strip())
                start = at + 1
            at += 1
        body = _MACROS[m[1]][which]
        for k in range(len(args), 0, -1):
            body = body.replace(f"${k}", args[k - 1])
        sql = sql[: m.start()] + body + sql[at:]
    return sql


class SqlOperator:
    """A named query. ``doc`` says what it computes, ``defaults`` are its parameters."""

    def __init__(self, doc: str, sql: str, **defaults):  # noqa: ANN003
        self.__doc__ = doc
        self.sql, self.defaults = sql, defaults

    def _fill(self, params: dict, which: int) -> str:
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise TypeError(f"unknown parameters: {sorted(unknown)}")
        return expand(Template(self.sql).substitute(self.defaults | params), which)

    def __call__(self, **kwargs) -> DataFrame:  # noqa: ANN003
        tables = {k: v for k, v in kwargs.items() if isinstance(v, DataFrame)}
        text = self._fill({k: v for k, v in kwargs.items() if k not in tables}, 0)
        return next(iter(tables.values())).sparkSession.sql(text, **tables)

    def oracle(self, **kwargs) -> str:  # noqa: ANN003
        """DuckDB text; inputs are given as SQL (``spikes="SELECT ..."``)."""
        names = set(re.findall(r"\{(\w+)\}", self.sql))
        text = self._fill({k: v for k, v in kwargs.items() if k not in names}, 1)
        for name in names:
            text = text.replace("{" + name + "}", "(" + expand(kwargs[name], 1) + ")")
        return text
