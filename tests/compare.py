"""Every registered query against its SQL in DuckDB.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int",
    "integer": "int", "float": "real", "double": "real", "string": "text",
    "varchar": "text", "boolean": "bool", "date": "date",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    """Comparable across engines; negative zero and zero are one value."""
    if isinstance(value, float):
        return value + 0.0
    return str(value) if hasattr(value, "isoformat") else value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> list[str]:
    """What differs between the two engines; empty if nothing does."""
    df = entry_points.queries()[name](spark, folder)
    ours = {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields}
    result = con.execute(entry_points.oracle_sql()[name])
    theirs = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1])) for d in result.description}
    if ours != theirs:
        odd = {c for c in ours.keys() | theirs.keys() if ours.get(c) != theirs.get(c)}
        return [f"{c}: {ours.get(c)} here, {theirs.get(c)} in SQL" for c in sorted(odd)]
    left = _rows(list(df.columns), df.collect())
    right = _rows([d[0] for d in result.description], result.fetchall())
    if len(left) != len(right):
        return [f"{len(left)} rows here, {len(right)} in SQL"]
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if not unequal:
        return []
    return [f"{len(unequal)} of {len(left)} rows differ", *map(str, unequal[0])]


def main(folder: str, names: list[str]) -> int:
    from conftest import local_session

    spark = local_session()
    con = duck(folder)
    failed = 0
    for name in names or entry_points.queries():
        start = time.time()
        try:
            notes = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            notes = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(notes)
        print(f"{'FAIL' if notes else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for note in notes:
            print("     ", note)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(bool(main(where, sys.argv[2:])))
