"""Query plans over the test tables, each with the SQL that it must equal."""


def as_bigint(sql: dict[str, str], name: str, *columns: str) -> None:
    """Sums of integers are HUGEINT in the SQL engine and long here."""
    casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in columns)
    sql[name] = f"SELECT * REPLACE ({casts}) FROM ({sql[name]})"
