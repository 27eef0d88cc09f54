"""A destination that takes statements over a database connection, one transaction for each batch of statements."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.control.registry import SINKS
from tidemark.operators.render import statements
from tidemark.session import ship

_HOLDER = re.compile(r"\$(\d+)")


def execute(connection: Any, batch: list[tuple[str, list]], mark: str = "?") -> int:
    """Run the statements of a batch in one transaction; the first error undoes all of it. The number of statements.

    Placeholders $n are written as the driver wants them; their numbers run in order within a statement.
    """
    cursor = connection.cursor()
    try:
        for sql, args in batch:
            cursor.execute(_HOLDER.sub(mark, sql), args)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        cursor.close()
    return len(batch)


class StatementSink:
    """connect() gives a connection of any driver of the Python database interface; it is called on the executors.

    Events of a key stay in order: they go to one task, sorted. Moves touch two keys, so where rows can move, by is the
    table alone. Statements of keyed tables can be repeated, so a batch that comes again changes nothing; inserts into
    tables without key are repeated too.
    """

    def __init__(self, name: str, connect: Callable[[], Any], order: list[str] = ("commit_lsn", "lsn", "seq"), by: list[str] = ("schema_name", "table_name"), size: int = 5000, mark: str = "?", schema: bool = True):
        self.name, self.connect, self.order, self.by, self.size, self.mark, self.schema = name, connect, list(order), list(by), size, mark, schema

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        ship(batch.sparkSession)
        events = batch if self.schema else batch.withColumn("schema_name", F.lit(""))
        lined = statements(events, list(dict.fromkeys([*self.order, *self.by])))
        lined = lined.repartition(*self.by).sortWithinPartitions(*self.order)
        connect, size, mark = self.connect, self.size, self.mark

        def run(rows: Iterator) -> None:
            connection, held = None, []
            try:
                for r in rows:
                    connection = connection or connect()
                    held.append((r.sql, list(r.args)))
                    if len(held) == size:
                        execute(connection, held, mark)
                        held = []
                if held:
                    execute(connection, held, mark)
            finally:
                if connection is not None:
                    connection.close()

        lined.select("sql", "args").foreachPartition(run)

    def probe(self) -> None:
        """Connect, ask for a one, and close."""
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute("SELECT 1")
            cursor.fetchall()
            cursor.close()
        finally:
            connection.close()

    def close(self) -> None:
        pass


SINKS.register("statements")(StatementSink)
