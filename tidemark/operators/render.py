"""Change events as parameterised statements, for destinations that take statements.

Columns come in the order of their names, identifiers are quoted, placeholders are $1, $2 and so on. An event that has
no effect on rows has a null statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import key_values


def quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def _joined(names: Column, form, sep: str) -> Column:
    return F.array_join(F.transform(names, form), sep)


def statement(c: DataFrame) -> tuple[Column, Column]:
    """(sql, args) of an event: insert with overwrite of the listed columns, update, delete, or null for none.

    args is array<string>, in the order of the placeholders. UPDATE finds its row by the key before the change.
    """
    before, after = c["before_image"], c["after_image"]
    names = F.coalesce(c["key_names"], F.array().cast("array<string>"))
    table = F.when(F.coalesce(c["schema_name"], F.lit("")) == "", quoted(c["table_name"])).otherwise(F.concat(quoted(c["schema_name"]), F.lit("."), quoted(c["table_name"])))
    listed = F.array_sort(F.map_keys(after))
    values = F.transform(listed, lambda n: F.try_element_at(after, n))
    free = F.filter(listed, lambda n: ~F.array_contains(names, n))
    keyed = F.size(names) > 0
    holds = F.coalesce(F.size(after), F.lit(0)) > 0

    holder = F.array_join(F.transform(listed, lambda n, i: F.concat(F.lit("$"), (i + 1).cast("string"))), ", ")
    insert = F.concat(F.lit("INSERT INTO "), table, F.lit(" ("), _joined(listed, quoted, ", "), F.lit(") VALUES ("), holder, F.lit(")"))
    overwrite = _joined(free, lambda n: F.concat(quoted(n), F.lit(" = EXCLUDED."), quoted(n)), ", ")
    action = F.when(F.size(free) > 0, F.concat(F.lit("DO UPDATE SET "), overwrite)).otherwise(F.lit("DO NOTHING"))
    upsert = F.concat(insert, F.lit(" ON CONFLICT ("), _joined(names, quoted, ", "), F.lit(") "), action)

    def where(first: int | Column) -> Column:
        one = lambda n, i: F.concat(quoted(n), F.lit(" = $"), (i + 1 + first).cast("string"))
        return F.array_join(F.transform(names, one), " AND ")

    sets = F.array_join(F.transform(listed, lambda n, i: F.concat(quoted(n), F.lit(" = $"), (i + 1).cast("string"))), ", ")
    update = F.concat(F.lit("UPDATE "), table, F.lit(" SET "), sets, F.lit(" WHERE "), where(F.size(listed)))
    delete = F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), where(0))

    named = F.coalesce(c["table_name"], F.lit("")) != ""
    is_insert, is_update = named & (c["action"] == "INSERT") & holds, named & (c["action"] == "UPDATE") & holds & keyed
    is_delete = named & (c["action"] == "DELETE") & (F.coalesce(F.size(before), F.lit(0)) > 0) & keyed
    sql = F.when(is_insert & keyed, upsert).when(is_insert, insert).when(is_update, update).when(is_delete, delete)
    args = F.when(is_insert, values).when(is_update, F.concat(values, key_values(names, before, after))).when(is_delete, key_values(names, before))
    return sql, args


def statements(changes: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of changes with sql and args; events without a statement are left out."""
    sql, args = statement(changes)
    return changes.select(*keep, sql.alias("sql"), args.alias("args")).filter(F.col("sql").isNotNull())
