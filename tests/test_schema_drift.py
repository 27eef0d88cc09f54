import json

from tidemark.operators.schema_drift import cells, consistent_table, schema_changes

FEED = "file_no long, line_no int, action string, schema_name string, table_name string, key_names array<string>, after_image string"


def test_changes_between_files(spark):
    def line(f, n, image):
        return (f, n, "INSERT", "s", "t", ["id"], image if isinstance(image, str) else json.dumps(image))

    rows = [line(1, n, {"id": n, "mass": n * 10, "A": 1, "ok": "t"}) for n in range(3)]
    rows += [line(3, n, {"id": str(n), "mass_g": str(n * 10), "a": 1, "A": 2.5, "ok": True}) for n in range(3)]
    rows += [line(4, 0, {"id": 0, "mass_g": 0, "A": 1.5, "ok": "EUR 1"}), line(4, 1, '{"id": 1, "zzz'), (4, 2, "DELETE", "s", "t", ["id"], None)]
    got = {tuple(r)[2:] for r in schema_changes(cells(spark.createDataFrame(rows, FEED))).collect()}
    assert got == {
        (3, "renamed", "mass_g", "mass"), (3, "added", "a", None), (4, "removed", "a", None),
        (3, "retyped", "A", None), (4, "retyped", "ok", None),
    }
    rows.append(line(4, 9, {"id": 0, "mass_g": 0, "A": 1.5, "ok": "EUR 1"}))
    tagged = cells(spark.createDataFrame(rows, FEED))
    table = {(r.file_no, r.line_no): r.columns for r in consistent_table(tagged, schema_changes(tagged)).collect()}
    assert len(table) == 7
    assert all(set(c) == {"id", "mass_g", "A", "a", "ok"} for c in table.values())
    assert table[(1, 2)]["mass_g"].whole == 20 and table[(1, 2)]["a"] is None
    assert table[(1, 0)]["ok"].flag is True and table[(4, 0)]["ok"].text == "EUR 1" and table[(4, 0)]["A"].decimal == 1.5


def brute(rows):
    """The changes by the words of the definition, table by table, with plain dictionaries."""
    import re
    from collections import defaultdict

    def kind(v):
        text = v if isinstance(v, str) else json.dumps(v)
        if isinstance(v, list):
            return "list"
        for name, pattern in [("whole", r"[+-]?\d+"), ("decimal", r"[+-]?\d+\.\d+"), ("flag", "t|f|true|false"), ("at", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"), ("list", r"\{.*\}|\[.*\]")]:
            if re.fullmatch(pattern, text):
                return name
        return "text"

    tables = defaultdict(lambda: defaultdict(list))
    for r in sorted(rows, key=lambda r: (r["file_no"], r["line_no"])):
        try:
            image = json.loads(r["after_image"] or "null")
        except ValueError:
            continue
        if isinstance(image, dict):
            tables[(r["schema_name"], r["table_name"])][r["file_no"]].append((image, "|".join(str(image.get(k)) for k in r["key_names"] or [])))
    out = set()
    for table, by_file in tables.items():
        files = sorted(by_file)
        where = defaultdict(list)
        for f in files:
            for c in {c for image, _ in by_file[f] for c in image}:
                where[c].append(f)
        came = {c: fs[0] for c, fs in where.items() if fs[0] != files[0]}
        gone = {c: files[files.index(fs[-1]) + 1] for c, fs in where.items() if fs[-1] != files[-1]}
        renamed = {}
        for old, f in gone.items():
            for new in [c for c, g in came.items() if g == f and c not in renamed]:
                was, now = {}, {}
                for g in files:
                    for image, key in by_file[g]:
                        if image.get(old) is not None and g < f:
                            was[key] = str(image[old])
                        if image.get(new) is not None and g >= f:
                            now.setdefault(key, str(image[new]))
                shared = set(was) & set(now)
                if shared and sum(was[k] == now[k] for k in shared) > len(shared) / 2:
                    renamed[new] = old
                    break
        out |= {(*table, f, "renamed", c, renamed[c]) if c in renamed else (*table, f, "added", c, None) for c, f in came.items()}
        out |= {(*table, f, "removed", c, None) for c, f in gone.items() if c not in renamed.values()}
        for c, fs in where.items():
            before = None
            for f in fs:
                tags = {kind(image[c]) for image, _ in by_file[f] if image.get(c) is not None}
                now = None if not tags else tags.pop() if len(tags) == 1 else "decimal" if tags == {"whole", "decimal"} else "text"
                if now and before and now != before:
                    out.add((*table, f, "retyped", c, None))
                before = now or before
    return out


def test_p5_found_against_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    got = [tuple(r) for r in entry.queries()["p5_found"](spark, sf).select("schema_name", "table_name", "file_no", "kind", "column_name", "old_name").collect()]
    want = brute([r.asDict() for r in spark.read.parquet(f"{sf}/raw_feed.parquet").collect()])
    assert len(got) == len(set(got)) and set(got) == want and len({g[3] for g in got}) == 4


def test_values_of_one_type_by_chance_and_odd_lines(spark):
    def line(f, n, image, key=("id",)):
        return (f, n, "UPDATE", None, "t", None if key is None else list(key), image if image is None or isinstance(image, str) else json.dumps(image))

    rows = [line(1, 0, {"id": 1, "site": "86K"}), line(1, 1, {"id": 2, "site": "77"}), line(2, 0, {"id": 1, "site": "77"}), line(3, 0, {"id": 1, "site": "9A"})]
    rows += [line(4, 0, {}), line(4, 1, "[1]"), line(4, 2, ""), line(4, 3, None), line(4, 4, '{"id": NaN}'), line(5, 0, {"id": 1, "site": None}, None)]
    df = spark.createDataFrame(rows, FEED).selectExpr("*", "1 as column_name", "2 as tag")
    tagged = cells(df)
    assert schema_changes(tagged).collect() == []  # file 2 holds whole numbers by chance, file 4 is the table's without a column
    assert consistent_table(tagged, schema_changes(tagged)).count() == 5
    assert schema_changes(cells(df.limit(0))).count() == 0


def test_p5_found_has_an_empty_old_name_unless_renamed(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, 0, "INSERT", "s", "t", ["id"], '{"id": 1, "qty": 5, "a": 1}'), (2, 0, "UPDATE", "s", "t", ["id"], '{"id": 1, "amount": 5, "b": "x", "c": "y"}')]
    spark.createDataFrame(rows, FEED).write.parquet(f"{tmp_path}/raw_feed.parquet")
    got = {tuple(r) for r in entry.queries()["p5_found"](spark, str(tmp_path)).collect()}
    assert got == {
        ("s", "t", 2, "renamed", "amount", "qty"), ("s", "t", 2, "removed", "a", ""),
        ("s", "t", 2, "added", "b", ""), ("s", "t", 2, "added", "c", ""),
    }


def test_renamed_columns_whose_type_changes_before_all_rows_are_seen(spark):
    def line(f, image):
        return (f, image["id"], "UPDATE", "s", "t", ["id"], json.dumps(image))

    # score becomes rating in file 2, most rows come only in file 3, as text; gram is text from file 2 on and mass in file 3;
    # kind goes for another column that is a list at first and later holds, as text, what kind held in one row of three
    rows = [line(1, {"id": n, "score": n + 0.5, "gram": n, "kind": f"k{n}"}) for n in range(9)]
    rows += [line(2, {"id": n, "rating": n + 0.5, "gram": f"{n} g", "other": [n]}) for n in range(3)]
    rows += [line(3, {"id": n, "rating": f"EUR {n}.50", "mass": f"{n} g", "other": f"k{n}" if n < 6 else "k"}) for n in range(9)]
    got = {tuple(r)[2:] for r in schema_changes(cells(spark.createDataFrame(rows, FEED))).collect()}
    assert got == {
        (2, "renamed", "rating", "score"), (3, "retyped", "rating", None), (3, "renamed", "mass", "gram"), (2, "retyped", "gram", None),
        (2, "removed", "kind", None), (2, "added", "other", None), (3, "retyped", "other", None),
    }
