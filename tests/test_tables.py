from __future__ import annotations

import pytest
from helpers import rows_of

from colloquy.operators import cleaning, profiling
from colloquy.schema import CLIENTS
from colloquy.sources import adapters, tables


def test_source_needs_a_table_or_query(spark):
    with pytest.raises(ValueError):
        tables.read_source(spark)
    with pytest.raises(ValueError):
        tables.read_source(spark, "chats")


def test_query_wins_over_table(spark):
    tables.register_views(spark, {"numbers": spark.range(5)})
    got = tables.read_source(spark, "missing", "SELECT max(id) AS m FROM numbers", folder="/nowhere")
    assert rows_of(got) == [(4,)]


def test_jdbc_options():
    login = {"url": "jdbc:mysql://db/chat", "user": "u", "password": "p"}
    assert tables.jdbc_options("chats", None, login)["dbtable"] == "chats"
    assert tables.jdbc_options("chats", "SELECT 1", login)["query"] == "SELECT 1"
    split = tables.jdbc_options("chats", None, login, ("id", 0, 100, 4))
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "0", "100", "4")
    both = tables.jdbc_options(None, "SELECT 1 AS id", login, ("id", 0, 1, 2))
    assert both["dbtable"] == "(SELECT 1 AS id) q" and "query" not in both


def test_write_and_read(spark, tmp_path, chats):
    frame = chats([(1, 1, "2024-01-01 10:00:00", "q", None), (2, 2, "2024-01-02 10:00:00", None, "a")])
    tables.write_reports({"chats": frame.withColumn("day", frame.created_at.cast("date"))}, str(tmp_path), partition_by={"chats": ["day"]})
    assert (tmp_path / "chats" / "day=2024-01-02").is_dir()
    tables.write_reports({"plain": frame}, str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "reports" / "plain")).count() == 2
    frame.write.parquet(f"{tmp_path}/t.parquet")
    back = tables.read_chats(spark, table="t", folder=str(tmp_path))
    assert sorted(rows_of(back)) == sorted(rows_of(frame))
    people = spark.createDataFrame([(1, "Ann", None)], CLIENTS)
    people.write.parquet(f"{tmp_path}/clients.parquet")
    assert rows_of(tables.read_clients(spark, table="clients", folder=str(tmp_path))) == [(1, "Ann", None)]


NAMES = [
    (1, "Mary Ann"), (2, "Jean-Luc"), (3, "Bob2"), (4, "Al"), (5, "A Z"), (6, "A Y"), (7, "Zoé"),
    (8, ""), (9, None), (0, "Bob3"), (10, "Ann "),
]


def test_clean_clients(spark):
    frame = spark.createDataFrame(NAMES, "id long, name string")
    cleaned = cleaning.clean_tables({"clients": frame})["clients"]
    assert cleaned.columns == ["client_id", "name"]
    assert sorted(r[0] for r in rows_of(cleaned)) == [0, 1, 2, 9]


def test_every_delete_alone(spark):
    frame = spark.createDataFrame(NAMES, "client_id long, name string")

    def left(step):
        return {r[0] for r in rows_of(cleaning.clean(frame, [step]))}

    everything = {i for i, _ in NAMES}
    assert left(("delete_unmatched", "client_id", "name", cleaning.NAME_PATTERN)) == everything - {3, 7, 8, 10}
    assert left(("delete_short", "client_id", "name", 2)) == everything - {4, 8}
    assert left(("delete_short", "client_id", "name", 4)) == everything - {3, 4, 5, 6, 7, 8, 10}
    assert left(("delete_values", "client_id", "name", cleaning.FAKE_NAMES)) == everything - {5, 6}


def test_default_plans_and_empty_tables(spark):
    made = {
        "users": "id int, email_verified_at int, phone int, dob int, photo int, email int",
        "bot_user": "created_at int, updated_at int, bot_id int",
        "bots": "id int, assistant_id int, vector_store_id int, thread_id int",
        "categories": "id int",
        "orders": "id int",
        "order_items": "special_instructions int, n int",
        "objects": "id int",
        "companies": "id int",
        "telescope_entries": "family_hash int, n int",
        "others": "id int",
    }
    frames = {}
    for name, schema in made.items():
        frames[name] = spark.createDataFrame([tuple(range(len(schema.split(","))))], schema)
    cleaned = {name: frame.columns for name, frame in cleaning.clean_tables(frames).items()}
    assert cleaned == {
        "users": ["user_id", "email"],
        "bot_user": ["bot_id"],
        "bots": ["bot_id"],
        "categories": ["category_id"],
        "orders": ["order_id"],
        "order_items": ["n"],
        "objects": ["object_id"],
        "companies": ["company_id"],
        "telescope_entries": ["n"],
        "others": ["id"],
    }
    frames["posts"] = frames["orders"].filter("false")
    assert set(cleaning.drop_empty_tables(frames)) == set(made)


def test_profile(spark):
    long = "x" * 100
    frame = spark.createDataFrame(
        [(1, "a", None), (2, "b", True), (2, None, True), (3, long + "1", False), (3, long + "2", False)],
        "n int, t string, f boolean",
    )
    expected = [
        ("p", "n", "int", 5, 0, 3, 1.0, 3.0, None, None),
        ("p", "t", "string", 5, 1, 4, None, None, "a", long + "2"),
        ("p", "f", "boolean", 5, 1, 2, None, None, "false", "true"),
    ]
    for exact in (True, False):
        assert sorted(rows_of(profiling.profile_table(frame, "p", exact=exact))) == sorted(expected)
    empty = rows_of(profiling.profile_table(frame.filter("false"), "p"), "row_count", "distinct_count", "min_text")
    assert empty == [(0, 0, None)] * 3
    top = rows_of(profiling.top_values(frame, "p", ["n", "f"], n=1))
    assert top == [("p", "n", "2", 2), ("p", "f", "false", 2)]


def test_unknown_columns_raise(spark):
    frame = spark.createDataFrame([(1, "a")], "id long, name string")
    for step in (("drop", "nme"), ("rename", {"nme": "x"})):
        with pytest.raises(ValueError, match="nme"):
            cleaning.clean(frame, [step])


def test_message_ids_do_not_collide(spark):
    rows = spark.createDataFrame([(1, 1000), (2, 0), (1, 2_000_000)], "c long, t long")
    ids = rows_of(rows.select(adapters.message_id(rows.c, rows.t)))
    assert len(set(ids)) == 3
    with pytest.raises(Exception, match="no message id"):
        rows.select(adapters.message_id(rows.c, -rows.t - 1)).collect()
