import __spark_entry__


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
