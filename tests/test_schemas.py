import pytest

from orgweave import schemas


@pytest.mark.parametrize("name", sorted(schemas.TABLES))
def test_schema_parses(spark, name):
    assert len(schemas.empty(spark, name).columns) > 2


def test_read_fills_missing_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a.com", "b.com")], "primary_domain string, alias_domain string").write.parquet(path)
    row = schemas.read(spark, "domain_alias", path).head()
    assert row["alias_domain"] == "b.com" and row["confidence"] is None
