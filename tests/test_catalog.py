"""Sources: session catalog (views and temporary tables left out), Parquet
folders, row pages, ordered projection."""

import pytest

from tablekeep.sources.catalog import CatalogSource, ParquetDirSource, list_base_tables, table_ddl, column_metadata
from tablekeep.sources.scan import project_ordered, row_page

from conftest import SF0001


def test_catalog_source_base_tables_only(spark, tmp_root):
    spark.read.parquet(f"{SF0001}/region.parquet").write.parquet(f"{tmp_root}/region")
    spark.sql(f"CREATE TABLE IF NOT EXISTS tk_region USING parquet LOCATION '{tmp_root}/region'")
    spark.sql("CREATE OR REPLACE TEMP VIEW tk_view AS SELECT 1 AS x")
    spark.sql("CREATE OR REPLACE VIEW tk_perm_view AS SELECT * FROM tk_region")
    names = [r.table_name for r in list_base_tables(spark, CatalogSource(spark, "default")).collect()]
    assert "tk_region" in names and "tk_view" not in names and "tk_perm_view" not in names
    assert CatalogSource(spark, "default").load("tk_region").count() == 5
    spark.sql("DROP VIEW tk_perm_view")
    spark.sql("DROP TABLE tk_region")


def test_parquet_folder_source(spark):
    src = ParquetDirSource(spark, SF0001)
    assert len(src.table_names()) == 14 and src.table_names() == sorted(src.table_names())
    ddl = {r.table_name: r.ddl for r in table_ddl(column_metadata(spark, {"region": src.load("region")})).collect()}
    assert ddl["region"] == "CREATE TABLE `region` (\n  `r_regionkey` int DEFAULT NULL,\n  `r_name` longtext DEFAULT NULL\n)"


def test_row_page_and_projection(spark):
    c = spark.read.parquet(f"{SF0001}/customer.parquet")
    page = [r.c_custkey for r in row_page(c, ["c_custkey"], 3, 5).collect()]
    assert page == [5, 6, 7]
    with pytest.raises(ValueError):
        row_page(c, ["c_custkey"], 0, 0)
    with pytest.raises(ValueError):
        row_page(c, ["c_custkey"], 1, -1)
    assert project_ordered(c, ["c_name", "c_custkey"]).columns == ["c_name", "c_custkey"]
    with pytest.raises(Exception):
        project_ordered(c, ["missing"]).collect()
