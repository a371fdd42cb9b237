"""Titles of landed pages against the SQL."""

import duckdb

import __spark_entry__ as entry


def test_titles_with_entities_are_those_of_the_sql(spark, tmp_path):
    heads = ['token = &quot;ab &amp; c&quot;', 'a &lt;b&gt; &amp;quot; "d"', " x <b>y</b> &copy; ", "", "&amp;amp;"]
    rows = [(i, f"u{i}", f"<html><body><article><h1>{h}</h1><p>{h}</p></article></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cur = con.execute(entry.oracle_sql()["extract_articles"])
    names = [d[0] for d in cur.description]
    got = entry.queries()["extract_articles"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
