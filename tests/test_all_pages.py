"""The network log over all pages, whatever their number and ids."""

from __future__ import annotations

import pytest

from maskframe.jobs import network


@pytest.mark.parametrize("ids", [range(300), [7, 1000, 5000]])
def test_every_page_and_event_is_in_the_log(spark, tmp_path, ids):
    ids = list(ids)
    spark.createDataFrame([(i, f"https://a.example/{i}#x") for i in ids], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(600).selectExpr("id AS event_id", "id % 9 AS user_id", "'get' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    rows = network.all_pages_log(spark, str(tmp_path)).select("entry", "url").distinct().collect()
    assert {r.url for r in rows} == {f"https://a.example/{i}" for i in ids}
    assert sorted(r.entry for r in rows) == list(range(600))
