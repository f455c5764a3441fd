"""Pages of a service, asked for again after errors."""

from tidemark.sources import facts


def test_pages_that_took_several_attempts(spark):
    good = '{"next": 2, "items": [{"k": 1, "v": "a"}, {"k": 2, "v": null}], "more": {"x": []}}'
    rows = [(1, 1, 500, "oops"), (1, 2, 200, good[:-9]), (1, 3, 200, good), (1, 4, 429, None), (2, 1, 200, '{"items": []}'), (3, 1, 200, '{"error": "x"}'), (4, 1, 200, None), (5, 1, 200, '{"items": [{"k": 7}]}'), (5, 2, 200, '{"items": [{"k": 8}]}'), (5, 3, 200, "[1, 2")]
    df = spark.createDataFrame(rows, "page int, attempt int, status int, body string")
    assert sorted(tuple(r) for r in facts.paged_items(df, "k int, v string").collect()) == [(1, 0, 1, "a"), (1, 1, 2, None), (5, 0, 8, None)]
    assert sorted(r.page for r in facts.missing_pages(df, "k int, v string").collect()) == [2, 3, 4]
    assert facts.paged_items(df.limit(0), "k int").count() == 0
