"""The paged listing source against a plain loop."""

import pytest
from pyspark.sql import functions as F

from lexivec.plans import queries as own
from lexivec.sources import paged
from tests.oracle import DATA

#: Of each page, whether each of its cards is new.
PAGES = {
    "ends": [[True, False], [False], [True], [], [True]],
    "old cards": [[True], [False], [False], [False], [True]],
    "broken off": [[True], [False, False], [], [True]],
    "two old, one new": [[False], [False], [False, True], [False]],
    "none": [],
}


def pages_of(listing, page):
    return [(f"{listing} {page} {k}", new) for k, new in enumerate(PAGES[listing][page])] if page < len(PAGES[listing]) else []


def read(names, most=3):
    out = []
    for name in names:
        streak, page = 0, 0
        while streak < most:
            cards = pages_of(name, page)
            out += [(name, page, *c) for c in cards]
            streak = 0 if any(n for _, n in cards) else streak + (1 if cards else 2)
            page += 1
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3, 4])
@pytest.mark.parametrize("tasks", [1, 64])
def test_pages_until_nothing_is_new(spark, most, tasks):
    got = paged.paged_listing(spark, [*PAGES, "ends"], pages_of, most=most, tasks=tasks, name=f"paged_{most}_{tasks}")
    assert sorted(map(tuple, got.collect())) == read(PAGES, most)


def test_filters_reach_the_source(spark, tmp_path):
    def fetch(listing, page):
        (tmp_path / listing).touch()
        return pages_of(listing, page)

    rows = paged.paged_listing(spark, list(PAGES), fetch, name="paged_filtered").where((F.col("listing") == "ends") & (F.col("page") > 0))
    assert sorted(map(tuple, rows.collect())) == [r for r in read(["ends"]) if r[1] > 0]
    assert [f.name for f in tmp_path.iterdir()] == ["ends"]
    none = paged.paged_listing(spark, list(PAGES), fetch, name="paged_none").where("listing = 'not there'")
    assert none.collect() == [] and paged.paged_listing(spark, [], fetch, name="paged_empty").collect() == []


def test_a_failing_page_is_asked_for_again(spark, tmp_path):
    def fetch(listing, page):
        mark = tmp_path / f"{listing} {page}"
        if not mark.exists():
            mark.touch()
            raise OSError("no answer")
        return pages_of(listing, page)

    got = paged.paged_listing(spark, list(PAGES), fetch, delay=0.0, name="paged_again")
    assert sorted(map(tuple, got.collect())) == read(PAGES)

    def never(listing, page):
        raise OSError("no answer at all")

    with pytest.raises(Exception, match="no answer at all"):
        paged.paged_listing(spark, ["ends"], never, delay=0.0, name="paged_never").collect()


def test_the_query_ends_listings_before_their_last_page(spark):
    """Each of the three listings gives rows, and none all of its 80 pages."""
    last = {r.listing: r["max(page)"] for r in own.QUERIES["paged_listing"](spark, DATA).groupBy("listing").agg(F.max("page")).collect()}
    assert len(last) == 3 and len(set(last.values())) == 3 and 0 < min(last.values()) and max(last.values()) < 79


def test_pages_that_executors_do_not_see_are_an_error(spark, tmp_path):
    for folder in (f"file://{tmp_path}/nothing", "hdfs://host/pages"):
        with pytest.raises(FileNotFoundError):
            paged.captured_pages(folder)("ends", 0)
    (tmp_path / "listing=ends" / "page=0").mkdir(parents=True)
    (tmp_path / "listing=ends" / "page=0" / "part-0").write_text('{"card": "a", "new": true}\n{"new": false}\n')
    assert paged.captured_pages(f"file://{tmp_path}")("ends", 0) == [("a", True), (None, False)] and not paged.captured_pages(str(tmp_path))("ends", 1)
