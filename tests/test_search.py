"""The title index gives the rows of the plain search."""

import pytest
from helpers import table

from fieldpulse.operators import search, views

TITLES = ["Deep learning", "deep  Learning of graphs", "A deeper look", "Graphs", None, "", "  ", "learning\tdeep", "100% sure_",
          "Straße", "knee-deep learn"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    works = table(spark, "works", [
        dict(work_id=f"W{i:03d}", title=TITLES[i % len(TITLES)], publication_year=2000 + i % 4,
             cited_by_count=None if i % 17 == 0 else (i * 7919) % 300) for i in range(330)])
    tags = table(spark, "work_topics", [dict(work_id=f"W{i:03d}", topic_id=f"T{i % 3}") for i in range(330)])
    people = table(spark, "authorships", [dict(work_id=f"W{i:03d}", author_id=f"A{i % 5}") for i in range(330)])
    folder = str(tmp_path_factory.mktemp("titles"))
    search.build_title_index(works, folder, buckets=4)
    return works, tags, people, folder


FILTERS = {"topics": ["T1"], "authors": ["A1", "A2"], "years": (2001, 2002)}


@pytest.mark.parametrize("query, n, filters", [
    ("deep", 3, {}), ("LEARN", 3, FILTERS), ("deep learning", 1000, {}), ("p l", 1000, FILTERS), (" deep", 1000, {}),
    ("\tdeep", 1000, {}), ("100%", 5, {}), ("straße", 1000, {}), ("none of it", 5, {}), ("", 5, FILTERS), (" ", 1000, {})])
def test_index_equals_scan(spark, tables, query, n, filters):
    works, tags, people, folder = tables
    want = views.evidence_works(works, tags, people, query=query, n=n, **filters)
    got = search.search_titles(works, tags, people, folder, query, n=n, buckets=4, **filters)
    assert [tuple(r) for r in got.collect()] == [
        tuple(r) for r in want.select("work_id", "title", "publication_year", "cited_by_count").collect()]


def test_many_words_fall_back_to_the_titles(spark, tables, monkeypatch):
    works, tags, people, folder = tables
    monkeypatch.setattr(search, "MOST_WORDS", 1)
    assert search.matching_words(spark, folder, "deep", 4) is None
    got = search.search_titles(works, tags, people, folder, "deep", n=5, buckets=4)
    assert got.collect() == views.evidence_works(works, tags, people, query="deep", n=5).select(*got.columns).collect()


def test_steps_cover_all_bands_once(monkeypatch):
    monkeypatch.setattr(search, "STEP", 1)
    assert search.band_steps([], 3) == []
    assert search.band_steps([(0, 1), (9, 2), (4, 1), (2, 5), (1, 1)], 3) == [(4, 9), (1, 2), (0, 0)]
    assert search.band_steps([(0, 9), (9, 9)], 3) == [(9, 9), (0, 0)]


def test_only_asked_folders_are_read(spark, tables):
    rows = search.asked_postings(spark, tables[3], ["deep", "graphs"], (0, 9), 4)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(word, [deep,graphs])" in plan
    assert {r.word for r in rows.select("word").distinct().collect()} == {"deep", "graphs"}


def test_empty_works(spark, tables, tmp_path):
    works, tags, people, _ = tables
    search.build_title_index(works.limit(0), str(tmp_path), buckets=4)
    assert search.search_titles(works.limit(0), tags, people, str(tmp_path), "deep", buckets=4).count() == 0
