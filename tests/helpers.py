"""Small tables written by hand."""

from fieldpulse.schemas import TABLES


def table(spark, name, rows):
    """Rows given as dicts; missing columns are null."""
    columns = [f.split(" ")[0] for f in TABLES[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], TABLES[name])


def corpus(spark, works):
    """``works``: (id, year, citations, topics, authors) tuples to the three tables."""
    return (
        table(spark, "works", [dict(work_id=w, title=f"title {w}", publication_year=y, cited_by_count=c)
                               for w, y, c, _, _ in works]),
        table(spark, "work_topics", [dict(work_id=w, topic_id=t, topic_name=f"name {t}", score=1.0)
                                     for w, _, _, ts, _ in works for t in ts]),
        table(spark, "authorships", [dict(work_id=w, author_id=a, author_name=f"name {a}",
                                          author_position="middle")
                                     for w, _, _, _, people in works for a in people]),
    )


def as_dict(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}
