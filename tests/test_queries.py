import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "documents embeddings conversations".split()
#: A query of each kind; the driver compares them all.
NAMES = "segment_turns parse_plain_text append_turns truncate_text top_words chunk_assignments topic_labels build_nodes cosine_topk warm_search retrieve_hybrid context_messages tokens_saved session_stats".split()


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    frame = entry.queries()[name](spark, sf)
    answer = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    expected = sorted(repr([plain(row[names.index(c)]) for c in sorted(names)]) for row in answer.fetchall())
    assert sorted(frame.columns) == sorted(names)
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in frame.collect()) == expected


def test_every_query_has_sql():
    from palimpsest.plans.oracle import ORACLE_SQL
    from palimpsest.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())
