"""Queries against their SQL over small tables with what larger ones hold: urls of several pages, cut references, long keys."""

import duckdb
import pytest

from concord.plans import ORACLE, QUERIES


@pytest.fixture
def compare(spark, tmp_path):
    def run(name: str, **tables: str):
        """The rows of a query and of its SQL over tables made by SQL."""
        c = duckdb.connect()
        for t, sql in tables.items():
            c.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        rel = c.execute(f"SELECT {', '.join(chr(34) + x + chr(34) for x in df.columns)} FROM ({ORACLE[name]})")
        return sorted(map(tuple, df.collect()), key=str), sorted(rel.fetchall(), key=str)

    return run


def test_check_files_of_pages_that_share_a_url(compare):
    got, want = compare("check_files", pages="SELECT CAST(i AS BIGINT) AS page_id, 'http://a/' || i % 5 AS url, '<p>' || i || '</p>' AS html FROM range(1, 60) r(i)")
    assert got == want and len(got) == 3 + 4 + 3


_CUT = "SELECT CAST(i AS BIGINT) AS page_id, '<html><head><title>' || t || '</title></head><body><p>' || t || '</p></body></html>' AS html FROM (VALUES (1, 'a &amp'), (2, 'say &quot;x&quot; &am'), (3, 'b &amp;quot; &quot'), (4, 'c &lt; d &amp;&amp;')) v(i, t)"


def test_page_title_with_cut_references(compare):
    got, want = compare("page_title", pages=_CUT)
    assert got == want == [(1, "a &"), (2, 'say "x" &am'), (3, 'b &quot; "'), (4, "c < d &&")]


def test_page_text_with_cut_references(compare):
    got, want = compare("page_text", pages=_CUT)
    assert got == want and len(got) == 4


def test_locator_scoped_by_long_keys(compare):
    got, want = compare("locator_scoped", supplier="SELECT CAST(i AS BIGINT) AS s_suppkey FROM range(9998, 10003) r(i)")
    assert got == want == [(9998, "#box9998 button.main.wide", True), (9999, "#box9999 button.main.wide", False)]
