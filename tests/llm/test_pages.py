import random

import duckdb
import pytest

from quire.llm import fixity, queries, urls

from .conftest import SMALL


def by_sql(name, sf=SMALL):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.sql(queries.ORACLES[name])
    return sorted(map(str, ({c: v for c, v in sorted(zip(got.columns, r))} for r in got.fetchall())))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    rows = queries.QUERIES[name](spark, SMALL).collect()
    assert sorted(str(dict(sorted(r.asDict().items()))) for r in rows) == by_sql(name)


def test_rules(spark):
    pages = spark.createDataFrame([
        (1, "http://A.Example.com/en/1"), (2, "http://www.example.com/en/1"), (3, "http://x.www.example.com/en/"),
        (4, "http://example.com/fr"), (5, "ftp://a.net/es/?q"), (6, "http://a.net/es"), (7, "http://b.net?/es/"),
        (8, None), (9, "no host/com/"), (10, "http://"), (11, "x://com/y://net/es/")], "page_id long, url string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert rows[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert rows[2][2:] == rows[3][2:] == ("www.example.com/en/", "allow")
    assert rows[4][2:] == ("com/", "allow") and rows[5] == ("a.net", "/es/", "net/es/", "block")
    assert rows[6][2] is None and rows[7][:3] == ("b.net", "", None)
    assert rows[8] == rows[9] == ("", "", None, "allow") and rows[10][:2] == ("", "")
    assert rows[11] == ("com", "/y://net/es/", "com/", "allow")


def test_alike_branches_merge_and_pure_templates_are_rejected(spark):
    rows = [(i, f"http://h.net/{lang}/{i}") for i, lang in enumerate(["es", "fr"] * 20 + ["en"] * 20)]
    rows += [(100 + i, f"http://q.net/es/{i}/page") for i in range(5)] + [(200, "http://q.net/es/7"), (201, "http://q.net/es")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0]["template"] == got[1]["template"] == "h.net/~/*"
    assert got[40]["template"] == "h.net/en/*" and got[40]["verdict"] == "allow"
    settled = urls.Settings(rules=(("block", "z.net/a"),))
    rows = [(i, f"http://z.net/a{'x' if i % 2 else ''}/{i}") for i in range(40)]
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), settled).collect()} == {"block"}


def test_rare_words_among_many_siblings_are_a_wildcard(spark):
    names = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    rows = [(i, f"http://h.org/{n}") for i, n in enumerate(names)] + [(100 + i, "http://h.org/about") for i in range(60)]
    got = {r["page_id"]: r["template"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0] == got[59] == "h.org/*" and got[100] == "h.org/about"


def test_branches_below_the_third_segment_have_their_own_templates(spark):
    deep = "a/b/c/" + "d/" * 9
    rows = [(i, f"http://h.net/{deep}spam/x{i}") for i in range(40)] + [(100 + i, f"http://h.net/{deep}spam/{i}") for i in range(10)]
    rows += [(200 + i, f"http://h.net/{deep}news/{i}") for i in range(40)] + [(300, "http://h.net/a/b"), (301, "http://h.net/a/b/c")]
    setting = urls.Settings(rules=(("block", f"h.net/{deep}spam/x"),))
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), setting).collect()}
    assert len(got) == len(rows)
    spam, news = {got[i]["template"] for i in [*range(40), *range(100, 110)]}, {got[200 + i]["template"] for i in range(40)}
    assert len(spam) == len(news) == 1 and spam != news and {t.count("/") for t in spam | news} == {14}
    assert all(got[100 + i]["verdict"] == "block" for i in range(10)) and all(got[200 + i]["verdict"] == "allow" for i in range(40))
    assert (got[300]["template"].count("/"), got[301]["template"].count("/")) == (2, 3)


def test_a_few_ruled_pages_do_not_reject_the_unruled_ones(spark):
    """Not by a wildcard over rare siblings, nor by a branch of which a few pages in a thousand are labelled."""
    names = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(98)]
    rows = [(i, f"http://h.net/{names[i % 98]}/page") for i in range(980)] + [(2000 + i, f"http://h.net/{lang}/page") for i, lang in enumerate(["es"] * 3 + ["fr"])]
    rows += [(3000 + i, f"http://k.org/docs/{'x' if i < 3 else ''}{i}") for i in range(200)]
    setting = urls.Settings(rules=(*urls.RULES, ("block", "k.org/docs/x")))
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), setting).collect()}
    assert {got[i]["verdict"] for i in range(980)} == {"allow"} and {got[i]["template"] for i in range(980)} == {"h.net/*/page"}
    assert {got[2000 + i]["verdict"] for i in range(4)} == {"block"} and got[2000]["template"] != "h.net/*/page"
    assert [got[3000 + i]["verdict"] for i in range(200)] == ["block"] * 3 + ["allow"] * 197


def test_urls_hard_tables(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a", "t", 1), (1, "http://h.org/a", "t", 1), (None, None, None, None)],
                                  "page_id long, url string, template string, n int")
    assert urls.judge(pages).count() == 3 and urls.judge(pages.limit(0)).count() == 0


def test_urls_stay_in_the_jvm(spark, tables):
    plan = urls.judge(tables("pages"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc_offsets_and_lengths(spark, tables):
    rows = fixity.records(tables("pages")).orderBy("archive", "offset").collect()
    at = {}
    for r in rows:
        assert r["offset"] == at.get(r["archive"], 0) and r["length"] == len(r["content"])
        at[r["archive"]] = r["offset"] + r["length"]
    assert len(rows) == tables("pages").count()


@pytest.mark.parametrize("leaf, fan", [(64, 2), (1 << 16, 16)])
def test_audit_equals_comparing_every_record(spark, leaf, fan):
    rng = random.Random(leaf)
    left, right, want = [], [], set()
    for archive in range(3):
        at = 0
        for _ in range(150):
            body = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40)))
            turn = rng.random() if archive else 1
            left.append((str(archive), at, len(body), bytearray(body)))
            if turn < 0.05:
                want.add((str(archive), at, "missing"))
            elif turn < 0.1:
                right.append((str(archive), at, len(body), bytearray(b"?" + body)))
                want.add((str(archive), at, "changed"))
            else:
                right.append((str(archive), at, len(body), bytearray(body)))
            at += len(body)
    right.append(("9", 5, 1, bytearray(b"x")))
    want.add(("9", 5, "extra"))
    shape = "archive string, offset long, length long, content binary"
    found = fixity.audit(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), fixity.Settings(leaf_bytes=leaf, fan_out=fan))
    assert {(r["archive"], r["offset"], r["kind"]) for r in found.collect()} == want


def test_fixity_hard_tables(spark):
    pages = spark.createDataFrame([(1, "u", "h", "x"), (1, "u", "h", "x"), (None, None, None, None), (2, None, "", "y"), (3, "u", "w" * 300_000, "z")],
                                  "page_id long, url string, html string, offset string")
    whole = fixity.records(pages)
    assert whole.count() == 5
    assert fixity.audit(whole, whole).count() == 0
    empty = whole.limit(0)
    assert fixity.audit(empty, empty).count() == 0
    assert {r["kind"] for r in fixity.audit(whole, empty).collect()} == {"missing"}
