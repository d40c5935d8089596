"""Queries against their SQL on small tables that have what the driver's tables lack."""

import duckdb
from samples import prose

from quire.llm import pii, quality, secret_scan


def both(spark, tmp_path, query, sql, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(sql)
    names = sorted(want.columns)
    got = query(spark, str(tmp_path))
    assert sorted(got.columns) == names
    order = ", ".join(names)
    return sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))), sorted(map(str, con.sql(f"select {order} from want").fetchall()))


def test_disclosing_terms(spark, tmp_path):
    rows = [(i, f"{prose(i, 9)} Zanzibar, ann@x.org (éclair) {prose(i + 500, 12)} common", "en") for i in range(6)]
    rows += [(100 + i, f"{prose(i + 20, 14)} common words bob{i}@y.org common", "en") for i in range(150)] + [(300, None, None), (301, "", "en"), (302, rows[0][1], "en"), (303, "Zanzibar far away", "en")]
    got, want = both(spark, tmp_path, pii.op10_pii, pii.ORACLES["op10_pii"], rows)
    assert got == want and sum("term:" in x for x in got) == 7 and "term:0:" not in "".join(x for x in got if ", 303," in x)


def test_secrets_of_all_kinds(spark, tmp_path):
    rows = [(1, "é Secret = 'abcdefgh' ghp_" + "a" * 36 + " eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "en"), (2, "ftp://me:pw@host AIza" + "c" * 35 + " xoxb-1234567890 rk_live_" + "b" * 20, "en"), (3, "-----BEGIN RSA PRIVATE KEY----- " + "0" * 33, "fr"), (4, None, "en")]
    got, want = both(spark, tmp_path, secret_scan.op9_secret_scan, secret_scan.ORACLES["op9_secret_scan"], rows)
    assert got == want and sum(k in "".join(got) for k in ("git_token", "jwt", "url_login", "maps_key", "chat_token", "pay_key", "private_key")) == 7


def test_quality_with_odd_languages(spark, tmp_path):
    rows = [(i, f"{prose(i, 60)} the of and {prose(i + 50, 60)}\n\n{prose(i, 4)}\n{prose(i, 4)}", ("en", "xx", None)[i % 3]) for i in range(12)] + [(50, None, "en"), (51, "", None), (52, " | ".join(prose(3, 90).split()), "en")]
    got, want = both(spark, tmp_path, quality.op4_quality_rules, quality.ORACLES["op4_quality_rules"], rows)
    assert got == want
