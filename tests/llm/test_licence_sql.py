"""The SQL of the licence scan on rows that the tables do not hold."""

import duckdb
from pyspark.sql import functions as F

from boreflow.llm import licenses, queries


def test_licence_sql_of_awkward_rows(spark, tmp_path):
    mit, bsd = licenses.KNOWN["MIT"][0], licenses.KNOWN["BSD-2-Clause"][0]
    texts = [
        None, "", "\n\n", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit, "ISC License\n" + licenses.KNOWN["ISC"][0].upper(),
        mit.replace(" ", "\n"), bsd + "\nCopyright 2019 the authors", "non-com-mer-cial a-b-c-d\nLicensed under CC BY-NC 4.0.\n", "-\n" * 3000,
        "Released under the MIT License.\nx\nLICENSED UNDER THE MIT LICENCE!\nSPDX-License-Identifier: Apache-2.0\n", "all rights\nreserved.",
        "The copyright holders\n© 2001 É. Ünal\n(c) copyright me\nend", "x" * 200_000 + " licence",
    ]
    rows = [(i % 11, t, "clash", "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash", "clash")] * 2 + [(None, texts[9], "clash", "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, row string")
    for name, part in (("rows", df), ("none", df.where(F.lit(False)))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        want = con.execute(queries.ORACLE_SQL["op7_licenses"]).fetchall()
        got = queries.op7_licenses(spark, f"{tmp_path}/{name}").select("doc_id", "digest", "license", "n_lines", "line_licenses").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        assert len(got) == part.count()
