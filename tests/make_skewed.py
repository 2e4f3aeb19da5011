"""Write a copy of the tables in which one key of each kind holds about a third of the rows.

usage: python tests/make_skewed.py /root/testdata/sf0.001 /tmp/run-XXXXXX
"""

import sys

import duckdb

REPLACE = {
    "lineitem": "CASE WHEN hash(l_partkey, l_linenumber) % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey, "
                "CASE WHEN hash(l_orderkey, l_suppkey) % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey, "
                "CASE WHEN hash(l_orderkey, l_partkey) % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey",
    "orders": "CASE WHEN hash(o_orderkey) % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey",
    "events": "CASE WHEN hash(event_id) % 3 = 0 THEN 7 ELSE user_id END AS user_id",
    "customer": "CASE WHEN hash(c_custkey) % 3 = 0 THEN 4 ELSE c_nationkey END AS c_nationkey",
    "part": "CASE WHEN hash(p_partkey) % 3 = 0 THEN 6 ELSE p_size END AS p_size, CASE WHEN hash(p_partkey) % 3 = 0 THEN 'Brand#1' ELSE p_brand END AS p_brand",
    "documents": "CASE WHEN hash(doc_id) % 3 = 0 THEN 'same text token = abcdef123456' ELSE text END AS text, "
                 "CASE WHEN hash(doc_id) % 3 = 0 THEN 'src0' ELSE source END AS source",
    "pages": "CASE WHEN hash(page_id) % 3 = 0 THEN 'https://hot.example.com/a' ELSE url END AS url",
}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

if __name__ == "__main__":
    src, dst = sys.argv[1:3]
    con = duckdb.connect()
    for t in TABLES:
        cols = f"* REPLACE ({REPLACE[t]})" if t in REPLACE else "*"
        con.execute(f"COPY (SELECT {cols} FROM '{src}/{t}.parquet') TO '{dst}/{t}.parquet' (FORMAT parquet)")
