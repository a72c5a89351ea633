"""Inputs that Spark and DuckDB both build from the driver's tables, in SQL that both read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: A weighing for each order: key, date parts (28 years on), weights of which one in eleven doesn't balance, plate digits.
WEIGHINGS = """
SELECT o_orderkey AS k, CAST(o_orderkey AS STRING) AS doc_id, CAST(year(o_orderdate) + 28 AS STRING) AS y,
  lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS d,
  substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o_orderdate) * 3 - 2 AS INT), 3) AS mon,
  CAST(5000 + o_orderkey * 37 % 9000 AS INT) AS tare, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 35000 + o_orderkey * 37 % 9000 ELSE 3000 + o_orderkey * 53 % 20000 END AS INT) AS net,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 40500 + 2 * (o_orderkey * 37 % 9000) ELSE 8000 + o_orderkey * 37 % 9000 + o_orderkey * 53 % 20000 END AS INT) AS total,
  CAST(10 + o_orderkey % 90 AS STRING) || '가00' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') AS plate,
  lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') AS tail, o_totalprice AS price, o_orderstatus AS status
FROM {orders}
"""

#: A ticket of eighteen boxed words for each order.
TICKET_WORDS = f"""
WITH t AS ({WEIGHINGS}), w AS (
  SELECT doc_id, 0 AS word_idx, '계량증명서' AS text, 100 AS x0, 300 AS x1, 0 AS line FROM t
  UNION ALL SELECT doc_id, 1, '날짜:', 10, 70, 1 FROM t UNION ALL SELECT doc_id, 2, y || '-' || m || '-' || d, 80, 200, 1 FROM t
  UNION ALL SELECT doc_id, 3, '차량번호:', 10, 90, 2 FROM t UNION ALL SELECT doc_id, 4, plate, 100, 200, 2 FROM t
  UNION ALL SELECT doc_id, 5, '거래처:', 10, 80, 3 FROM t UNION ALL SELECT doc_id, 6, '대한산업', 90, 180, 3 FROM t
  UNION ALL SELECT doc_id, 7, '품명:', 10, 60, 4 FROM t UNION ALL SELECT doc_id, 8, '고철', 70, 120, 4 FROM t
  UNION ALL SELECT doc_id, 9, '총중량:', 10, 80, 5 FROM t UNION ALL SELECT doc_id, 10, CAST(total AS STRING), 90, 150, 5 FROM t UNION ALL SELECT doc_id, 11, 'kg', 160, 180, 5 FROM t
  UNION ALL SELECT doc_id, 12, '공차중량:', 10, 95, 6 FROM t UNION ALL SELECT doc_id, 13, CAST(tare AS STRING), 105, 150, 6 FROM t UNION ALL SELECT doc_id, 14, 'kg', 160, 180, 6 FROM t
  UNION ALL SELECT doc_id, 15, '실중량:', 10, 80, 7 FROM t UNION ALL SELECT doc_id, 16, CAST(net AS STRING), 90, 150, 7 FROM t UNION ALL SELECT doc_id, 17, 'kg', 160, 180, 7 FROM t)
SELECT doc_id, word_idx, text, CAST(x0 AS DOUBLE) AS x_min, CAST(10 + 70 * line AS DOUBLE) AS y_min, CAST(x1 AS DOUBLE) AS x_max, CAST(30 + 70 * line AS DOUBLE) AS y_max, CAST(0.9 AS DOUBLE) AS confidence FROM w
"""

#: TICKET_WORDS in the row of its order: (text, left, right, line) of each word, by the columns of WEIGHINGS.
TICKET = (
    ("'계량증명서'", 100, 300, 0), ("'날짜:'", 10, 70, 1), ("y || '-' || m || '-' || d", 80, 200, 1), ("'차량번호:'", 10, 90, 2), ("plate", 100, 200, 2), ("'거래처:'", 10, 80, 3), ("'대한산업'", 90, 180, 3),
    ("'품명:'", 10, 60, 4), ("'고철'", 70, 120, 4), ("'총중량:'", 10, 80, 5), ("CAST(total AS STRING)", 90, 150, 5), ("'kg'", 160, 180, 5), ("'공차중량:'", 10, 95, 6), ("CAST(tare AS STRING)", 105, 150, 6),
    ("'kg'", 160, 180, 6), ("'실중량:'", 10, 80, 7), ("CAST(net AS STRING)", 90, 150, 7), ("'kg'", 160, 180, 7),
)

#: The text of a ticket for each order.
TICKET_TEXTS = f"""
WITH t AS ({WEIGHINGS})
SELECT doc_id, '계량증명서' || chr(10) || '날짜: ' || y || '-' || m || '-' || d || chr(10) || '차량번호: ' || plate || chr(10) || '거래처: 대한산업' || chr(10) || '품명: 고철' || chr(10)
  || '구분: ' || CASE WHEN k % 2 = 0 THEN '입고' ELSE '출고' END || chr(10) || '총중량: ' || CAST(total AS STRING) || ' kg' || chr(10) || '공차중량: ' || CAST(tare AS STRING) || ' kg' || chr(10)
  || '실중량: ' || CAST(net AS STRING) || ' kg' || chr(10) || 'TEL 031-123-0' || tail || chr(10) || 'GPS 37.234' || tail || ', 127.345' || tail AS text
FROM t
"""

#: The lines of every order as words: a quantity with kg, with t, or a bare number, beside each other on lines of three.
LINE_WORDS = """
WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS i FROM {lineitem}),
g AS (SELECT CAST(l_orderkey AS STRING) AS doc_id, i AS word_idx, l_returnflag AS flag, CAST(floor(l_quantity) AS INT) AS quantity, CAST(floor(l_extendedprice / 10) AS INT) AS number,
  i % 3 * 120 + CAST(l_suppkey % 7 AS INT) AS x, CAST(floor(i / 3) AS INT) * 40 + CAST(l_partkey % 5 AS INT) AS y, 60 + CAST(l_partkey % 11 AS INT) AS w FROM n)
SELECT doc_id, word_idx, CASE flag WHEN 'A' THEN CAST(quantity * 100 AS STRING) || 'kg' WHEN 'R' THEN CAST(quantity AS STRING) || '.5 t' ELSE CAST(number AS STRING) END AS text,
  CAST(x AS DOUBLE) AS x_min, CAST(y AS DOUBLE) AS y_min, CAST(x + w AS DOUBLE) AS x_max, CAST(y + 16 AS DOUBLE) AS y_max, CAST(0.9 AS DOUBLE) AS confidence, flag, quantity, number
FROM g
"""


#: A page for each customer, in five shapes: who issued it and whose it is are told by place, honorific or sign; phones stand behind, beside or in a label.
NAMED_WORDS = """
WITH c AS (SELECT CAST(c_custkey AS STRING) AS doc_id, c_custkey % 5 AS shape, lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') AS tail,
  CASE c_custkey % 3 WHEN 0 THEN '한빛' WHEN 1 THEN '푸른' ELSE '동해' END AS name FROM {customer}),
w AS (
  SELECT doc_id, 0 AS word_idx, '계량증명서' AS text, 100 AS x0, 300 AS x1, 0 AS line FROM c
  UNION ALL SELECT doc_id, 1, 'Hanbit', 10, 80, 1 FROM c WHERE shape = 1 UNION ALL SELECT doc_id, 2, 'ENG', 90, 130, 1 FROM c WHERE shape = 1
  UNION ALL SELECT doc_id, 3, '(주)' || name || '금속', 10, 150, 1 FROM c WHERE shape = 4
  UNION ALL SELECT doc_id, 4, '대한산업', 10, 80, 4 FROM c WHERE shape IN (0, 2) UNION ALL SELECT doc_id, 5, '귀하', 90, 130, 4 FROM c WHERE shape IN (0, 2)
  UNION ALL SELECT doc_id, 6, '02-555-0' || tail, 10, 120, 5 FROM c WHERE shape = 1 UNION ALL SELECT doc_id, 7, '-', 10, 20, 5 FROM c WHERE shape <> 1
  UNION ALL SELECT doc_id, 8, 'TEL031-123-0' || tail, 10, 150, 7 FROM c WHERE shape = 1
  UNION ALL SELECT doc_id, 9, '전화', 10, 50, 7 FROM c WHERE shape = 2 UNION ALL SELECT doc_id, 10, '(031)555-0' || tail, 60, 160, 7 FROM c WHERE shape = 2
  UNION ALL SELECT doc_id, 11, name, 10, 60, 8 FROM c WHERE shape = 0 UNION ALL SELECT doc_id, 12, '환경', 70, 120, 8 FROM c WHERE shape = 0
  UNION ALL SELECT doc_id, 13, 'TEL', 130, 160, 8 FROM c WHERE shape = 0 UNION ALL SELECT doc_id, 14, '031-123-0' || tail, 170, 270, 8 FROM c WHERE shape = 0
  UNION ALL SELECT doc_id, 15, '(주)' || name || '금속', 10, 150, 8 FROM c WHERE shape IN (3, 4)
  UNION ALL SELECT doc_id, 16, '-', 10, 20, 10 FROM c)
SELECT doc_id, word_idx, text, CAST(x0 AS DOUBLE) AS x_min, CAST(10 + 70 * line AS DOUBLE) AS y_min, CAST(x1 AS DOUBLE) AS x_max, CAST(30 + 70 * line AS DOUBLE) AS y_max, CAST(0.9 AS DOUBLE) AS confidence FROM w
"""

#: A label, a quantity and its unit for each customer: tonnes, thousands, a unit out of reach, too small a number, a half.
QUANTITY_WORDS = """
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS doc_id, c_custkey % 5 AS shape FROM {customer}),
w AS (SELECT doc_id, 0 AS word_idx, '총중량' AS text, 10 AS x0, 80 AS x1 FROM c
  UNION ALL SELECT doc_id, 1, CASE shape WHEN 0 THEN CAST(10 + k % 50 AS STRING) || '.5' WHEN 1 THEN CAST(1 + k % 9 AS STRING) || ',' || lpad(CAST(k % 1000 AS STRING), 3, '0')
    WHEN 2 THEN CAST(10 + k % 80 AS STRING) WHEN 3 THEN '9' ELSE CAST(100 + k % 100 AS STRING) || '.5' END, 90, 150 FROM c
  UNION ALL SELECT doc_id, 2, CASE WHEN shape IN (0, 2) THEN 't' ELSE 'kg' END, CASE WHEN shape = 2 THEN 190 ELSE 160 END, 200 FROM c)
SELECT doc_id, word_idx, text, CAST(x0 AS DOUBLE) AS x_min, CAST(10 AS DOUBLE) AS y_min, CAST(x1 AS DOUBLE) AS x_max, CAST(30 AS DOUBLE) AS y_max, CAST(0.9 AS DOUBLE) AS confidence FROM w
"""

#: Company and issuer as read, for each supplier: a supplier named as company, one firm written in two ways, two firms, no company.
NAMED_PARTIES = """
SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'Supplier : Metal ' || CAST(s_suppkey AS STRING) WHEN 1 THEN '(주)한빛' || CAST(s_suppkey AS STRING) WHEN 2 THEN '한빛' || CAST(s_suppkey AS STRING) END AS company,
  CASE s_suppkey % 4 WHEN 0 THEN '동해' WHEN 1 THEN '한빛 ' || CAST(s_suppkey AS STRING) || '.' ELSE '푸른' || CAST(s_suppkey AS STRING) END AS issuer FROM {supplier}
"""

#: Decomposed text for each customer: a syllable in two or three conjoining letters, and a letter with a combining accent.
DECOMPOSED = """
SELECT c_custkey AS k, substr('\u1100\u1102\u1103\u1105\u1106\u1107\u1109', CAST(1 + c_custkey % 7 AS INT), 1) || substr('\u1161\u1165\u1169\u116e\u1175', CAST(1 + c_custkey % 5 AS INT), 1)
  || CASE WHEN c_custkey % 2 = 0 THEN substr('\u11a8\u11ab\u11af', CAST(1 + c_custkey % 3 AS INT), 1) ELSE '' END || ' e' || '\u0301' || ' ' || c_name AS text FROM {customer}
"""


#: Bytes of a table's files that a task gets, at most.
TASK_BYTES = 4 << 20


def tasks(size: int, cores: int) -> int:
    """To how many tasks a table of so many bytes is dealt: four a core, or more of TASK_BYTES each."""
    return max(4 * cores, -(-size // TASK_BYTES))


def source(spark: SparkSession, sf_dir: str, table: str, *by: Column) -> DataFrame:
    """A table, dealt to tasks, by the values of `by` if given. Its rows take little room and long to work on, and a scan is split by files and row groups alone: a file of few groups would keep
    few cores busy, however large it is. So no task's share grows with the table; only the columns that are read are shuffled."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(tasks(size, spark.sparkContext.defaultParallelism), *by)


def frame(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """An adapter's rows in Spark."""
    return spark.sql(sql, **{t: source(spark, sf_dir, t) for t in tables})


def duck(sql: str, *tables: str) -> str:
    """An adapter's SQL for DuckDB."""
    return sql.format(**{t: t for t in tables})
