"""The jobs as queries over the driver's tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from jobs import corpus_graph, ensemble_report
from parcela.queries import CUSTOMER
from parcela.sources.shared import shared_dir


def new_folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/jobs/{job}-{uuid4().hex}"


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "ensemble_report")
    ensemble_report.run(spark, sf_dir, folder)
    return ensemble_report.run(spark, sf_dir, folder)


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "corpus_graph")
    corpus_graph.run(spark, sf_dir, f"{folder}/output", f"{folder}/checkpoint")
    return corpus_graph.run(spark, sf_dir, f"{folder}/output", f"{folder}/checkpoint")


QUERIES = {"job1_ensemble_report": job1, "job2_corpus_graph": job2}

REPORT = f"""WITH {CUSTOMER},
dp AS (SELECT plan_id, district, sum(pop)::DOUBLE AS pop, count(*)::DOUBLE AS nodes, sum(area) AS area FROM plans JOIN nodes ON id = node GROUP BY 1, 2),
dev AS (SELECT plan_id, district, coalesce(pop / nullif(avg(pop) OVER (PARTITION BY plan_id), 0) - 1, 0) AS off FROM dp),
cutp AS (SELECT plan_id, d, sum(length) AS c FROM (SELECT plan_id, d1 AS d, length FROM crossing UNION ALL SELECT plan_id, d2, length FROM crossing) GROUP BY 1, 2),
vs AS (SELECT plan_id, district, o_orderpriority AS election, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM plans JOIN orders ON o_custkey = node GROUP BY 1, 2, 3),
margins AS (SELECT plan_id, district, election, 100.0::DOUBLE * f / nullif(f + o, 0) AS margin FROM vs),
split AS (SELECT plan_id, sum((k > 1)::INT) AS n FROM (SELECT plan_id, nation, count(DISTINCT district) FILTER (pop > 0) AS k FROM plans JOIN nodes ON id = node GROUP BY 1, 2) GROUP BY 1),
long AS (
  SELECT plan_id, district, NULL AS election, pop AS value, 'population' AS measure FROM dp
  UNION ALL SELECT plan_id, district, NULL, off, 'deviation' FROM dev
  UNION ALL SELECT plan_id, district, NULL, nodes, 'nodes' FROM dp
  UNION ALL SELECT plan_id, NULL, NULL, bool_and(abs(off) <= 0.05)::INT::DOUBLE, 'balanced' FROM dev GROUP BY 1
  UNION ALL SELECT plan_id, NULL, NULL, coalesce(sum(connections), 0)::DOUBLE, 'cut_edges' FROM crossing GROUP BY 1
  UNION ALL SELECT dp.plan_id, district, NULL, coalesce(c, 0) * coalesce(c, 0) / area, 'compactness' FROM dp LEFT JOIN cutp ON cutp.plan_id = dp.plan_id AND d = district
  UNION ALL SELECT plan_id, district, election, margin, 'margin' FROM margins
  UNION ALL SELECT plan_id, NULL, election, sum((coalesce(margin, 0) > 50)::INT)::DOUBLE, 'seats' FROM margins GROUP BY 1, 3
  UNION ALL SELECT plan_id, NULL, NULL, n::DOUBLE, 'split_units' FROM split)
SELECT plan_id::VARCHAR AS plan_id, district::INT AS district, election::VARCHAR AS election, value, measure FROM long
"""

GRAPH = r"""
WITH d AS (SELECT coalesce(lang, 'none') AS lang, coalesce(lang, 'none') || '/' || coalesce(source, 'none') AS unit, text FROM documents),
l AS (SELECT lang, unit, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT DISTINCT lang, unit, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
long AS (SELECT * FROM k WHERE length(key) >= 20),
e AS (SELECT a.lang AS la, b.lang AS lb, a.unit AS a, b.unit AS b, count(*)::BIGINT AS lines FROM long a JOIN long b ON a.key = b.key AND a.unit < b.unit GROUP BY 1, 2, 3, 4)
SELECT unit AS unit_a, NULL::VARCHAR AS unit_b, count(*)::BIGINT AS documents, sum(coalesce(length(text), 0))::BIGINT AS characters, NULL::BIGINT AS lines, 'node' AS kind, 2 AS level FROM d GROUP BY unit
UNION ALL SELECT lang, NULL, count(*)::BIGINT, sum(coalesce(length(text), 0))::BIGINT, NULL, 'node', 1 FROM d GROUP BY lang
UNION ALL SELECT a, b, NULL, NULL, lines, 'edge', 2 FROM e
UNION ALL SELECT least(la, lb), greatest(la, lb), NULL, NULL, sum(lines)::BIGINT, 'edge', 1 FROM e WHERE la <> lb GROUP BY 1, 2
"""

SQL = {"job1_ensemble_report": REPORT, "job2_corpus_graph": GRAPH}
