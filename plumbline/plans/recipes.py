"""Ready-made analytical statements for a table with bound roles, in SQL that Spark and DuckDB both read."""

from __future__ import annotations


def recipes(table: str, date: str, value: str, dim: str, entity: str, order: str) -> dict[str, str]:
    """name -> statement. Values are summed as decimals, so both engines give the same digits."""
    v = f"CAST({value} AS DECIMAL(18,2))"
    month = f"CAST(date_trunc('month', {date}) AS DATE)"
    return {
        "pop": f"WITH m AS (SELECT {month} AS period, sum({v}) AS total FROM {table} GROUP BY 1) SELECT period, total, lag(total) OVER (ORDER BY period) AS previous, CAST(100 * (total - lag(total) OVER (ORDER BY period)) AS DOUBLE) / CAST(nullif(lag(total) OVER (ORDER BY period), 0) AS DOUBLE) AS growth FROM m",
        "running": f"WITH m AS (SELECT {month} AS period, sum({v}) AS total FROM {table} GROUP BY 1) SELECT period, total, sum(total) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS running, CAST(sum(total) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_average FROM m",
        "topn": f"SELECT period, segment, total, place FROM (SELECT {month} AS period, {dim} AS segment, sum({v}) AS total, CAST(row_number() OVER (PARTITION BY {month} ORDER BY sum({v}) DESC, {dim}) AS BIGINT) AS place FROM {table} GROUP BY 1, 2) t WHERE place <= 3",
        "pareto": f"WITH e AS (SELECT {dim} AS segment, sum({v}) AS total FROM {table} GROUP BY 1) SELECT segment, total, CAST(100 * total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS share, CAST(100 * sum(total) OVER (ORDER BY total DESC, segment ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS cumulative FROM e",
        "cohort": f"WITH f AS (SELECT {entity} AS e, min({month}) AS cohort FROM {table} GROUP BY 1), a AS (SELECT DISTINCT {entity} AS e, {month} AS m FROM {table}) SELECT cohort, CAST((year(m) * 12 + month(m)) - (year(cohort) * 12 + month(cohort)) AS BIGINT) AS step, count(DISTINCT a.e) AS active, first_value(count(DISTINCT a.e)) OVER (PARTITION BY cohort ORDER BY CAST((year(m) * 12 + month(m)) - (year(cohort) * 12 + month(cohort)) AS BIGINT)) AS size FROM f JOIN a ON f.e = a.e GROUP BY 1, 2, m",
        "groupingsets": f"SELECT {dim} AS segment, CAST(year({date}) AS BIGINT) AS yr, sum({v}) AS total, CAST(grouping({dim}) AS BIGINT) AS all_segments FROM {table} GROUP BY GROUPING SETS (({dim}, year({date})), ({dim}), ())",
    }


def quantiles(table: str, value: str, dim: str) -> tuple[str, str]:
    """The distribution recipe for Spark and for DuckDB."""
    shape = "SELECT {d} AS segment, count(*) AS n, {q} FROM {t} GROUP BY 1"
    cut = (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))
    return shape.format(d=dim, t=table, q=", ".join(f"round(percentile({value}, {p}), 4) AS {n}" for n, p in cut)), shape.format(d=dim, t=table, q=", ".join(f"round(quantile_cont({value}, {p}), 4) AS {n}" for n, p in cut))
