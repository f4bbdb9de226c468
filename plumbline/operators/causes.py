"""Why a KPI moved against a comparable period: seasonal baselines, circular dimensions, evidence level by level.

The rows of both periods are scanned once for each level of the tree. A level's moments (rows, sums, squares and weights by segment and
period) are all that is kept of them; a dimension has `levels` segments at most, so what reaches the driver is bounded by dimensions
times segments. Below the first level only rows of open nodes are read, by a join with the few nodes that are worth opening.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import in_period, ratio
from plumbline.functions.stats import Moments, benjamini_hochberg, poisson_rates, two_proportions, welch

# Dimensions have 2 to 60 segments; a child holds 8 % of its parent's change, a node is opened from 10 %.
LEVELS = (2, 60)
OPEN, CHILD, CHILDREN, OPENED = 10.0, 8.0, 4, 3
# A KPI that moved less than 3 % is no companion of a change.
COMPANION = 3.0


@dataclass(frozen=True)
class Spans:
    """Two half-open ranges of time, and how they were chosen."""

    current: tuple
    baseline: tuple
    comparison: str

    def now(self, date: str) -> Column:
        return in_period(F.col(date), *self.current)

    def then(self, date: str) -> Column:
        return in_period(F.col(date), *self.baseline)


_STEP = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def compared(df: DataFrame, date: str, grain: str, cycle: int | None = None) -> Spans | None:
    """The last period and, of the periods that have rows, the one a cycle before it; the one before where there is no such period. None with one period only."""
    start = F.date_trunc(grain, F.col(date))
    steps = (cycle or 1) + 1
    held = df.where(F.col(date).isNotNull()).groupBy(start.alias("a")).agg(F.lit(1)).select("a", (F.col("a") + F.expr(f"INTERVAL {_STEP[grain]}")).alias("z"))
    last = [(r["a"], r["z"]) for r in held.orderBy(F.desc("a")).limit(steps).collect()]
    if len(last) < 2:
        return None
    seasonal = cycle is not None and cycle > 1 and len(last) == steps
    return Spans(last[0], last[-1] if seasonal else last[1], "one cycle before" if seasonal else "the period before")


def circular(df: DataFrame, dims: list[str], sources: list[Column]) -> DataFrame:
    """(dimension, segments, circular): dimensions that only restate a column the KPI is made of.

    Such a dimension is a function of that column: the column's ranges in its segments do not meet (a flag by itself, an amount
    by its bands). One scan and one aggregation by segment for all dimensions and sources.
    """
    pieces = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims]
    tall = df.select(F.explode(F.array(*pieces)).alias("_s"), *[s.cast("double").alias(f"_v{i}") for i, s in enumerate(sources)]).where("_s.segment IS NOT NULL")
    held = tall.groupBy("_s.dimension", "_s.segment").agg(*[f(f"_v{i}").alias(f"{n}{i}") for i in range(len(sources)) for n, f in (("low", F.min), ("high", F.max))])
    for i in range(len(sources)):
        w = Window.partitionBy("dimension").orderBy(F.col(f"low{i}").asc_nulls_last(), F.col(f"high{i}"))
        held = held.withColumn(f"apart{i}", F.coalesce(F.col(f"low{i}") > F.lag(f"high{i}").over(w), F.lag("segment").over(w).isNull()))
    some = F.greatest(F.lit(False), F.lit(False), *[F.bool_and(f"apart{i}") for i in range(len(sources))])
    return held.groupBy("dimension").agg(F.count(F.lit(1)).alias("segments"), some.alias("meets")).select("dimension", "segments", (F.col("meets") & (F.col("segments") > 1)).alias("circular"))


def moments(df: DataFrame, dims: list[str], date: str, spans: Spans, value: Column, weight: Column | None = None, opened: DataFrame | None = None, path: tuple[str, ...] = ()) -> DataFrame:
    """(the path's segments p1..., dimension, segment, n0 n1, s0 s1, q0 q1, w0 w1), one scan for all dimensions.

    `opened` holds the nodes to look into: a column for each dimension of `path`. It is small (OPENED, CHILDREN) and sent to every task.
    """
    keys = [f"p{i}" for i in range(1, len(path) + 1)]
    now, then = spans.now(date), spans.then(date)
    cut = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims]
    rows = df.where(now | then).select(*[F.col(d).cast("string").alias(k) for d, k in zip(path, keys)], now.alias("_now"), value.cast("double").alias("_v"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"), F.array(*cut).alias("_s"))
    if opened is not None:
        rows = rows.join(F.broadcast(opened.select(*keys)), keys)
    tall = rows.withColumn("_s", F.explode("_s")).where("_s.segment IS NOT NULL")
    sides = (("0", ~F.col("_now")), ("1", F.col("_now")))
    made = []
    for k, side in sides:
        pick = lambda c, s=side: F.coalesce(F.sum(F.when(s, c)), F.lit(0.0))
        made += [F.count_if(side).alias(f"n{k}"), pick(F.col("_v")).alias(f"s{k}"), pick(F.col("_v") * F.col("_v")).alias(f"q{k}"), pick(F.col("_w")).alias(f"w{k}")]
    return tall.groupBy(*keys, F.col("_s.dimension").alias("dimension"), F.col("_s.segment").alias("segment")).agg(*made)


def decompose(m: DataFrame, additive: bool = True, support: int = 15, path: tuple[str, ...] = ()) -> DataFrame:
    """Adds what each segment brought to its parent's change, and what it would have brought had all moved alike.

    value0, value1, delta (of a ratio: rate_effect + mix_effect), total (the parent's change), contribution in percent, expected (by share of the
    baseline's size; of a ratio: of its weight), excess, growth_gap in percentage points (null where the segment stopped or is new), shares.
    """
    w = Window.partitionBy(*[f"p{i}" for i in range(1, len(path) + 1)], "dimension")
    share = lambda k: ratio(F.col(f"w{k}"), F.sum(f"w{k}").over(w))
    m = m.withColumns({"share0": share(0), "share1": share(1)}) if not additive else m.withColumns({f"share{k}": ratio(F.col(f"s{k}"), F.sum(f"s{k}").over(w)) for k in (0, 1)})
    if additive:
        m = m.withColumns({f"value{k}": F.when(F.col(f"n{k}") > 0, F.col(f"s{k}")) for k in (0, 1)})
        m = m.withColumns({"rate_effect": F.lit(None).cast("double"), "mix_effect": F.lit(None).cast("double"), "delta": F.col("s1") - F.col("s0")})
    else:
        m = m.withColumns({f"value{k}": ratio(F.col(f"s{k}"), F.col(f"w{k}")) for k in (0, 1)}).withColumn("_all", ratio(F.sum("s0").over(w), F.sum("w0").over(w)))
        m = m.withColumns({"rate_effect": F.coalesce("share1", F.lit(0.0)) * (F.col("value1") - F.col("value0")), "mix_effect": (F.coalesce("share1", F.lit(0.0)) - F.coalesce("share0", F.lit(0.0))) * (F.col("value0") - F.col("_all"))})
        m = m.withColumn("delta", F.coalesce(F.col("rate_effect") + F.col("mix_effect"), F.coalesce("value1", F.lit(0.0)) - F.coalesce("value0", F.lit(0.0)))).drop("_all")
    m = m.where(F.col("n0") + F.col("n1") >= support).withColumn("total", F.sum("delta").over(w))
    size = ratio(F.abs(F.coalesce("value0", F.lit(0.0))), F.sum(F.abs(F.coalesce("value0", F.lit(0.0)))).over(w)) if additive else F.col("share0")
    whole = ratio(F.sum(F.coalesce("value1", F.lit(0.0))).over(w), F.sum(F.coalesce("value0", F.lit(0.0))).over(w))
    m = m.withColumn("expected", F.coalesce(size, F.lit(0.0)) * F.col("total")).withColumn("excess", F.col("delta") - F.col("expected"))
    return m.withColumns({"contribution": ratio(F.col("delta"), F.col("total"), 100), "growth_gap": (ratio(F.col("value1"), F.col("value0")) - F.coalesce(whole, F.lit(1.0))) * 100})


def drill_down(df: DataFrame, path: list[str], date: str, spans: Spans, value: Column, opened: int = OPENED, support: int = 15) -> DataFrame:
    """(level, p1..., segment, value0, value1, delta, contribution, expected, excess): the nodes along given dimensions.

    Level 1 opens its `opened` largest nodes of 10 % of the change or more, each level below those of its CHILDREN largest (8 % of the parent's
    change) that hold 10 %. A level is one scan of the rows of open nodes; only what is opened comes back between levels.
    """
    spark, made, frontier = df.sparkSession, [], None
    for level, dim in enumerate(path, 1):
        keys = [f"p{i}" for i in range(1, level)]
        nodes = decompose(moments(df, [dim], date, spans, value, None, frontier, tuple(path[: level - 1])), True, support if level == 1 else max(support // 2, 5), tuple(path[: level - 1]))
        place = F.row_number().over(Window.partitionBy(*keys, "dimension").orderBy(F.desc(F.round(F.abs("contribution"), 6)), "segment"))
        nodes = nodes.withColumn("place", place)
        if level > 1:
            nodes = nodes.where((F.abs("contribution") >= CHILD) & (F.col("place") <= CHILDREN))
        rows = [r.asDict() for r in nodes.collect()]  # at most 60 segments, then CHILDREN of each open node
        made += [(level, *[r[k] for k in keys], *[None] * (len(path) - level), *[r[c] for c in ("segment", "value0", "value1", "delta", "contribution", "expected", "excess")]) for r in rows]
        go_on = [(*[r[k] for k in keys], r["segment"]) for r in rows if abs(r["contribution"] or 0) >= OPEN and (level > 1 or r["place"] <= opened)]
        if not go_on or level == len(path):
            break
        frontier = spark.createDataFrame(go_on, ", ".join(f"p{i} string" for i in range(1, level + 1)))
    parts = [f"p{i} string" for i in range(1, len(path))]
    return spark.createDataFrame(made, ", ".join(["level int", *parts, "segment string", *[f"{c} double" for c in ("value0", "value1", "delta", "contribution", "expected", "excess")]]))


def seasonal_moves(df: DataFrame, dims: list[str], date: str, grain: str, cycle: int, value: Column) -> DataFrame:
    """(period, dimension, segment, baseline, current, delta, expected, excess, contribution) of every period against the one a cycle before it.

    One aggregation by period and segment, joined with itself a cycle later; periods without rows on either side are left out.
    """
    cut = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims]
    tall = df.where(F.col(date).isNotNull()).select(F.date_trunc(grain, F.col(date)).alias("period"), value.alias("_v"), F.explode(F.array(*cut)).alias("_s"))
    sums = tall.groupBy("period", F.col("_s.dimension").alias("dimension"), F.col("_s.segment").alias("segment")).agg(F.sum("_v").alias("v"))
    count, unit = _STEP[grain].split()
    before = sums.withColumnRenamed("v", "baseline").withColumn("period", F.col("period") + F.expr(f"INTERVAL {int(count) * cycle} {unit}"))
    both = sums.withColumnRenamed("v", "current").join(before, ["period", "dimension", "segment"], "full")
    w = Window.partitionBy("period", "dimension")
    both = both.withColumns({"_n1": F.count("current").over(w), "_n0": F.count("baseline").over(w)}).where("_n1 > 0 AND _n0 > 0").fillna(0, ["current", "baseline"])
    both = both.withColumns({"delta": F.col("current") - F.col("baseline"), "_total": F.sum("current").over(w) - F.sum("baseline").over(w), "_size": F.sum(F.abs("baseline")).over(w)})
    both = both.withColumn("expected", F.coalesce(ratio(F.abs("baseline"), F.col("_size")), F.lit(0.0)) * F.col("_total").cast("double"))
    return both.select("period", "dimension", "segment", "baseline", "current", "delta", "expected", (F.col("delta").cast("double") - F.col("expected")).alias("excess"), ratio(F.col("delta"), F.col("_total"), 100).alias("contribution"))


def powers(nodes: DataFrame, path: tuple[str, ...] = ()) -> DataFrame:
    """(path, dimension, segments, dispersion, concentration, coverage) of decomposed nodes."""
    keys = [*[f"p{i}" for i in range(1, len(path) + 1)], "dimension"]
    a = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.abs("excess")).alias("_e"), F.sum(F.abs("delta")).alias("_d"), F.max(F.abs("excess")).alias("_m"), F.abs(F.sum("delta")).alias("_t"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.select(*keys, "segments", F.least(F.lit(1.0), zero(ratio(F.col("_e"), F.col("_d")))).alias("dispersion"), zero(ratio(F.col("_m"), F.col("_e"))).alias("concentration"), zero(ratio(F.col("_t"), F.col("_d"))).alias("coverage"))


def companions(values: DataFrame, but: str) -> DataFrame:
    """(kpi_id, current, baseline, change, exonerated) of rows (kpi_id, current, baseline): other KPIs that did not move explain nothing."""
    change = ratio(F.col("current") - F.col("baseline"), F.abs("baseline"), 100)
    return values.where((F.col("kpi_id") != but) & F.col("current").isNotNull()).withColumn("change", change).where("change IS NOT NULL").withColumn("exonerated", F.abs("change") < COMPANION)


# -- evidence -----------------------------------------------------------------------------------------


def _of(n: float, s: float, q: float, shift: float = 0.0) -> Moments:
    mean = s / n if n else 0.0
    return Moments(n, mean - shift, max(0.0, (q - n * mean * mean) / (n - 1)) if n > 1 else 0.0)


def significance(rows: list[dict], whole: dict, flag: bool, rate: float) -> None:
    """Adds to each segment the least p of the tests against "it moved as the whole did", and whether it stands at the false-discovery rate.

    Volume against the baseline's times overall growth (Poisson), mean against the overall shift of means (Welch), shares of a flag (z).
    """
    growth = whole["n1"] / whole["n0"] if whole["n0"] else 1.0
    shift = (whole["s1"] / whole["n1"] if whole["n1"] else 0.0) - (whole["s0"] / whole["n0"] if whole["n0"] else 0.0)
    for r in rows:
        tried = []
        if r["n0"] > 0 and r["n0"] + r["n1"] >= 10:
            tried.append((poisson_rates(r["n1"], r["n0"] * growth).p, "volume"))
        if not flag and min(r["n0"], r["n1"]) >= 12:
            tried.append((welch(_of(r["n1"], r["s1"], r["q1"], shift), _of(r["n0"], r["s0"], r["q0"])).p, "mean"))
        if flag and min(r["n0"], r["n1"]) > 0:
            tried.append((two_proportions(r["s1"], r["n1"], r["s0"], r["n0"]).p, "share"))
        r["p"], r["test"] = min(tried) if tried else (poisson_rates(r["n1"], max(r["n0"], 1e-9)).p, "volume")
    for r, yes in zip(rows, benjamini_hochberg([r["p"] for r in rows], rate)):
        r["significant"] = bool(yes)


def _severity(contribution: float, change: float, significant: bool) -> str:
    if significant and (contribution >= 40 or change >= 30):
        return "critical"
    if significant and (contribution >= 20 or change >= 15):
        return "high"
    return "medium" if max(contribution, change) >= 10 else "low" if contribution >= 3 else "info"


def _judged(rows: list[dict], whole: dict, parent: float, flag: bool, segments: int, rate: float) -> list[dict]:
    """The nodes of one dimension: those that stand out most are tested, drivers come first."""
    total = sum(r["delta"] for r in rows)
    rows = sorted(rows, key=lambda r: (-round(abs(r["excess"]), 6), r["delta"] * total <= 0, -abs(r["delta"])))[: 2 * segments]
    significance(rows, whole, flag, rate)
    for r in rows:
        r["contribution"] = 100 * r["delta"] / parent if parent else None
        own = r["value1"] - r["value0"] if None not in (r["value1"], r["value0"]) else r["delta"]
        r["change"] = 100 * own / abs(r["value0"]) if r["value0"] else None
        r["role"] = "stable" if not r["delta"] else "driver" if not parent or r["delta"] * parent > 0 else "offset"
        r["severity"] = _severity(abs(r["contribution"] or 0), abs(r["change"] or 0), r["significant"])
    return sorted(rows, key=lambda r: (("driver", "stable", "offset").index(r["role"]), -round(abs(r["excess"] or r["contribution"] or 0), 6), -abs(r["contribution"] or 0)))


def explain(df: DataFrame, dims: list[str], date: str, spans: Spans, value: Column, weight: Column | None = None, sources: list[Column] | None = None, flag: bool = False, others: DataFrame | None = None, kpi_id: str = "", higher_is_better: bool = True, depth: int = 2, segments: int = 6, support: int = 15, rate: float = 0.10) -> dict | None:
    """The evidence tree of the change of sum(value), or of sum(value) / sum(weight) where a weight is given. None without rows on a side.

    sources: what the KPI is made of (`value` itself where not given); dimensions that restate one of them are left out.
    others: rows (kpi_id, current, baseline) of KPIs that may be ruled out. depth: levels of the tree.
    """
    both = df.where(spans.now(date) | spans.then(date))
    found = {r["dimension"]: r for r in circular(both, dims, [value] if sources is None else sources).collect()} if dims else {}
    excluded = [d for d in dims if d in found and found[d]["circular"]]
    usable = [d for d in dims if d in found and d not in excluded and LEVELS[0] <= found[d]["segments"] <= LEVELS[1]]
    whole = moments(df.withColumn("_all", F.lit("all")), ["_all"], date, spans, value, weight).first()
    if whole is None or not whole["n0"] or not whole["n1"]:
        return None
    at = lambda k: whole[f"s{k}"] if weight is None else whole[f"s{k}"] / whole[f"w{k}"] if whole[f"w{k}"] else None
    now, then = at(1), at(0)
    if now is None or then is None:
        return None
    change, additive = now - then, weight is None
    first = decompose(moments(df, usable, date, spans, value, weight), additive, support) if usable else None
    ranked, nodes = [], {}
    if first is not None:
        first = first.persist()
        try:
            rows = [r.asDict() for r in first.collect()]
            strength = {r["dimension"]: r.asDict() for r in powers(first).collect()}
        finally:
            first.unpersist()
        for d in usable:
            own = _judged([r for r in rows if r["dimension"] == d], whole.asDict(), change, flag, segments, rate)
            if own:
                sure = sum(r["significant"] for r in own)
                p = strength[d]
                power = min(1.0, 0.45 * p["dispersion"] + 0.35 * p["concentration"] + 0.20 * sure / len(own))
                nodes[d] = own[:segments]
                ranked.append({**p, "power": round(power, 4), "significant": sure, "verdict": "most" if power >= 0.55 and sure else "partly" if power >= 0.3 else "not"})
    ranked.sort(key=lambda r: -r["power"])
    top = nodes[ranked[0]["dimension"]] if ranked else []
    order = [r["dimension"] for r in ranked]
    frontier = [((r["segment"],), r) for r in top[:OPENED] if abs(r["contribution"] or 0) >= OPEN and r["n0"] + r["n1"] >= 2 * support]
    for level in range(1, min(depth, len(order))):
        if not frontier:
            break
        path, least = tuple(order[:level]), max(support // 2, 5)
        keys = [f"p{i}" for i in range(1, level + 1)]
        opened = df.sparkSession.createDataFrame([p for p, _ in frontier], ", ".join(f"{k} string" for k in keys))
        rows = [r.asDict() for r in decompose(moments(df, [order[level]], date, spans, value, weight, opened, path), additive, least, path).collect()]
        following = []
        for p, node in frontier:
            own = [r for r in rows if tuple(r[k] for k in keys) == p]
            if not own:
                continue
            base = {k: sum(r[k] for r in own) for k in ("n0", "n1", "s0", "s1")}
            judged = [r for r in _judged(own, base, node["delta"], flag, CHILDREN, rate)[:CHILDREN] if abs(r["contribution"] or 0) >= CHILD]
            node["children"] = judged
            following += [((*p, r["segment"]), r) for r in judged if abs(r["contribution"] or 0) >= OPEN and r["n0"] + r["n1"] >= 2 * least]
        frontier = following
    ruled = [{"kind": "dimension", "name": r["dimension"], "power": r["power"], "dispersion": r["dispersion"]} for r in ranked[1:] if r["power"] < 0.3]
    if others is not None:
        ruled += [{"kind": "kpi", "name": r["kpi_id"], "change": round(r["change"], 3)} for r in companions(others, kpi_id).where("exonerated").orderBy("kpi_id").collect()]
    moved = 100 * change / abs(then) if then else None
    direction = "flat" if abs(moved or 0) < 0.5 else "up" if change > 0 else "down"
    good = None if direction == "flat" else (direction == "up") == higher_is_better
    explained = sum(abs(r["contribution"] or 0) for r in top if r["role"] == "driver" and r["significant"])
    return {
        "comparison": spans.comparison, "current": now, "baseline": then, "delta": change, "change": moved, "direction": direction, "favourable": good,
        "severity": "info" if good is not False else "critical" if abs(moved or 0) >= 20 else "high" if abs(moved or 0) >= 10 else "medium",
        "dimensions": ranked, "nodes": top, "by_dimension": nodes, "ruled_out": ruled, "circular": excluded,
        "confidence": round(min(0.99, max(0.0, 0.35 + 0.45 * min(explained / 100, 1.0) + 0.20 * (ranked[0]["power"] if ranked else 0.0))), 3),
    }


def a_cycle_before(spans: Spans, days: int) -> Spans:
    """The same range of time, `days` earlier."""
    return Spans(spans.current, tuple(x - timedelta(days=days) for x in spans.current), f"{days} days before")


# -- the SQL profile ----------------------------------------------------------------------------------


def sql_nodes(m: DataFrame, total: float | Column) -> DataFrame:
    """Segments by the SQL profile, whose expected change is the baseline's times overall growth; roles from a tenth of the change on.

    `total` is the change to be explained. Rounded as that profile rounds; dimensions without 2 to 40 segments are left out.
    """
    w = Window.partitionBy("dimension")
    total = F.lit(total).cast("double") if not isinstance(total, Column) else total.cast("double")
    m = m.withColumn("segments", F.count(F.lit(1)).over(w)).where("segments BETWEEN 2 AND 40").withColumns({"_c": F.sum("s1").over(w), "_b": F.sum("s0").over(w)})
    growth = F.coalesce(ratio(F.col("_c"), F.col("_b")) - 1, F.lit(0.0))
    m = m.withColumn("delta", F.col("s1") - F.col("s0")).withColumns({"expected": F.col("s0") * growth, "contribution": ratio(F.col("delta"), total, 100), "growth_gap": (ratio(F.col("s1"), F.col("s0")) - 1 - growth) * 100})
    big = F.coalesce(F.abs("contribution") >= 10, F.lit(False))
    with_it = (total != 0) & (F.signum("delta") == F.signum(total))
    role = F.when(big & with_it, "driver").when(big & ~with_it, "offset").otherwise("stable")
    shares = [F.round(F.coalesce(ratio(F.col(s), F.col(t), 100), F.lit(0.0)), 2) for s, t in (("s1", "_c"), ("s0", "_b"))]
    return m.select("dimension", "segment", F.col("n1").alias("rows_current"), F.col("n0").alias("rows_baseline"), F.round("delta", 4).alias("delta"), F.round("contribution", 2).alias("contribution"), shares[0].alias("share_current"), shares[1].alias("share_baseline"), F.round("expected", 4).alias("expected"), F.round(F.col("delta") - F.col("expected"), 4).alias("excess"), F.round("growth_gap", 2).alias("growth_gap"), role.alias("role"))


def sql_powers(nodes: DataFrame, total: float | Column) -> DataFrame:
    """(dimension, power, concentration, dispersion, net_coverage, segments, verdict): three parts coverage by drivers, two parts concentration of the moves."""
    w = Window.partitionBy("dimension")
    total = F.lit(total).cast("double") if not isinstance(total, Column) else total.cast("double")
    n = nodes.withColumn("_s", F.coalesce(ratio(F.abs("delta"), F.sum(F.abs("delta")).over(w)), F.lit(0.0)))
    gap = F.coalesce("growth_gap", F.lit(0.0))
    a = n.groupBy("dimension").agg(F.coalesce(ratio(F.coalesce(F.sum(F.when(F.col("role") == "driver", F.col("delta"))), F.lit(0.0)), F.first(total), 100), F.lit(0.0)).alias("_net"), F.round(F.sum(F.col("_s") * F.col("_s")), 4).alias("concentration"), F.round(F.max(gap) - F.min(gap), 2).alias("dispersion"), F.count(F.lit(1)).alias("segments"))
    power = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs("_net") / 100 * 0.6 + F.col("concentration") * 0.4))
    return a.select("dimension", F.round(power, 3).alias("power"), "concentration", "dispersion", F.round("_net", 2).alias("net_coverage"), "segments", F.when(power >= 0.55, "most").when(power >= 0.3, "partly").otherwise("not").alias("verdict"))
