"""Binding: which column plays which role, what the table is about, and the analyse() pipeline over both."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import series as S
from plumbline.functions.columns import period
from plumbline.operators import anomaly, causes, kpi, outlook, privacy, profile, quality
from plumbline.plans import domains, kinds, render

# Names that mean a role (an underscore may be missing), in order.
ROLE_NAMES = {
    "revenue": "revenue sales net_sales gross_sales total_amount amount sales_amount order_value gmv turnover billing invoice_amount transaction_amount line_total",
    "profit": "profit net_profit gross_profit margin_amount contribution earnings net_income",
    "cost": "cost cogs cost_of_goods total_cost unit_cost expense expenses spend opex",
    "discount": "discount discount_amount discount_pct promo_discount markdown",
    "price": "price unit_price list_price selling_price rate",
    "quantity": "quantity qty units units_sold volume item_count line_qty",
    "marketing_spend": "marketing_spend ad_spend campaign_spend media_spend budget spend cost",
    "impressions": "impressions views reach displays",
    "clicks": "clicks link_clicks taps",
    "conversions": "conversions conversion purchases signups sign_ups leads installs orders",
    "sessions": "sessions visits traffic users unique_visitors",
    "customer_id": "customer_id cust_id client_id account_id user_id member_id cardholder_id patient_id employee_id",
    "order_id": "order_id transaction_id txn_id invoice_id receipt_id sale_id payment_id booking_id",
    "product_id": "product_id sku item_id product item product_name",
    "merchant_id": "merchant_id merchant vendor_id supplier_id store_id seller_id",
    "campaign_id": "campaign_id campaign campaign_name ad_group creative",
    "employee_id": "employee_id emp_id staff_id worker_id",
    "region": "region territory zone area market geo country state city branch location",
    "segment": "segment customer_segment tier plan category customer_type class cohort persona department dept division business_unit team specialty speciality ward line production_line work_center",
    "channel": "channel source medium acquisition_channel platform device sales_channel",
    "status": "status state order_status payment_status stage outcome result disposition",
    "churn_flag": "churn churned is_churn churn_flag attrition attrition_flag left exited terminated",
    "fraud_flag": "fraud is_fraud fraud_flag fraudulent chargeback dispute",
    "return_flag": "returned is_return return_flag refund refunded cancelled canceled",
    "defect_flag": "defect is_defect defect_flag failed rejected scrap ng",
    "new_customer_flag": "is_new new_customer first_purchase acquisition_flag",
    "satisfaction": "satisfaction nps csat rating score review_score feedback",
    "salary": "salary compensation pay wage ctc annual_salary",
    "tenure": "tenure years_of_service months_employed seniority",
    "length_of_stay": "length_of_stay los days_admitted stay_days",
    "readmission_flag": "readmitted readmission readmission_flag is_readmit",
    "downtime": "downtime downtime_minutes stoppage idle_time",
    "output": "output produced production units_produced throughput",
    "date": "date order_date transaction_date txn_date created_at timestamp event_date invoice_date posting_date day period month",
}
NUMERIC_ROLES = {"revenue", "profit", "cost", "discount", "price", "quantity", "marketing_spend", "impressions", "clicks", "conversions", "sessions", "salary", "tenure", "length_of_stay", "downtime", "output", "satisfaction"}
SHARED = {"marketing_spend", "cost", "conversions"}
EXACT, FUZZY = 1.0, 0.55


def _bare(x: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", x.lower())


def resolve_roles(df: DataFrame, given: dict[str, str] | None = None) -> tuple[dict[str, str], list[dict]]:
    """role -> column, strongest match first; a column has one role (spend, cost and conversions may share). `given` wins.

    The second value tells for each bound role how it was found.
    """
    kinds, trail, out = dict(df.dtypes), [], dict(given or {})
    trail += [{"role": r, "column": c, "score": EXACT, "why": "given"} for r, c in out.items()]
    offers = []
    for order, (role, names) in enumerate(ROLE_NAMES.items()):
        for c, kind in kinds.items():
            numeric, time = profile.is_numeric(kind), kind.startswith(("timestamp", "date"))
            if (role in NUMERIC_ROLES and not numeric) or (role == "date") != time:
                continue
            words = [_bare(n) for n in names.split()]
            score = EXACT if _bare(c) in words else FUZZY if any(len(w) > 3 and w in _bare(c) for w in words) else 0
            if score:
                offers.append((-score, order, c, role))
    taken = set(out.values())
    for score, _, c, role in sorted(offers):
        if role not in out and (c not in taken or role in SHARED):
            out[role] = c
            taken.add(c)
            trail.append({"role": role, "column": c, "score": -score, "why": "name"})
    if "date" not in out and (t := next((c for c, k in kinds.items() if k.startswith(("timestamp", "date"))), None)):
        out["date"] = t
        trail.append({"role": "date", "column": t, "score": FUZZY, "why": "only time column"})
    return out, trail


def detect_domain(df: DataFrame, roles: dict[str, str], texts: list[str] | None = None) -> tuple[str, float]:
    """The domain that names, roles and values speak for most, and a confidence."""
    lead = kinds.domains(df, roles, texts).where("confidence IS NOT NULL").orderBy("place").first()
    return lead["domain"], lead["confidence"]


def dimensions(df: DataFrame, roles: dict[str, str], private: set[str], most: int = 6, levels: tuple[int, int] = (2, 40)) -> list[str]:
    """Text columns with few levels that are neither private nor measures; one aggregation counts them all."""
    some = [c for c, k in df.dtypes if k == "string" and c not in private]
    if not some:
        return []
    r = df.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(some)]).first()
    fit = [(r[f"d{i}"], c) for i, c in enumerate(some) if levels[0] <= r[f"d{i}"] <= min(levels[1] * 1.2, max(2, r["_n"] // 2))]
    return [c for _, c in sorted(fit)][:most]


def analyse(df: DataFrame, roles: dict[str, str] | None = None, kpis: list[str] | None = None, grain: str | None = None, horizon: int = 3, title: str = "Analysis", as_of: str | None = None) -> dict:
    """Profile, quality, privacy, roles, KPIs, anomalies, root cause, forecast, report. A stage that fails becomes a warning."""
    out: dict = {"warnings": []}

    def stage(name: str, work) -> None:
        try:
            out[name] = work()
        except Exception as e:  # noqa: BLE001  a stage must not end the analysis
            out["warnings"].append(f"{name}: {e}".splitlines()[0][:300])

    df = df.persist()
    try:
        stage("profile", lambda: [r.asDict() for r in profile.counts(df).collect()])
        stage("privacy", lambda: privacy.detect(df))
        bound, trail = resolve_roles(df, roles)
        out["roles"], out["role_trail"] = bound, trail
        out["domain"], out["domain_confidence"] = detect_domain(df, bound, dimensions(df, bound, {c for c, f in (out.get("privacy") or {}).items() if f["policy"] == "mask"}, 12))

        def checks() -> dict:
            kinds, mail = dict(df.dtypes), [c for c, f in (out.get("privacy") or {}).items() if f.get("category") == "email"]
            money = tuple(c for r, c in bound.items() if r in ("revenue", "marketing_spend", "cost", "quantity", "salary") and profile.is_numeric(kinds[c]))
            share = tuple(c for r, c in bound.items() if r == "discount" and profile.is_numeric(kinds[c]))
            texts = tuple(dimensions(df, bound, set(mail)))
            parts = quality.dimensions(df, as_of or datetime.now(timezone.utc).date().isoformat(), bound.get("date"), tuple(dict.fromkeys(money)), share, tuple(mail), texts, tuple(dict.fromkeys((*money, *share)))).first().asDict()
            letter = quality.grade(parts["score"], critical=parts["critical"])
            return {**parts, "duplicates": quality.exact_duplicates(df).first()["duplicates"], "grade": letter[0], "usable": letter[1]}

        stage("quality", checks)
        date = bound.get("date")
        if date:
            g = grain or kpi.choose_grain(df, date)
            out["grain"] = g
            ids, lead = domains.choose_kpis(out["domain"], bound) if kpis is None else (kpis, next((k for k in ("revenue", "record_count", *kpis) if k in kpis), None))
            stage("scorecard", lambda: [r.asDict() for r in kpi.scorecard(df, date, g, bound, ids).orderBy("kpi_id", "period").collect()])
            card = out.get("scorecard") or []
            out["primary"] = lead
            stage("cards", lambda: kpi.cards(card, g))
            y = [r["value"] for r in card if r["kpi_id"] == lead]
            labels = [str(r["period"]) for r in card if r["kpi_id"] == lead]
            stage("anomalies", lambda: S.anomalies(y, labels))
            stage("forecast", lambda: S.forecast(y, horizon))
            stage("future", lambda: outlook.month_labels(df.sparkSession, labels[-1], horizon, g) if labels else [])
            stage("trend", lambda: S.mann_kendall(y))
            dims = dimensions(df, bound, {c for c, f in (out.get("privacy") or {}).items() if f["policy"] == "mask"} | {date})
            dims = domains.ordered_dimensions(out["domain"], lead, bound, dims)
            out["dimensions"] = dims
            cycle = next((c["cycle"] for c in out.get("cards") or [] if c["kpi_id"] == lead), None)

            def cause() -> dict | None:
                spans = causes.compared(df, date, g, cycle)
                if spans is None:
                    return None
                value = F.col(bound["revenue"]) if lead == "revenue" else F.lit(1.0)
                at = {"current": spans.current[0].date(), "baseline": spans.baseline[0].date()}
                others = [(k, *(next((float(r["value"]) for r in card if r["kpi_id"] == k and r["period"] == p and r["value"] is not None), None) for p in at.values())) for k in dict.fromkeys(r["kpi_id"] for r in card)]
                others = df.sparkSession.createDataFrame(others, "kpi_id string, current double, baseline double")
                return causes.explain(df, dims, date, spans, value, sources=[F.col(bound["revenue"])] if "revenue" in bound else [], others=others, kpi_id=lead, higher_is_better=kpi.REGISTRY[lead].higher_is_better)

            if len(labels) >= 2 and dims:
                stage("root_cause", cause)
        stage("report", lambda: render.report(title, out))
    finally:
        df.unpersist()
    return out


__all__ = ["analyse", "anomaly", "detect_domain", "dimensions", "resolve_roles"]
