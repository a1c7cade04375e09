"""The sections of the report page for a role."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from stockweave.functions.scalars import default_period
from stockweave.operators import reports
from stockweave.operators.security import ACTION_ROLES


def report_page(
    t, role: str, as_of: date, start: date | None = None, end: date | None = None
) -> dict[str, DataFrame]:
    """Section name -> report, for the sections the role may see, all over one set of tables."""
    start, end = default_period(as_of, start, end)

    def may(action: str) -> bool:
        return role == "admin" or role in ACTION_ROLES[action]

    full = may("reports.view_full")
    sections: dict[str, DataFrame] = {}
    if full or may("reports.view_warehouse"):
        sections["material_stock"] = reports.material_stock_report(t)
        sections["low_stock"] = reports.low_stock_report(t)
        sections["finished_stock"] = reports.finished_stock_report(t)
    if full or may("reports.view_production"):
        sections["orders"] = reports.orders_in_period(t, start, end)
        sections["production"] = reports.production_in_period(t, start, end)
    if full:
        sections["sales"] = reports.sales_by_product(t, start, end)
        sections["unpaid_supplier_invoices"] = reports.unpaid_supplier_invoices(t, start, end)
        sections["paid_supplier_invoices"] = reports.paid_supplier_invoices(t, start, end)
        sections["supplier_invoice_summary"] = reports.supplier_invoice_summary(t, start, end)
    if full or may("reports.view_quality"):
        sections["quality"] = reports.quality_in_period(t, start, end)
    return sections
