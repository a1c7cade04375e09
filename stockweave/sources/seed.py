"""The demonstration data set: a few rows per table, dated relative to a day."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from decimal import Decimal

from pyspark.sql import SparkSession

from stockweave.schemas import LAYOUTS, STATUSES, layout
from stockweave.sources.tables import Tables


def seed_rows(as_of: date) -> dict[str, list[tuple]]:
    """Rows per table. Fixed values; days count from ``as_of``, times from its noon."""

    def day(offset: int) -> date:
        return as_of + timedelta(days=offset)

    def at(days: int, **extra) -> datetime:
        return datetime.combine(as_of, time(12)) + timedelta(days=days, **extra)

    n = Decimal
    rows: dict[str, list[tuple]] = {
        name: [(code, label, None) for code, label in entries] for name, entries in STATUSES.items()
    }
    rows["customers"] = [
        (1, "individual", "Ivan Petrov", None, "+7-900-100-10-10", "ivan.petrov@example.com", "12 Baker Street", at(-57), True),
        (2, "company", None, "Sunrise Retail LLC", "+7-900-200-20-20", "procurement@sunrise-retail.example", "45 Market Avenue", at(-56), True),
        (3, "individual", "Anna Sokolova", None, "+7-900-300-30-30", None, "78 River Lane", at(-52), True),
    ]
    rows["suppliers"] = [
        (1, "Grain Supply Ltd", "Sergey Makarov", "+7-901-100-00-01", "sales@grainsupply.example", None, at(-60), True),
        (2, "Sweet Ingredients LLC", "Olga Voronina", "+7-901-200-00-02", "orders@sweetingredients.example", None, at(-59), True),
        (3, "Dairy and Oils JSC", "Nikolay Smirnov", "+7-901-300-00-03", "office@dairyoils.example", None, at(-58), True),
    ]
    rows["raw_materials"] = [
        (1, "Flour", "kg", n("500.000"), 180, None, True),
        (2, "Yeast", "kg", n("50.000"), 30, None, True),
        (3, "Salt", "kg", n("25.000"), 365, None, True),
        (4, "Sugar", "kg", n("100.000"), 365, None, True),
        (5, "Poppy Seeds", "kg", n("40.000"), 180, None, True),
        (6, "Butter", "kg", n("60.000"), 60, None, True),
    ]
    rows["products"] = [
        (1, "Borodinsky Bread", "Bread", "piece", n("85.00"), 5, True, at(-54)),
        (2, "Moscow Bread", "Bread", "piece", n("78.00"), 4, True, at(-54, minutes=10)),
        (3, "Poppy Seed Roll", "Pastry", "piece", n("140.00"), 4, True, at(-54, minutes=20)),
    ]
    rows["roles"] = [
        (1, "admin", "Administrator", None),
        (2, "technologist", "Technologist", None),
        (3, "warehouse_worker", "Warehouse Worker", None),
        (4, "quality_control", "Quality Control", None),
        (5, "client", "Client", None),
    ]
    rows["users"] = [
        (1, "admin", "hash", "Alexey Morozov", "admin@example.com", None, "active", None, at(-57), at(-1)),
        (2, "technologist", "hash", "Elena Kuznetsova", "technologist@example.com", None, "active", None, at(-57), None),
        (3, "warehouse", "hash", "Pavel Lebedev", "warehouse@example.com", None, "active", None, at(-57), None),
        (4, "quality", "hash", "Maria Volkova", "quality@example.com", None, "active", None, at(-57), None),
        (5, "client", "hash", "Ivan Petrov", "client@example.com", None, "active", 1, at(-57), at(-2)),
    ]
    rows["user_roles"] = [(user, user, at(-57, minutes=29 + user), 1) for user in range(1, 6)]
    rows["role_permissions"] = [
        (1, 1, "users", True, True, True, True),
        (2, 1, "audit_log", True, False, False, False),
        (3, 2, "tech_cards", True, True, True, False),
        (4, 2, "recipe_items", True, True, True, False),
        (5, 2, "production_batches", True, True, True, False),
        (6, 3, "raw_material_deliveries", True, True, True, False),
        (7, 3, "raw_material_stock", True, True, True, False),
        (8, 3, "shipments", True, True, True, False),
        (9, 4, "quality_checks", True, True, True, False),
        (10, 5, "customer_orders", True, False, False, False),
        (11, 5, "invoices", True, False, False, False),
        (12, 5, "shipments", True, False, False, False),
    ]
    rows["supplier_materials"] = [
        (1, 1, 1, n("18.00"), 2, True),
        (2, 1, 3, n("9.00"), 2, True),
        (3, 1, 2, n("190.00"), 3, True),
        (4, 2, 4, n("52.00"), 3, True),
        (5, 2, 5, n("240.00"), 4, True),
        (6, 2, 1, n("19.00"), 4, True),
        (7, 3, 2, n("185.00"), 1, True),
        (8, 3, 6, n("310.00"), 1, True),
    ]
    rows["raw_material_deliveries"] = [
        (1, 1, "DN-2026-001", day(-18), "accepted", 3, "SUP-INV-001", n("22950.00"), None),
        (2, 2, "DN-2026-002", day(-16), "accepted", 3, "SUP-INV-002", n("49600.00"), None),
        (3, 3, "DN-2026-003", day(-12), "accepted", 3, "SUP-INV-003", n("72450.00"), None),
    ]
    rows["delivery_items"] = [
        (1, 1, 1, n("1200.000"), n("18.00"), "FL-260325", day(120)),
        (2, 1, 3, n("150.000"), n("9.00"), "SA-260325", day(280)),
        (3, 2, 4, n("400.000"), n("52.00"), "SU-260327", day(300)),
        (4, 2, 5, n("120.000"), n("240.00"), "PO-260327", day(110)),
        (5, 3, 2, n("90.000"), n("185.00"), "YE-260401", day(12)),
        (6, 3, 6, n("180.000"), n("310.00"), "BU-260401", day(20)),
    ]
    rows["raw_material_stock"] = [
        (1, 1, 1, "FL-260325", n("860.000"), day(120), at(-4)),
        (2, 3, 2, "SA-260325", n("120.000"), day(280), at(-4)),
        (3, 4, 3, "SU-260327", n("260.000"), day(300), at(-4)),
        (4, 5, 4, "PO-260327", n("70.000"), day(110), at(-4)),
        (5, 2, 5, "YE-260401", n("35.000"), day(12), at(-4)),
        (6, 6, 6, "BU-260401", n("90.000"), day(20), at(-4)),
    ]
    rows["tech_cards"] = [
        (1, 1, "TC-BREAD-001", 1, "active", day(-120), None, 48, n("225.00"), "Mix, proof, bake.", 2),
        (2, 2, "TC-BREAD-002", 1, "active", day(-120), None, 42, n("220.00"), "Ferment, shape, bake.", 2),
        (3, 3, "TC-ROLL-001", 1, "active", day(-120), None, 32, n("210.00"), "Fill, roll, bake.", 2),
    ]
    rows["recipe_items"] = [
        (1, 1, 1, n("0.700"), "kg", "mixing", n("1.50"), None),
        (2, 1, 2, n("0.020"), "kg", "mixing", n("0.00"), None),
        (3, 1, 3, n("0.015"), "kg", "mixing", n("0.00"), None),
        (4, 1, 4, n("0.030"), "kg", "mixing", n("0.00"), None),
        (5, 2, 1, n("0.650"), "kg", "mixing", n("1.20"), None),
        (6, 2, 2, n("0.018"), "kg", "mixing", n("0.00"), None),
        (7, 2, 3, n("0.012"), "kg", "mixing", n("0.00"), None),
        (8, 2, 6, n("0.015"), "kg", "finishing", n("0.50"), None),
        (9, 3, 1, n("0.500"), "kg", "mixing", n("1.00"), None),
        (10, 3, 2, n("0.015"), "kg", "mixing", n("0.00"), None),
        (11, 3, 4, n("0.080"), "kg", "mixing", n("0.00"), None),
        (12, 3, 6, n("0.060"), "kg", "mixing", n("0.50"), None),
        (13, 3, 5, n("0.120"), "kg", "filling", n("2.00"), None),
        (14, 3, 3, n("0.008"), "kg", "mixing", n("0.00"), None),
    ]
    rows["customer_orders"] = [
        (1, "ORD-2026-001", 1, at(-5), day(-4), "completed", 5, None),
        (2, "ORD-2026-002", 2, at(-4), day(-2), "shipped", 1, None),
        (3, "ORD-2026-003", 3, at(-3), day(1), "confirmed", 1, None),
    ]
    rows["order_items"] = [
        (1, 1, 1, n("40.000"), n("85.00"), n("3400.00")),
        (2, 1, 3, n("10.000"), n("140.00"), n("1400.00")),
        (3, 2, 2, n("80.000"), n("78.00"), n("6240.00")),
        (4, 2, 1, n("50.000"), n("85.00"), n("4250.00")),
        (5, 3, 3, n("12.000"), n("140.00"), n("1680.00")),
    ]
    rows["production_batches"] = [
        (1, "PB-2026-0402-01", 1, 1, at(-4), "morning", n("120.000"), n("2.000"), 2, "completed", None),
        (2, "PB-2026-0404-01", 2, 2, at(-3), "morning", n("100.000"), n("1.000"), 2, "completed", None),
        (3, "PB-2026-0406-01", 3, 3, at(-1), "morning", n("40.000"), n("0.000"), 2, "completed", None),
    ]
    rows["finished_goods_stock"] = [
        (1, 1, 1, "PB-2026-0402-01", n("28.000"), day(-4), day(1), at(-1)),
        (2, 2, 2, "PB-2026-0404-01", n("20.000"), day(-3), day(1), at(-1)),
        (3, 3, 3, "PB-2026-0406-01", n("30.000"), day(-1), day(3), at(-1)),
    ]
    rows["quality_checks"] = [
        (1, "raw_material", 1, None, at(-18, hours=6), 4, "passed", "moisture", "14.0%", "<= 15.0%", "QC-RM-001", None),
        (2, "raw_material", 5, None, at(-12, hours=5), 4, "conditional", "fermentation_activity", "82%", ">= 80%", "QC-RM-002", None),
        (3, "finished_product", None, 1, at(-4, hours=3), 4, "passed", "weight", "0.78 kg", "0.75-0.80 kg", "QC-FG-001", None),
        (4, "finished_product", None, 3, at(-1, hours=3), 4, "passed", "filling_distribution", "uniform", "even distribution", "QC-FG-002", None),
    ]
    rows["invoices"] = [
        (1, "INV-2026-001", 1, day(-5), day(-2), at(-4), n("4800.00"), "paid", None),
        (2, "INV-2026-002", 2, day(-4), day(2), None, n("10490.00"), "issued", None),
        (3, "INV-2026-003", 3, day(-3), day(-1), None, n("1680.00"), "overdue", None),
    ]
    rows["supplier_invoices"] = [
        (1, "SINV-2026-001", 1, 1, day(-18), day(-11), at(-17), n("22950.00"), "paid", "SUP-INV-001", None),
        (2, "SINV-2026-002", 2, 2, day(-16), day(-9), None, n("49600.00"), "overdue", "SUP-INV-002", None),
        (3, "SINV-2026-003", 3, 3, day(-12), day(-5), None, n("72450.00"), "issued", "SUP-INV-003", None),
    ]
    rows["shipments"] = [
        (1, "SHP-2026-001", 1, at(-4, hours=8), "delivered", "12 Baker Street", "WB-2026-001", 3, None),
        (2, "SHP-2026-002", 2, at(-1, hours=9), "shipped", "45 Market Avenue", "WB-2026-002", 3, None),
        (3, "SHP-2026-003", 3, None, "planned", "78 River Lane", None, 3, None),
    ]
    rows["shipment_items"] = [
        (1, 1, 1, 1, 1, n("40.000")),
        (2, 1, 2, 3, 3, n("10.000")),
        (3, 2, 3, 2, 2, n("79.000")),
        (4, 2, 4, 1, 1, n("50.000")),
    ]
    rows["audit_log"] = [
        (1, 1, "LOGIN", "users", "user_id=1", at(0), None, None, "192.168.10.10", True),
        (2, 1, "LOGOUT", "users", "user_id=1", at(0), None, None, "192.168.10.10", True),
        (3, 5, "LOGIN", "users", "user_id=5", at(0), None, None, "192.168.10.25", True),
    ]
    return rows


def seed_tables(spark: SparkSession, as_of: date) -> Tables:
    """The demonstration rows as DataFrames with their declared layout."""
    rows = seed_rows(as_of)
    return Tables({name: (lambda name=name: spark.createDataFrame(rows[name], layout(name))) for name in LAYOUTS})
