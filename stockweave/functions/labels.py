"""Display labels for codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label of every code and dictionary name.
LABELS = {
    "draft": "Черновик",
    "confirmed": "Подтверждён",
    "in_production": "В производстве",
    "ready": "Готов",
    "shipped": "Отгружен",
    "completed": "Завершён",
    "cancelled": "Отменён",
    "issued": "Выставлен",
    "paid": "Оплачен",
    "overdue": "Просрочен",
    "planned": "Запланирован",
    "delivered": "Доставлен",
    "received": "Получена",
    "accepted": "Принята",
    "rejected": "Отклонена",
    "in_progress": "В процессе",
    "passed": "Соответствует",
    "failed": "Не соответствует",
    "conditional": "Условно",
    "active": "Активен",
    "blocked": "Заблокирован",
    "disabled": "Отключён",
    "raw_material": "Сырьё",
    "finished_product": "Готовая продукция",
    "individual": "Физическое лицо",
    "company": "Компания",
    "INSERT": "Добавление",
    "UPDATE": "Изменение",
    "DELETE": "Удаление",
    "LOGIN": "Вход",
    "LOGOUT": "Выход",
    "Draft": "Черновик",
    "Confirmed": "Подтверждён",
    "In Production": "В производстве",
    "Ready": "Готов",
    "Shipped": "Отгружен",
    "Completed": "Завершён",
    "Cancelled": "Отменён",
    "Issued": "Выставлен",
    "Paid": "Оплачен",
    "Overdue": "Просрочен",
    "Planned": "Запланирован",
    "Delivered": "Доставлен",
    "Received": "Получена",
    "Accepted": "Принята",
    "Rejected": "Отклонена",
    "In Progress": "В процессе",
    "Passed": "Соответствует",
    "Failed": "Не соответствует",
    "Conditional": "Условно",
    "Active": "Активен",
    "Blocked": "Заблокирован",
    "Disabled": "Отключён",
    "Administrator": "Администратор",
    "Technologist": "Технолог",
    "Warehouse Worker": "Складской работник",
    "Quality Control": "Сотрудник ОТК",
    "Client": "Клиент",
    "system": "система",
}

# Display of booleans and of nothing.
YES, NO, NOTHING = "Да", "Нет", "—"


def translate_code(code: Column) -> Column:
    """The label of a code, of every code in a ', ' list, or the text itself; '—' for nothing."""
    labels = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABELS.items())])

    def one(text: Column) -> Column:
        return F.coalesce(F.try_element_at(labels, text), text)

    listed = F.array_join(F.transform(F.split(code, ","), lambda part: one(F.trim(part))), ", ")
    whole = F.try_element_at(labels, code)
    return (
        F.when(code.isNull() | (code == ""), F.lit(NOTHING))
        .when(whole.isNotNull(), whole)
        .when(F.contains(code, F.lit(", ")), listed)
        .otherwise(code)
    )


def display_flag(flag: Column) -> Column:
    """'Да' or 'Нет'; '—' for NULL."""
    return F.when(flag.isNull(), F.lit(NOTHING)).when(flag, F.lit(YES)).otherwise(F.lit(NO))
