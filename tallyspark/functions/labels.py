"""What people read instead of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
COSTS = {
    "revolving_interest": "Interés rotativo", "late_interest": "Interés por mora", "installment_interest": "Interés de cuotas", "cash_advance_interest": "Interés de avance", "maintenance": "Comisión de mantención",
    "international_purchase": "Comisión por compra internacional", "cash_advance_fee": "Comisión de avance", "collection": "Gastos de cobranza", "credit_tax": "Impuesto al crédito", "other": "Otro costo financiero",
}
MANDATES = {"pac": "PAC — pago automático de cuentas", "pat": "PAT — pago automático con tarjeta", "automatico": "pago automático"}
CARD_FACTS = {
    "statement_date": "Fecha del estado de cuenta", "billing_period": "Período de facturación", "due_date": "Fecha de vencimiento", "billed_amount": "Monto facturado", "minimum_payment": "Pago mínimo", "total_debt": "Deuda total",
    "domestic_debt": "Deuda nacional", "foreign_debt": "Deuda en moneda extranjera", "credit_limit": "Cupo total", "available_credit": "Cupo disponible",
}


def label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; null where there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), code)
